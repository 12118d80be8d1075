"""The 26 rule signals and three composites for all entities in one plan (SIG-F1..F5, EG-001..014, NS-001..012, COMP-001..003)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp01, clean_float, finding_id, share
from ..functions.tables import settled, written
from ..params import DEFAULT, SEVERITY_RANK, Params
from .coverage import coverage_summary, daily_alerts, detrended, is_critical, is_facing, perimeter_blind
from .temporal import bursts
from .text import note_similarity
from .workflow import case_rates, duplicate_depth, is_backfilled


@dataclass(frozen=True)
class Signal:
    """A rule over the wide metrics row of an entity: SQL expressions of its value and sample size, and its gate."""

    id: str
    name: str
    value: str
    threshold: float
    severity: str
    n: str
    gate: str = ""  # SQL condition of enough data; by default n >= the least sample size
    flag: str = ""  # SQL condition in place of value >= threshold
    confidence: str = "MEDIUM"


#: Values and thresholds are fixed by the analysis; expressions read metrics().
SIGNALS = [
    Signal("EG-001", "Premature closure", "premature_rate", 0.20, "HIGH", "n_critical_closed"),
    Signal("EG-002", "Reopen churn", "reopen_rate", 0.15, "MEDIUM", "n_cases"),
    Signal("EG-003", "Escalation bypass", "bypass_rate", 0.90, "HIGH", "n_critical"),
    Signal("EG-004", "Severity downgrade bias", "alert_rank - case_rank", 0.25, "MEDIUM", "n_cases", "n_alerts >= {min_n} and n_cases >= {min_n}"),
    Signal("EG-005", "SLA breach backlog", "sla_breach_rate", 0.30, "MEDIUM", "n_closed"),
    Signal("EG-006", "Bulk close burst", "burst_max", 50, "HIGH", "n_closed"),
    Signal("EG-007", "Metric gaming", "gaming / 3.0e0", 1.0, "HIGH", "n_cases", "n_cases >= {min_n} and n_peers >= 4"),
    Signal("EG-008", "After-hours closure rush", "night_fraction", 0.50, "MEDIUM", "n_closed"),
    Signal("EG-009", "Backfill documentation", "backfill_rate", 0.10, "MEDIUM", "n_alerts"),
    Signal("EG-010", "Templated notes", "template_similarity", 0.85, "HIGH", "n_notes"),
    Signal("EG-011", "Duplicate chain", "greatest(least(1.0e0, chain_depth / 5.0e0), duplicate_share)", 0.10, "MEDIUM", "n_cases"),
    Signal("EG-012", "Orphan case rate", "orphan_case_rate", 0.30, "MEDIUM", "n_cases"),
    Signal("EG-013", "Suspiciously perfect SLA", "sla_met * (1.0e0 - least(1.0e0, cv / 0.05e0))", 0.99, "MEDIUM", "n_closed", "n_closed >= {perfect_min}", "sla_met >= 0.99e0 and cv < 0.05e0"),
    Signal("EG-014", "Escalation to nowhere", "nowhere_rate", 0.50, "MEDIUM", "n_escalations", "n_escalations > 0"),
    Signal("NS-001", "Critical coverage gap", "telemetry_gap_ratio", 0.10, "HIGH", "n_assets"),
    Signal("NS-002", "Silence streak", "silence_max", 7, "MEDIUM", "space_rows"),
    Signal("NS-003", "Category absence vs peers", "category_z", 2.0, "MEDIUM", "n_alerts", "(n_alerts >= {min_n} or n_alerts = 0) and n_peers > 0"),
    Signal("NS-004", "Tactic absence", "1.0e0 - tactic_coverage", 0.34, "MEDIUM", "n_alerts", "n_alerts >= {min_n} or n_alerts = 0"),
    Signal("NS-005", "Expected source absent", "expected_absent_count", 1, "MEDIUM", "n_assets"),
    Signal("NS-006", "Perimeter blind spot", "perimeter_blind", 1, "MEDIUM", "n_facing"),
    Signal("NS-007", "Detrended low activity", "- residual_mean_7 / residual_std", 2.0, "MEDIUM", "n_alerts", "n_days >= 14"),
    Signal("NS-008", "Internet-facing blind spot", "facing_silent", 2.0, "MEDIUM", "n_facing"),
    Signal("NS-009", "Telemetry gap spike", "telemetry_gap_ratio", 0.10, "MEDIUM", "n_assets"),
    Signal("NS-010", "Silent critical estate", "critical_silent / greatest(1.0e0, n_critical_assets)", 0.20, "HIGH", "n_critical_assets"),
    Signal("NS-011", "No after-hours activity", "1.0e0 - night_fraction", 0.95, "LOW", "n_closed", confidence="LOW"),
    Signal("NS-012", "Feed truncation", "(feed_baseline - feed_now) / feed_baseline", 0.50, "HIGH", "n_alerts", "n_windows >= 4 and feed_baseline > 0", "(feed_baseline - feed_now) / feed_baseline >= 0.5e0 and not feed_explained"),
]

#: Composites as trees over signal ids; high_band is whether any asset has criticality HIGH.
COMPOSITES = {
    "COMP-001": ("Superficial compliance", ("and", "EG-003", ("or", "NS-005", "NS-006"), "EG-013")),
    "COMP-002": ("Silent critical estate", ("and", "NS-001", "NS-010", "high_band")),
    "COMP-003": ("Metric theatre", ("and", "EG-007", "EG-010", "EG-006")),
}

RULES_AT_ONCE = 7  # rules in one generated method; more don't fit into 64 KB of code
SEVERITY_ORDER = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
CONFIDENCE_ORDER = ["LOW", "MEDIUM", "HIGH"]


def _rank(c: str) -> Column:
    return F.create_map(*(F.lit(x) for kv in SEVERITY_RANK.items() for x in kv))[F.col(c)]


def asset_counts(assets: DataFrame, alerts: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Asset counts by entity: all, critical, facing, and those without alerts or without perimeter telemetry."""
    seen = alerts.filter("asset_id is not null").select("entity_id", "asset_id", F.lit(True).alias("alerted")).distinct()
    a = assets.join(seen, ["entity_id", "asset_id"], "left")
    silent = F.col("alerted").isNull()
    n = a.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_assets"), F.count_if(is_critical()).alias("n_critical_assets"), F.count_if(is_critical() & silent).alias("critical_silent"), F.count_if(is_facing()).alias("n_facing"), F.count_if(is_facing() & silent).alias("facing_silent"))
    blind = perimeter_blind(assets, telemetry).groupBy("entity_id").agg(F.count(F.lit(1)).alias("perimeter_blind"))
    return n.join(blind, "entity_id", "left")


def activity(alerts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Inputs of NS-007: mean of the last seven residuals, their deviation over all days (1 if it is 0), number of days."""
    w = Window.partitionBy("entity_id").orderBy(F.desc("day"))
    d = detrended(daily_alerts(alerts), p).withColumn("back", F.row_number().over(w))
    a = d.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_days"), F.avg(F.when(F.col("back") <= 7, F.col("residual"))).alias("residual_mean_7"), F.stddev_samp("residual").alias("std"))
    return a.select("entity_id", "n_days", "residual_mean_7", F.coalesce(F.nullif("std", F.lit(0.0)), F.lit(1.0)).alias("residual_std"))


def feed_windows(alerts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Inputs of NS-012: alerts of the latest window, and the mean of the last trailing_windows with it."""
    n = alerts.filter("detected_ts is not null").groupBy("entity_id", F.window("detected_ts", f"{p.window_days} days").alias("w")).agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy("entity_id").orderBy("w.start")
    d = n.withColumns({"mean": F.avg("cnt").over(w.rowsBetween(-p.trailing_windows + 1, 0)), "windows": F.count(F.lit(1)).over(w)})
    return d.groupBy("entity_id").agg(F.max("windows").alias("n_windows"), F.max_by("mean", "windows").alias("feed_baseline"), F.max_by("cnt", "windows").alias("feed_now"))


def gaming(rates: DataFrame) -> DataFrame:
    """Input of EG-007: how many of closure and recurrence lie in the top quarter, and root causes in the bottom quarter, of all entities, the entity included."""
    q = rates.agg(*(F.percentile(c, F.lit(x)).alias(f"_{c}") for c, x in (("closure_rate", 0.75), ("reopen_rate", 0.75), ("root_cause_rate", 0.25))), (F.count(F.lit(1)) - 1).alias("n_peers"))
    hits = (F.col("closure_rate") >= F.col("_closure_rate")).cast("int") + (F.col("reopen_rate") >= F.col("_reopen_rate")).cast("int") + (F.col("root_cause_rate") <= F.col("_root_cause_rate")).cast("int")
    return rates.crossJoin(F.broadcast(q)).select("entity_id", hits.alias("gaming"), "n_peers")  # q is one row


def category_z(coverage: DataFrame) -> DataFrame:
    """Input of NS-003: modified z of the number of missing categories among the other entities."""
    from .peers import long_form, modified_z

    return modified_z(long_form(coverage, ["category_missing"])).select("entity_id", F.col("z").alias("category_z"))


def needed(signals: list[Signal]) -> set[str]:
    """The columns of metrics() that the signals read."""
    return {w for x in signals for w in re.findall(r"[a-z_0-9]+", f"{x.value} {x.n} {x.gate} {x.flag}")} | {"high_band"}


def metrics(t, p: Params = DEFAULT, only: set[str] | None = None) -> DataFrame:
    """One row an entity of the registry with the inputs of the signals; entities without rows get zeros.

    only names the columns that are read; parts without any of them are left out.
    """
    rates = case_rates(t.cases, t.escalations, p)
    cover = coverage_summary(t.registry, t.assets, t.telemetry, t.alerts, p)
    c = t.cases.select("entity_id", "case_id", F.col("status").alias("case_status"), F.col("tier").alias("case_tier"))
    nowhere = F.col("accepted_ts").isNull() & (F.col("case_status") == "CLOSED") & (F.col("case_tier") == F.col("from_tier"))
    parts = {
        "gaming n_peers": lambda: gaming(rates),
        "n_alerts backfill_rate alert_rank": lambda: t.alerts.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_alerts"), share(is_backfilled(p=p)).alias("backfill_rate"), F.avg(_rank("severity_norm")).alias("alert_rank")),
        "case_rank": lambda: t.cases.groupBy("entity_id").agg(F.avg(_rank("severity_norm")).alias("case_rank")),
        "burst_max": lambda: bursts(t.cases, p).groupBy("entity_id").agg(F.max("burst_size").alias("burst_max")),
        "chain_depth": lambda: duplicate_depth(t.cases).withColumnRenamed("depth", "chain_depth"),
        "n_notes template_similarity": lambda: settled(t.investigations.sparkSession, "note-similarity", lambda: note_similarity(t.investigations.filter("notes is not null"), ["entity_id"])).select("entity_id", "n_notes", F.col("similarity").alias("template_similarity")),
        "n_escalations nowhere_rate": lambda: t.escalations.join(c, ["entity_id", "case_id"], "left").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_escalations"), share(nowhere).alias("nowhere_rate")),
        "telemetry_gap_ratio silence_max category_missing tactic_coverage expected_absent_count space_rows": lambda: cover,
        "category_z": lambda: category_z(cover),
        "high_band": lambda: t.assets.groupBy("entity_id").agg(F.coalesce(F.bool_or(F.upper("criticality") == "HIGH"), F.lit(False)).alias("high_band")),
        "n_assets n_critical_assets critical_silent n_facing facing_silent perimeter_blind": lambda: asset_counts(t.assets, t.alerts, t.telemetry),
        "n_days residual_mean_7 residual_std": lambda: activity(t.alerts, p),
        "n_windows feed_baseline feed_now": lambda: feed_windows(t.alerts, p),
    }
    d = t.registry.select("entity_id", (F.coalesce("feed_explanation", F.lit("")) != "").alias("feed_explained")).join(rates, "entity_id", "left")
    for columns, part in parts.items():
        if only is None or only & set(columns.split()):
            d = d.join(part(), "entity_id", "left")
    d = d.withColumn("cv", F.when(F.col("mean_hours") > 0, F.col("std_hours") / F.col("mean_hours")).otherwise(0.0))
    return d.na.fill(0, [c for c, kind in d.dtypes if kind in ("bigint", "int", "double") and c not in ("cv", "residual_std", "feed_baseline")]).na.fill(False)


def evaluate(wide: DataFrame, window: Column | None = None, p: Params = DEFAULT, seed: int = 42, signals: list[Signal] = SIGNALS) -> DataFrame:
    """SIG-F1, SIG-F2: the long results of all signals from metrics(): value, flag, score, and the gate for small samples."""
    out = None
    for some in (signals[i : i + RULES_AT_ONCE] for i in range(0, len(signals), RULES_AT_ONCE)):
        part = wide.select("entity_id", "high_band", F.inline(F.array(*_rules(some, p))))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("finding_id", finding_id(F.col("signal_id"), F.col("entity_id"), F.lit("") if window is None else window, seed))


def _rules(signals: list[Signal], p: Params) -> list[Column]:
    rules = []
    for s in signals:
        enough = F.coalesce(F.expr((s.gate or f"{s.n} >= {{min_n}}").format(min_n=p.min_n, perfect_min=max(p.min_n, p.perfect_min))), F.lit(False))
        value = F.when(enough, clean_float(F.expr(s.value).cast("double"))).otherwise(0.0)
        flag = F.expr(s.flag) if s.flag else value >= s.threshold
        rules.append(F.struct(F.lit(s.id).alias("signal_id"), value.alias("value"), F.lit(float(s.threshold)).alias("threshold"), F.expr(s.n).cast("long").alias("sample_size"), (enough & F.coalesce(flag, F.lit(False))).alias("is_flagged"), F.when(enough, clamp01(value / s.threshold)).otherwise(0.0).alias("score"), F.when(enough, s.severity).otherwise("INFO").alias("severity"), F.when(enough, s.confidence).otherwise("LOW").alias("confidence"), (~enough).alias("insufficient_data")))
    return rules


def members(tree) -> list[str]:
    """Signal ids of a composite's tree."""
    return [x for part in tree[1:] for x in (members(part) if isinstance(part, tuple) else [part])]


def _holds(tree) -> Column:
    if isinstance(tree, str):
        return F.col("high_band") if tree == "high_band" else F.array_contains("fired", tree)
    out = _holds(tree[1])
    for part in tree[2:]:
        out = out & _holds(part) if tree[0] == "and" else out | _holds(part)
    return out


def _among(ids: list[str]):
    return lambda fact: fact.signal_id.isin(ids)


def composites(results: DataFrame, trees: dict = COMPOSITES, seed: int = 42) -> DataFrame:
    """SIG-F5: one result row for each entity and composite.

    The trees, passed in, are compiled to boolean columns. Severity is that of
    the gravest fired member, a step lower unless all fired; confidence is the
    weakest fired one's; LOW where none fired.
    """
    rank = F.array_position(F.array(*map(F.lit, SEVERITY_ORDER)), F.col("severity")) - 1
    sure = F.array_position(F.array(*map(F.lit, CONFIDENCE_ORDER)), F.col("confidence")) - 1
    fired = F.struct("signal_id", rank.cast("int").alias("rank"), sure.cast("int").alias("sure"))
    d = results.groupBy("entity_id").agg(F.bool_or("high_band").alias("high_band"), F.collect_list(F.when(F.col("is_flagged"), F.col("signal_id"))).alias("fired"), F.collect_list(F.when(F.col("is_flagged"), fired)).alias("facts"))
    rows = []
    for comp, (_, tree) in trees.items():
        ids = [m for m in members(tree) if m != "high_band"]
        mine = F.filter("facts", _among(ids))
        top = F.array_max(F.transform(mine, lambda x: x["rank"])) - F.when(F.size(mine) < len(ids), 1).otherwise(0)
        severity = F.when(F.size(mine) == 0, F.lit("LOW")).otherwise(F.element_at(F.array(*map(F.lit, SEVERITY_ORDER)), F.greatest(F.lit(0), top).cast("int") + 1))
        confidence = F.when(F.size(mine) == 0, F.lit("LOW")).otherwise(F.element_at(F.array(*map(F.lit, CONFIDENCE_ORDER)), F.array_min(F.transform(mine, lambda x: x["sure"])).cast("int") + 1))
        flag = _holds(tree)
        rows.append(F.struct(F.lit(comp).alias("signal_id"), flag.cast("double").alias("value"), F.lit(1.0).alias("threshold"), F.lit(len(ids)).cast("long").alias("sample_size"), flag.alias("is_flagged"), flag.cast("double").alias("score"), severity.alias("severity"), confidence.alias("confidence"), F.lit(False).alias("insufficient_data"), F.size(mine).alias("members_fired")))
    out = d.select("entity_id", "high_band", F.inline(F.array(*rows)))
    return out.withColumn("finding_id", finding_id(F.col("signal_id"), F.col("entity_id"), F.lit(""), seed))


def run_all(t, p: Params = DEFAULT) -> DataFrame:
    """SIG-F3: results of all signals and composites of all entities.

    t should be stored(): its tables are read many times. The inputs and the
    results are written too, a few rows an entity, as four groups of rules, the
    composites and what follows read them.
    """
    r = written(evaluate(written(metrics(t, p), "signal-inputs"), p=p), "signal-results")
    return written(r.unionByName(composites(r).drop("members_fired")), "results")
