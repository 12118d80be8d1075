"""Evidence, reasons, counterfactuals and narrative checks (EXP-01..13)."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import evidence_id, minutes_between
from ..params import DEFAULT, TACTICS, Params
from .coverage import daily_alerts, detrended, is_critical, is_facing, negative_space
from .peers import left_out
from .signals import COMPOSITES, SIGNALS, members
from .workflow import is_backfilled, is_night, with_escalated

ROWS = 5
PRESCRIPTIVE = r"(?i)\b(must|should|immediately|terminate|punish|fire the)\b"
PERSONAL = r"(?i)[\w.+-]+@[\w-]+\.[\w.]+|\b\d{1,3}(\.\d{1,3}){3}\b|\+?\d[\d -]{8,}\d"


class Rule(NamedTuple):
    """Which rows of a table speak for a signal and which against it: SQL conditions that read facts(); rows outside `among` do neither."""

    signal_id: str
    table: str
    supports: str
    among: str = "true"
    counters: str = ""  # by default what is among and doesn't support


_CLOSED, _CRITICAL = "close_ts is not null", "severity_norm = 'CRITICAL'"
#: Beside the conditions of SIGNALS. Conditions are plain SQL, so that they can be checked in another engine.
RULES = [
    Rule("EG-001", "cases", "minutes >= 0 and minutes < 5", f"{_CRITICAL} and {_CLOSED}"),
    Rule("EG-002", "cases", "reopen_count >= 2"),
    Rule("EG-003", "cases", "not escalated", _CRITICAL),
    Rule("EG-004", "alerts", _CRITICAL, _CRITICAL),
    Rule("EG-004", "cases", "false", _CRITICAL),
    Rule("EG-005", "cases", "minutes > 72 * 60", _CLOSED),
    Rule("EG-006", "cases", "burst_end", _CLOSED),
    Rule("EG-007", "cases", _CLOSED, _CLOSED),
    Rule("EG-008", "cases", "night", _CLOSED),
    Rule("EG-009", "alerts", "late"),
    Rule("EG-010", "investigations", "notes is not null", "notes is not null"),
    Rule("EG-011", "cases", "disposition_code = 'DUPLICATE' or is_duplicate_of is not null"),
    Rule("EG-012", "cases", "not has_alert"),
    Rule("EG-013", "cases", "minutes >= 0 and minutes <= 72 * 60", _CLOSED),
    Rule("EG-014", "escalations", "nowhere"),
    Rule("NS-001", "space", "gap_flag", "critical"),
    Rule("NS-002", "space", "gap_flag"),
    Rule("NS-003", "alerts", "false"),
    Rule("NS-004", "alerts", "false", f"category in ({', '.join(repr(c) for c in TACTICS)})"),
    Rule("NS-005", "space", "gap_flag"),
    Rule("NS-006", "assets", "blind", "facing"),
    Rule("NS-007", "days", "residual < 0", "back <= 7"),
    Rule("NS-008", "assets", "silent", "facing"),
    Rule("NS-009", "space", "gap_flag", "critical"),
    Rule("NS-010", "assets", "silent", "critical"),
    Rule("NS-011", "cases", "not night", _CLOSED),
    Rule("NS-012", "feed", "back = 1", "back <= 4"),
]
#: Id and shown columns of the tables that rules read.
SHOWN = {
    "cases": ("case_id", ["case_id", "severity_norm", "status", "reopen_count"]), "alerts": ("alert_id", ["alert_id", "severity_norm", "status", "category"]), "investigations": ("investigation_id", ["investigation_id", "case_id"]),
    "escalations": ("escalation_id", ["escalation_id", "case_id", "from_tier", "to_tier"]), "assets": ("asset_id", ["asset_id", "criticality", "internet_facing"]), "space": ("row_id", ["asset_id", "expected_source", "gap_flag"]),
    "days": ("row_id", ["day", "cnt"]), "feed": ("row_id", ["window_start", "cnt"]),
}


def facts(t, p: Params = DEFAULT) -> dict[str, DataFrame]:
    """The tables that rules read, with what their conditions need."""
    w = Window.partitionBy("entity_id", F.coalesce("analyst_id", F.lit("UNKNOWN")), F.coalesce("disposition_code", F.lit("UNKNOWN"))).orderBy("close_ts", "case_id")
    cases = with_escalated(t.cases, t.escalations).withColumns({"minutes": minutes_between(F.col("open_ts"), F.col("close_ts")), "night": F.coalesce(is_night("close_ts", p), F.lit(False)), "has_alert": F.size("alert_ids") > 0})
    ended = t.cases.filter("close_ts is not null").withColumn("from", F.lag("close_ts", p.burst_count - 1).over(w)).filter(minutes_between(F.col("from"), F.col("close_ts")) * 60 <= p.burst_seconds)
    cases = cases.join(ended.select("entity_id", "case_id", F.lit(True).alias("burst_end")).distinct(), ["entity_id", "case_id"], "left").na.fill(False, ["burst_end"])
    c = t.cases.select("entity_id", "case_id", F.col("status").alias("_status"), F.col("tier").alias("_tier"))
    nowhere = F.col("accepted_ts").isNull() & (F.col("_status") == "CLOSED") & (F.col("_tier") == F.col("from_tier"))
    alerted = t.alerts.filter("asset_id is not null").select("entity_id", "asset_id", F.lit(False).alias("silent")).distinct()
    seen = t.telemetry.filter(F.col("source").isin("firewall", "ids")).select("entity_id", "asset_id", F.lit(False).alias("blind")).distinct()
    assets = t.assets.join(alerted, ["entity_id", "asset_id"], "left").join(seen, ["entity_id", "asset_id"], "left").na.fill(True, ["silent", "blind"]).withColumns({"critical": is_critical(), "facing": is_facing()})
    days = detrended(daily_alerts(t.alerts), p).withColumns({"back": F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("day"))), "row_id": F.col("day").cast("string")})
    feed = t.alerts.filter("detected_ts is not null").groupBy("entity_id", F.window("detected_ts", f"{p.window_days} days").start.cast("date").alias("window_start")).agg(F.count(F.lit(1)).alias("cnt"))
    return {
        "cases": cases, "alerts": t.alerts.withColumn("late", is_backfilled(p=p)), "investigations": t.investigations,
        "escalations": t.escalations.join(c, ["entity_id", "case_id"], "left").withColumn("nowhere", F.coalesce(nowhere, F.lit(False))), "assets": assets,
        "space": negative_space(t.assets, t.telemetry, p).withColumn("row_id", F.concat_ws("/", "asset_id", "expected_source")), "days": days,
        "feed": feed.withColumns({"back": F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("window_start"))), "row_id": F.col("window_start").cast("string")}),
    }


def evidence_rows(t, p: Params = DEFAULT, rules: list[Rule] = RULES) -> DataFrame:
    """EXP-01: (entity_id, signal_id, side, row_id, row_json): the first ROWS rows for and against each signal, by id.

    Each table is passed once: a row has a bit for each signal and side it
    belongs to. The first ROWS rows of a side are among the first ROWS of each
    set of bits, so rows are cut down by entity and set before they are repeated
    for their sides. Windows keep no more than ROWS rows of a group on each task
    before the exchange (Catalyst's window group limit), so a hot entity isn't
    moved.
    """
    have, out = facts(t, p), None
    for table in dict.fromkeys(r.table for r in rules):
        key, shown = SHOWN[table]
        sides, names = [], []
        for r in (r for r in rules if r.table == table):
            among, supports = F.coalesce(F.expr(r.among), F.lit(False)), F.coalesce(F.expr(r.supports), F.lit(False))
            against = F.coalesce(F.expr(r.counters), F.lit(False)) if r.counters else ~supports
            sides += [among & supports, among & against]
            names += [(r.signal_id, "supports"), (r.signal_id, "counters")]
        bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(c, F.lit(1 << i)).otherwise(0).cast("long") for i, c in enumerate(sides)))
        d = have[table].select("entity_id", F.col(key).cast("string").alias("row_id"), F.to_json(F.struct(*shown)).alias("row_json"), bits.alias("bits")).filter("bits <> 0")
        d = d.withColumn("k", F.row_number().over(Window.partitionBy("bits", "entity_id").orderBy("row_id", "row_json"))).filter(F.col("k") <= ROWS)
        of = [F.when(F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.struct(F.lit(s).alias("signal_id"), F.lit(side).alias("side"))) for i, (s, side) in enumerate(names)]
        d = d.select("entity_id", "row_id", "row_json", F.inline(F.array_compact(F.array(*of))))
        d = d.withColumn("k", F.row_number().over(Window.partitionBy("entity_id", "signal_id", "side").orderBy("row_id", "row_json"))).filter(F.col("k") <= ROWS).drop("k")
        out = d if out is None else out.unionByName(d)
    return out


def comparison(results: DataFrame) -> DataFrame:
    """EXP-02: (entity_id, signal_id, cohort): how the value stands among all other entities: their number, median, and the share below it."""
    stats = left_out(results.select("entity_id", F.col("signal_id").alias("metric"), "value"))
    return stats.select("entity_id", F.col("metric").alias("signal_id"), F.struct("n_peers", "median", (F.col("below") / F.nullif("n_peers", F.lit(0))).alias("share_below")).alias("cohort"))


def bundles(results: DataFrame, rows: DataFrame) -> DataFrame:
    """EXP-02, EXP-03: a bundle for each finding: rows for and against it, the reason where there are none, its cohort comparison, and a stable id.

    A composite has the fired members of its tree for it and the others
    against it. The id is that of the supporting rows.
    """
    names = F.array(*(F.struct(F.lit(c).alias("composite"), F.lit(m).alias("member")) for c, (_, tree) in COMPOSITES.items() for m in members(tree) if m != "high_band"))
    parts = results.select("entity_id", "signal_id", "is_flagged", "score", F.inline(names)).filter("signal_id = member")
    parts = parts.select("entity_id", F.col("composite").alias("signal_id"), F.when(F.col("is_flagged"), "supports").otherwise("counters").alias("side"), F.col("member").alias("row_id"), F.to_json(F.struct("member", "is_flagged")).alias("row_json"))
    pick = lambda side, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("row_id", "row_json")))), lambda x: x[c])
    b = rows.unionByName(parts).groupBy("entity_id", "signal_id").agg(pick("supports", "row_json").alias("supporting"), pick("counters", "row_json").alias("counter"), pick("supports", "row_id").alias("ids"))
    d = results.join(b, ["entity_id", "signal_id"], "left").join(comparison(results), ["entity_id", "signal_id"], "left")
    none = F.array().cast("array<string>")
    side = lambda c: F.coalesce(c, none)
    return d.select(
        "finding_id", "entity_id", "signal_id", side("supporting").alias("supporting"), side("counter").alias("counter"),
        F.when(F.size(side("supporting")) == 0, F.when(F.col("insufficient_data"), "not enough rows").otherwise("no row supports this signal")).alias("absent_reason"),
        F.when(F.size(side("counter")) == 0, "no counter-examples in window").alias("counter_none_reason"), "cohort", side("ids").alias("row_ids"), evidence_id(side("ids")).alias("evidence_id"),
    )


def reasons(results: DataFrame) -> DataFrame:
    """EXP-05: code, label and sentence of each finding."""
    names = F.create_map(*(F.lit(x) for s in SIGNALS for x in (s.id, s.name)), *(F.lit(x) for c, (n, _) in COMPOSITES.items() for x in (c, n)))
    text = F.format_string("%s: observed %.4f against a threshold of %.4f over %d rows", names[F.col("signal_id")], "value", "threshold", "sample_size")
    return results.select("finding_id", "entity_id", "signal_id", F.concat(F.lit("RC-"), "signal_id").alias("code"), names[F.col("signal_id")].alias("label"), F.when(F.col("insufficient_data"), F.lit("not enough data")).otherwise(text).alias("sentence"))


def find_finding(results: DataFrame, finding: str) -> DataFrame:
    """EXP-04: the result with this finding_id; raises KeyError where there is none."""
    found = results.filter(F.col("finding_id") == finding)
    if found.isEmpty():
        raise KeyError(f"finding not found: {finding}")
    return found


def explain(results: DataFrame, bundle: DataFrame, confidence: DataFrame, ledger: DataFrame) -> DataFrame:
    """EXP-12: reason, evidence, counterfactual, confidence and ledger entry of each given finding, one row each.

    confidence has a row for each entity (confidence, confidence_reason);
    ledger entries name their finding in payload_json. What isn't there is
    null; of more entries for a finding the first counts.
    """
    seq = ledger.groupBy(F.get_json_object("payload_json", "$.finding_id").alias("finding_id")).agg(F.min("seq").alias("audit_seq"), F.min_by("entry_hash", "seq").alias("audit_hash"))
    d = reasons(results).join(bundle.drop("entity_id", "signal_id"), "finding_id", "left").join(counterfactuals(results).select("finding_id", "clearing_value", F.col("reason").alias("no_clearing")), "finding_id", "left")
    return d.join(confidence.select("entity_id", "confidence", "confidence_reason"), "entity_id", "left").join(seq, "finding_id", "left")


def composite_members(results: DataFrame) -> DataFrame:
    """EXP-06, EXP-13: members of each composite by entity, fired and not."""
    ids = F.array(*(F.struct(F.lit(c).alias("composite"), F.lit(m).alias("member")) for c, (_, t) in COMPOSITES.items() for m in members(t) if m != "high_band"))
    d = results.select("entity_id", "signal_id", "is_flagged", F.inline(ids)).filter("signal_id = member")
    return d.groupBy("entity_id", "composite").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("is_flagged"), F.col("member")))), ",").alias("fired"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("is_flagged"), F.col("member")))), ",").alias("counter"))


def counterfactuals(results: DataFrame) -> DataFrame:
    """EXP-08: the value at which a finding would clear, just under its threshold; a reason where there is none."""
    no = F.when(F.col("insufficient_data"), "insufficient data").when(~F.col("is_flagged"), "not firing").when(~F.col("signal_id").startswith("EG-"), "not a single measure")
    value = F.col("threshold") - F.greatest(F.abs(F.col("threshold")), F.lit(1.0)) * 1e-6
    return results.select("finding_id", "entity_id", "signal_id", F.when(no.isNull(), value).alias("clearing_value"), no.alias("reason"))


FIELDS = ["rationale", "what_we_observed", "why_it_matters", "peer_context", "confidence_statement", "suggested_review_focus"]


def narratives(results: DataFrame, bundle: DataFrame, seed: int = 42) -> DataFrame:
    """EXP-10: the six FIELDS of each flagged finding from templates, never empty; narrative joins them.

    Two supporting rows are cited where there are as many. The hedge word goes
    by a hash of signal and seed, so equal findings read alike in every run.
    """
    even = F.conv(F.substring(F.sha2(F.concat_ws("|", "signal_id", F.lit(str(seed))), 256), 64, 1), 16, 10).cast("int") % 2 == 0
    hedge = F.when(even, "may point to").otherwise("could stem from")
    cited = F.when(F.size("row_ids") >= 2, F.concat_ws(" and ", F.slice("row_ids", 1, 2))).otherwise(F.lit("the rows of its evidence"))
    peers = F.when(F.coalesce(F.col("cohort.n_peers"), F.lit(0)) > 0, F.format_string("Among %d other entities the median is %.3f, and %.0f %% of them lie lower; local circumstances may explain a difference.", "cohort.n_peers", "cohort.median", F.col("cohort.share_below") * 100)).otherwise(F.lit("There are no other entities to set this beside."))
    d = results.filter("is_flagged").join(bundle.select("finding_id", "row_ids", "cohort"), "finding_id")
    text = {
        "rationale": F.format_string("%s fired for %s, for example in %s. This %s a gap in the process, and chance isn't ruled out.", "signal_id", "entity_id", cited, hedge),
        "what_we_observed": F.format_string("The measure is %.3f where up to %.3f is expected, over %d records.", "value", "threshold", "sample_size"),
        "why_it_matters": F.when(F.col("signal_id").startswith("NS-"), "What isn't recorded isn't looked at, so a silent source can hide real activity.").when(F.col("signal_id").startswith("COMP-"), "Several measures point the same way, which a single slip seldom explains.").otherwise("Work that is only formally done leaves risk open that the figures no longer show."),
        "peer_context": peers,
        "confidence_statement": F.format_string("Confidence in this is %s with %d records; more of them would make it firmer.", F.lower("confidence"), "sample_size"),
        "suggested_review_focus": F.format_string("Which of the steps behind %s were taken, and does the record show all of them?", cited),
    }
    d = d.select("finding_id", "entity_id", "signal_id", *(v.alias(k) for k, v in text.items()))
    return d.withColumn("narrative", F.concat_ws(" ", *FIELDS))


#: Identifiers as submissions write them.
IDENTIFIER = r"\b(?:cse_[a-z0-9_]+|CSE_[A-Z0-9_]+|a\d+|c\d+|i\d+|e\d+|asset\d+)\b"


def guard_cited(texts: DataFrame, bundle: DataFrame, most: int = 4000) -> DataFrame:
    """EXP-11: (finding_id, failed): the first check that a finding's text fails against its own evidence, null where it passes.

    An identifier that no row of the evidence has; personal data that the
    evidence doesn't have either, prescriptive phrases and length as in guard();
    fewer than two of the supporting rows cited, where there are two. A finding
    without a bundle has no evidence, a null text counts as empty.
    """
    none = F.array().cast("array<string>")
    d = texts.select("finding_id", F.coalesce("text", F.lit("")).alias("t")).join(bundle.select("finding_id", F.coalesce("row_ids", none).alias("ids"), F.concat_ws(" ", "supporting", "counter").alias("ev")), "finding_id", "left")
    d = d.withColumns({"ids": F.coalesce("ids", none), "ev": F.coalesce("ev", F.lit(""))})
    unknown = lambda pattern: F.exists(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)), lambda x: ~F.contains(F.col("ev"), x))
    cited = F.size(F.filter("ids", lambda x: F.contains(F.col("t"), x)))
    why = F.coalesce(F.when(unknown(IDENTIFIER), F.lit("unknown identifier")), F.when(unknown(PERSONAL), F.lit("personal data")), F.when(F.col("t").rlike(PRESCRIPTIVE), F.lit("prescriptive")), F.when(F.length("t") > most, F.lit("too long")), F.when((F.size("ids") >= 2) & (cited < 2), F.lit("fewer than two rows cited")))
    return d.select("finding_id", why.alias("failed"))


def guard(texts: DataFrame, id_col: str, text_col: str = "text", most: int = 4000) -> DataFrame:
    """EXP-11: first check that a text fails: personal data, prescriptive phrases, length; null where it passes."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    why = F.coalesce(F.when(t.rlike(PERSONAL), F.lit("personal data")), F.when(t.rlike(PRESCRIPTIVE), F.lit("prescriptive")), F.when(F.length(t) > most, F.lit("too long")))
    return texts.select(id_col, why.alias("failed"))
