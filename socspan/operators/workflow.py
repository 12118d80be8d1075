"""Workflow rates, orphans, duplicate chains and backfill (WFL-01..09), and entity rates (ENT-01..05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import minutes_between, share
from ..functions.tables import written
from ..params import DEFAULT, SEVERITIES, TIERS, Params


def with_escalated(cases: DataFrame, escalations: DataFrame) -> DataFrame:
    """cases with escalated: whether any escalation names the case."""
    e = escalations.select("entity_id", "case_id", F.lit(True).alias("escalated")).distinct()
    return cases.join(e, ["entity_id", "case_id"], "left").withColumn("escalated", F.coalesce("escalated", F.lit(False)))


def escalation_rates(cases: DataFrame, escalations: DataFrame) -> DataFrame:
    """WFL-01: share of distinct cases escalated, by entity and severity (null is a group)."""
    c = with_escalated(cases, escalations)
    return c.groupBy("entity_id", "severity_norm").agg((F.count_distinct(F.when(F.col("escalated"), F.col("case_id"))) / F.count_distinct("case_id")).alias("rate"))


def bypass_rate(cases: DataFrame, escalations: DataFrame) -> DataFrame:
    """WFL-02: share of CRITICAL cases that were never escalated."""
    c = with_escalated(cases, escalations)
    return c.groupBy("entity_id").agg(share(~F.col("escalated"), F.col("severity_norm") == "CRITICAL").alias("bypass_rate"))


def tier_dwell(cases: DataFrame) -> DataFrame:
    """WFL-03: mean minutes from open to close, a column for each tier; 0 where there is none."""
    dwell = minutes_between(F.col("open_ts"), F.col("close_ts"))
    return cases.groupBy("entity_id").agg(*(F.coalesce(F.avg(F.when(F.col("tier") == t, dwell)), F.lit(0.0)).alias(f"tier_dwell_{t}") for t in TIERS))


def reopen_rate(cases: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """WFL-04: share of cases reopened p.reopens times or more."""
    return cases.groupBy("entity_id").agg(share(F.col("reopen_count") >= p.reopens).alias("reopen_rate"))


def duplicate_depth(cases: DataFrame) -> DataFrame:
    """WFL-05: cases on the longest chain of is_duplicate_of, by entity; 0 where no case is a duplicate.

    Links are followed by doubling: after k rounds each case knows its
    ancestor and the number of links within 2^k steps. Chains that run into a
    cycle count as long as all links at most, and end where they leave the
    table. Rounds stop once none grows, or after the logarithm of the links;
    only cases that take part in a link are moved. Each round is written, so
    its lineage doesn't double.
    """
    link = cases.filter("is_duplicate_of is not null and is_duplicate_of <> case_id").select("entity_id", "case_id", F.col("is_duplicate_of").alias("to"))
    jump = written(link.groupBy("entity_id", "case_id").agg(F.min("to").alias("to")).withColumn("depth", F.lit(1)), "chains")
    n = jump.count()
    for _ in range(n.bit_length()):
        ahead = jump.select("entity_id", F.col("case_id").alias("to"), F.col("to").alias("then"), F.col("depth").alias("more"))
        j = jump.join(ahead, ["entity_id", "to"], "left")
        jump = j.select("entity_id", "case_id", F.coalesce("then", "to").alias("to"), F.least(F.col("depth") + F.coalesce("more", F.lit(0)), F.lit(n)).alias("depth"), F.col("then").isNotNull().alias("grew"))
        jump = written(jump, "chains")
        if jump.filter("grew").isEmpty():
            break
        jump = jump.drop("grew")
    return jump.groupBy("entity_id").agg((F.max("depth") + 1).alias("depth"))


def orphan_cases(cases: DataFrame) -> DataFrame:
    """WFL-06: cases that name no alert."""
    return cases.filter(F.coalesce(F.size("alert_ids"), F.lit(0)) <= 0)


def orphan_alerts(alerts: DataFrame, cases: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """WFL-07: alerts that no case names and that are older than p.orphan_hours; a missing time counts as old."""
    named = cases.select("entity_id", F.explode("alert_ids").alias("alert_id")).distinct()
    age = minutes_between(F.col("detected_ts"), F.lit(p.alerts_as_of).cast("timestamp"))
    return alerts.join(named, ["entity_id", "alert_id"], "left_anti").filter(F.coalesce(age > p.orphan_hours * 60, F.lit(True)))


def is_backfilled(event: str = "detected_ts", p: Params = DEFAULT) -> Column:
    """Whether a row came in more than p.backfill_days after its event."""
    return F.coalesce(minutes_between(F.col(event), F.col("ingest_ts")) > p.backfill_days * 1440, F.lit(False))


def backfilled(rows: DataFrame, event: str = "detected_ts", p: Params = DEFAULT) -> DataFrame:
    """WFL-08: rows that came in more than p.backfill_days after their event."""
    return rows.filter(is_backfilled(event, p))


def _hours() -> Column:
    return minutes_between(F.col("open_ts"), F.col("close_ts")) / 60


def is_night(ts: str, p: Params = DEFAULT) -> Column:
    return (F.hour(ts) >= p.night_start) | (F.hour(ts) < p.night_end)


def case_rates(cases: DataFrame, escalations: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One pass over cases for all rates and counts by entity (WFL-02..04, 06; ENT-01..05 parts; inputs of the EG signals)."""
    c = with_escalated(cases, escalations)
    closed, crit = F.col("close_ts").isNotNull(), F.col("severity_norm") == "CRITICAL"
    minutes = minutes_between(F.col("open_ts"), F.col("close_ts"))
    early = (minutes >= 0) & (minutes < p.premature_minutes)
    met = F.when(_hours() >= 0, _hours())
    return c.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count_if(closed).alias("n_closed"),
        F.count_if(crit).alias("n_critical"),
        F.count_if(crit & closed).alias("n_critical_closed"),
        share(early, crit & closed).alias("premature_rate"),
        share(F.col("reopen_count") >= p.reopens).alias("reopen_rate"),
        share(~F.col("escalated"), crit).alias("bypass_rate"),
        share(_hours() > p.sla_hours, closed).alias("sla_breach_rate"),
        share(is_night("close_ts", p), closed).alias("night_fraction"),
        share(F.weekday("detected_ts") >= 5, F.col("detected_ts").isNotNull()).alias("weekend_fraction"),
        share(F.size("alert_ids") <= 0).alias("orphan_case_rate"),
        share(F.col("disposition_code") == "DUPLICATE").alias("duplicate_share"),
        share(F.col("status") == "CLOSED").alias("closure_rate"),
        share(F.col("disposition_code") == "TRUE_POSITIVE").alias("root_cause_rate"),
        share(met <= p.sla_hours, met.isNotNull()).alias("sla_met"),
        F.avg(met).alias("mean_hours"),
        F.stddev_samp(met).alias("std_hours"),
        *(F.coalesce(F.avg(F.when(F.col("tier") == t, minutes)), F.lit(0.0)).alias(f"tier_dwell_{t}") for t in TIERS),
        *(share(F.col("severity_norm") == s).alias(f"case_share_{s}") for s in SEVERITIES),
    )


def workflow_summary(cases: DataFrame, escalations: DataFrame, alerts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """WFL-09: rates of WFL-01..08 by entity."""
    rates = case_rates(cases, escalations, p).select("entity_id", "bypass_rate", "reopen_rate", "orphan_case_rate", *(f"tier_dwell_{t}" for t in TIERS))
    esc = escalation_rates(cases, escalations).groupBy("entity_id").agg(F.avg("rate").alias("escalation_rate"))
    total = alerts.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), share(is_backfilled(p=p)).alias("backfill_rate"))
    lost = orphan_alerts(alerts, cases, p).groupBy("entity_id").agg(F.count(F.lit(1)).alias("lost"))
    chain = duplicate_depth(cases)
    d = rates.join(esc, "entity_id", "left").join(total, "entity_id", "left").join(lost, "entity_id", "left").join(chain, "entity_id", "left")
    return d.select("entity_id", "escalation_rate", "bypass_rate", "reopen_rate", "orphan_case_rate", *(f"tier_dwell_{t}" for t in TIERS), F.coalesce(F.col("depth"), F.lit(0)).alias("duplicate_chain_depth"), F.coalesce(F.col("lost") / F.col("n"), F.lit(0.0)).alias("orphan_alert_rate"), F.coalesce("backfill_rate", F.lit(0.0)).alias("backfill_rate"))
