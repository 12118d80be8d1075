"""Temporal features: latencies, durations, bursts, time-of-day profiles (TMP-01..05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import minutes_between, safe_mean, safe_median, safe_p90
from ..params import DEFAULT, Params

LATENCIES = ["ack_latency", "triage_duration", "investigation_duration", "total_dwell", "close_latency_after_ack"]


def _minutes(start: str, end: str):
    m = minutes_between(F.col(start), F.col(end))
    return F.when(m >= 0, m)


def alert_latencies(alerts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """TMP-01: latencies in minutes, negative ones null; rows in the future are flagged and have no ack_latency or total_dwell.

    close_ts and triage times may be missing from a feed; they count as null.
    """
    for c in ("close_ts", "triage_start_ts", "triage_end_ts"):
        if c not in alerts.columns:
            alerts = alerts.withColumn(c, F.lit(None).cast("timestamp"))
    limit = F.lit(p.alerts_as_of).cast("timestamp") + F.expr(f"interval {p.future_seconds} seconds")
    late = F.coalesce(F.greatest("detected_ts", "ack_ts", "close_ts") > limit, F.lit(False))
    triage = _minutes("triage_start_ts", "triage_end_ts")
    return alerts.withColumns({
        "is_future": late,
        "ack_latency": F.when(~late, _minutes("detected_ts", "ack_ts")),
        "triage_duration": triage,
        "investigation_duration": triage,
        "total_dwell": F.when(~late, _minutes("detected_ts", "close_ts")),
        "close_latency_after_ack": _minutes("ack_ts", "close_ts"),
    })


def case_durations(cases: DataFrame) -> DataFrame:
    """TMP-02: minutes from open to close, and the reopen gap: reopens times the entity's median duration."""
    d = cases.withColumn("case_duration", _minutes("open_ts", "close_ts"))
    middle = d.groupBy("entity_id").agg(safe_median(F.col("case_duration")).alias("_middle"))
    gap = F.when(F.col("reopen_count") > 0, F.col("reopen_count") * F.col("_middle"))
    return d.join(middle, "entity_id").withColumn("reopen_gap", gap).drop("_middle")


def bursts(cases: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """TMP-03: bursts of burst_count closures of one analyst and disposition within burst_seconds.

    A burst is told as soon as the window holds that many closures; the count
    then starts anew, so its size always is burst_count. Whether the window of
    a closure is full depends on the burst before it, so candidates (closures
    whose burst_count-th predecessor is near enough) are found by a window, and
    a fold over each group's candidate positions, which are few, picks those
    that don't overlap. max_window_count has the largest window of the group.
    """
    keys = ["entity_id", "analyst_id", "disposition_code"]
    closed = cases.filter("close_ts is not null").select("entity_id", F.coalesce("analyst_id", F.lit("UNKNOWN")).alias("analyst_id"), F.coalesce("disposition_code", F.lit("UNKNOWN")).alias("disposition_code"), "case_id", "close_ts")
    w = Window.partitionBy(*keys).orderBy("close_ts", "case_id")
    second = F.unix_micros("close_ts") / F.lit(1e6)
    near = Window.partitionBy(*keys).orderBy(F.unix_micros("close_ts")).rangeBetween(-p.burst_seconds * 1_000_000, 0)
    d = closed.withColumns({"k": F.row_number().over(w), "start": F.lag("close_ts", p.burst_count - 1).over(w), "window_count": F.count(F.lit(1)).over(near)})
    most = d.groupBy(*keys).agg(F.max("window_count").alias("max_window_count"))
    full = d.filter((second - F.unix_micros("start") / F.lit(1e6)) <= p.burst_seconds)
    folded = full.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "start", F.col("close_ts").alias("end")))).alias("c"))
    pick = f"""aggregate(c, named_struct('last', 0, 'out', cast(array() as array<struct<k:int, start:timestamp, end:timestamp>>)),
        (a, x) -> if(x.k - {p.burst_count} >= a.last, named_struct('last', x.k, 'out', concat(a.out, array(x))), a), a -> a.out)"""
    out = folded.select(*keys, F.inline(F.expr(pick))).join(most, keys)
    return out.select(*keys, F.lit(p.burst_count).alias("burst_size"), (minutes_between(F.col("start"), F.col("end")) * 60).alias("burst_duration"), F.col("start").alias("window_start"), "max_window_count")


def time_profile(events: DataFrame, ts: str = "close_ts", by: list[str] | None = None) -> DataFrame:
    """TMP-04: shares of events by hour and by weekday (Monday is 0), in long form (part, bin, share)."""
    keys = by or ["entity_id"]
    e = events.filter(F.col(ts).isNotNull()).select(*keys, F.inline(F.array(F.struct(F.lit("hour").alias("part"), F.hour(ts).alias("bin")), F.struct(F.lit("weekday").alias("part"), F.weekday(ts).alias("bin")))))
    n = e.groupBy(*keys, "part", "bin").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy(*keys, "part")
    return n.select(*keys, "part", "bin", (F.col("n") / F.sum("n").over(total)).alias("share"))


def latency_summary(featured: DataFrame, columns: list[str]) -> DataFrame:
    """TMP-05: mean, median and 90th percentile of latency columns by entity."""
    return featured.groupBy("entity_id").agg(*(f(F.col(c)).alias(f"{c}_{name}") for c in columns for name, f in (("mean", safe_mean), ("median", safe_median), ("p90", safe_p90))))
