"""Tables behind reports and read queries (RPT-01, RPT-05..13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import minutes_between


def findings_table(results: DataFrame, bundles: DataFrame, counterfactuals: DataFrame) -> DataFrame:
    """RPT-01, RPT-10: flagged findings with evidence id and clearing value."""
    return results.filter("is_flagged").join(bundles.select("finding_id", "evidence_id", F.size("supporting").alias("n_supporting")), "finding_id").join(counterfactuals.select("finding_id", "clearing_value"), "finding_id")


def heatmap(results: DataFrame, signal_ids: list[str]) -> DataFrame:
    """RPT-07: a column of scores for each signal, a row for each entity."""
    return results.groupBy("entity_id").pivot("signal_id", signal_ids).agg(F.first("score"))


def latency_histogram(cases: DataFrame) -> DataFrame:
    """RPT-08: min(20, max(5, n / 5)) equal bins of an entity's case durations, and counts of those that hold any."""
    d = cases.select("entity_id", minutes_between(F.col("open_ts"), F.col("close_ts")).alias("x")).filter("x >= 0")
    s = d.groupBy("entity_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.count(F.lit(1)) / 5))).alias("bins"))
    width = F.nullif((F.col("hi") - F.col("lo")) / F.col("bins"), F.lit(0.0))
    at = F.least(F.col("bins") - 1, F.coalesce(F.floor((F.col("x") - F.col("lo")) / width), F.lit(0)))
    return d.join(s, "entity_id").groupBy("entity_id", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def select_rows(rows: DataFrame, order: list[str], limit: int | None = None, **equal) -> DataFrame:
    """RPT-05, RPT-09..13: rows whose columns equal the given values, in order; the first limit of them where one is asked for."""
    for c, v in equal.items():
        rows = rows.filter(F.col(c) == v)
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)
