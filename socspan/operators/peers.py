"""Peer statistics and multiple-test correction (ENT-07..09, PEER-01..04).

Rows are (entity, metric): a few thousand times smaller than the event tables.
Peers of an entity are all others, or those of its cohort.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite, normal_pvalue
from ..params import DEFAULT, Params

PEER_METRICS = ["alert_count", "bypass_rate", "reopen_rate", "sla_breach_rate", "premature_rate", "template_similarity", "placeholder_ratio", "telemetry_gap_ratio", "escalation_rate", "case_duration_median", "ack_latency_median", "orphan_case_rate"]


def long_form(features: DataFrame, metrics: list[str]) -> DataFrame:
    """(entity_id, metric, value) of the named columns."""
    return features.select("entity_id", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))))


def peer_values(values: DataFrame, extra: Column | None = None) -> DataFrame:
    """PEER-04: each (entity, metric) with every other entity's value of that metric; extra narrows the pairs.

    Joined on metric, so rows grow with the square of entities only.
    """
    other = values.select("metric", F.col("entity_id").alias("peer_id"), finite(F.col("value")).alias("peer"), *(F.col(c).alias(f"peer_{c}") for c in values.columns if c not in ("entity_id", "metric", "value")))
    pairs = values.join(other, "metric").filter((F.col("entity_id") != F.col("peer_id")) & F.col("peer").isNotNull())
    return pairs if extra is None else pairs.filter(extra)


def _without_each(a: np.ndarray, at: np.ndarray, q: float) -> np.ndarray:
    """Quantile q of the sorted a without the element at each place; a place past the end leaves all in."""
    left = len(a) - (at < len(a)) - 1
    pos = q * left
    low, high = np.floor(pos).astype(int), np.ceil(pos).astype(int)
    x, y = (a[np.minimum(k + (k >= at), len(a) - 1)] for k in (low, high))
    return x + (y - x) * (pos - low)


def _left_out(table: pa.Table) -> pa.Table:
    """Statistics of a group's values without each entity's own.

    Ranks say where the own value lies among the sorted ones, so every order
    statistic of the others is an index. Leaving one out gives three medians
    at most; for each, the sorted deviations are indexed in the same way.
    """
    v = table.column("value").to_numpy(zero_copy_only=False).astype(float)
    mine = np.isfinite(v)
    a = np.sort(v[mine])
    at = np.full(len(v), len(a))
    at[np.flatnonzero(mine)[np.argsort(v[mine], kind="stable")]] = np.arange(len(a))
    n = len(a) - mine
    out = {"n_peers": n, "below": np.searchsorted(a, v)}
    out |= {k: np.full(len(v), np.nan) for k in ("median", "q25", "q75", "span", "mad")}
    some = n > 0
    if some.any():
        at = at[some]
        q = {k: _without_each(a, at, x) for k, x in (("median", 0.5), ("q25", 0.25), ("q75", 0.75), ("low", 0.0), ("high", 1.0))}
        mad = np.zeros(len(at))
        for m in np.unique(q["median"]):
            off = np.abs(a - m)
            order = np.argsort(off, kind="stable")
            place = np.full(len(a) + 1, len(a))
            place[order] = np.arange(len(a))
            here = q["median"] == m
            mad[here] = _without_each(off[order], place[at[here]], 0.5)
        for k, x in {"median": q["median"], "q25": q["q25"], "q75": q["q75"], "span": q["high"] - q["low"], "mad": mad}.items():
            out[k][some] = x
    names = [c for c in table.column_names if c != "value"]
    return pa.table({**{c: table.column(c) for c in names}, **{k: pa.array(x, pa.int64() if k in ("n_peers", "below") else pa.float64(), mask=None if k == "n_peers" else ~some) for k, x in out.items()}})


def left_out(values: DataFrame, *groups: str) -> DataFrame:
    """PEER-01, ENT-07: (groups, metric, entity_id, n_peers, below, median, q25, q75, span, mad) of the others' finite values.

    No pairs of entities are made: a group's values, one double an entity, are
    sorted once. A group without others has null statistics.
    """
    keys = [*groups, "metric"]
    rows = values.select(*keys, "entity_id", F.col("value").cast("double").alias("value"))
    out = T.StructType([*(f for f in rows.schema if f.name != "value"), *(T.StructField(c, T.LongType()) for c in ("n_peers", "below")), *(T.StructField(c, T.DoubleType()) for c in ("median", "q25", "q75", "span", "mad"))])
    return rows.groupBy(*keys).applyInArrow(_left_out, out)


def scored(stats: DataFrame) -> DataFrame:
    """stats with z and method of value among the others: by MAD, else IQR, else range, else 0."""
    x, iqr = F.col("value") - F.col("median"), F.col("q75") - F.col("q25")
    z = F.when(F.col("mad") > 0, 0.6745 * x / F.col("mad")).when(iqr > 0, 0.7413 * x / F.nullif(iqr, F.lit(0.0))).when(F.col("span") > 0, x / F.nullif(F.col("span"), F.lit(0.0))).otherwise(0.0)
    method = F.when(F.col("mad") > 0, "MAD").when(iqr > 0, "IQR").when(F.col("span") > 0, "RANGE").otherwise("SKIP")
    return stats.withColumns({"z": z, "method": method})


def modified_z(values: DataFrame) -> DataFrame:
    """PEER-01, ENT-07: z of each value (entity_id, metric, value) among those of all other entities."""
    keys = ["entity_id", "metric"]
    d = values.select(*keys, "value").join(left_out(values), keys)
    return scored(d).select(*keys, "value", "median", "mad", "n_peers", "z", "method")


def benjamini_hochberg(p_values: DataFrame, keys: list[str], tie: str = "metric") -> DataFrame:
    """ENT-08: rows (keys, metric, p) with p_adjusted, corrected within each group of keys."""
    w = Window.partitionBy(*keys)
    r = F.row_number().over(w.orderBy("p", tie))
    d = p_values.withColumn("_raw", F.col("p") * F.count(F.lit(1)).over(w) / r)
    up = w.orderBy("p", tie).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return d.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("_raw").over(up))).drop("_raw")


def peer_tests(features: DataFrame, metrics: list[str] = PEER_METRICS) -> DataFrame:
    """z, p and adjusted p of each entity's metrics among all other entities."""
    values = long_form(features, metrics)
    z = modified_z(values)
    return benjamini_hochberg(z.withColumn("p", normal_pvalue(F.col("z"))), ["entity_id"])


def cohorts(registry: DataFrame) -> DataFrame:
    """PEER-02: each entity's cohort; the first that lists it, GLOBAL if none does."""
    return registry.groupBy("entity_id").agg(F.coalesce(F.min("cohort_id"), F.lit("GLOBAL")).alias("cohort_id"))


def cohort_sizes(registry: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """PEER-03, SCR-08: (entity_id, cohort_n, fell_back): the others in each entity's cohort, and whether they are too few to compare with."""
    d = cohorts(registry)
    n = d.groupBy("cohort_id").agg((F.count(F.lit(1)) - 1).alias("cohort_n"))
    return d.join(n, "cohort_id").select("entity_id", "cohort_n", (F.col("cohort_n") < p.cohort_min).alias("fell_back"))


def benchmark(features: DataFrame, registry: DataFrame, metrics: list[str], p: Params = DEFAULT) -> DataFrame:
    """PEER-03: z and percentile rank among the cohort, or among all entities (with a confidence penalty) where it has too few others."""
    values = long_form(features, metrics).join(cohorts(registry), "entity_id", "left").withColumn("cohort_id", F.coalesce("cohort_id", F.lit("GLOBAL")))
    keys, facts = ["entity_id", "metric"], ["n_peers", "below", "median", "q25", "q75", "span", "mad"]
    near = left_out(values, "cohort_id").select(*keys, F.struct(*facts).alias("near"))
    far = left_out(values).select(*keys, F.struct(*facts).alias("far"))
    enough = F.col("near.n_peers") >= p.cohort_min
    d = values.join(near, keys).join(far, keys).withColumn("s", F.when(enough, F.col("near")).otherwise(F.col("far")))
    n = F.col("near.n_peers")
    penalty = F.when(enough, 0.0).when(n <= 1, p.cohort_penalty_most).otherwise(p.cohort_penalty)
    d = scored(d.select(*keys, "value", "s.*", n.alias("cohort_n"), (~enough).alias("fell_back"), penalty.alias("penalty")))
    return d.select(*keys, "value", "median", "z", "method", "cohort_n", "fell_back", "penalty", F.coalesce(F.col("below") / F.col("n_peers"), F.lit(0.0)).alias("percentile_rank"))
