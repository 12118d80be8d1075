"""Writing tables (SNK-01, SNK-04..12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_canonical(df: DataFrame, path: str) -> None:
    """SNK-01: parquet partitioned by entity; entities that df doesn't hold stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entity_id").parquet(path)


def upsert(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """SNK-04: old without the keys that new has, and new; to be written as the next version."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_findings_csv(findings: DataFrame, path: str, columns: list[str]) -> None:
    """SNK-05: sorted by finding_id, with a header."""
    findings.select(columns).orderBy("finding_id").write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK-06, SNK-10..12: JSON lines; append for adjudications."""
    df.write.mode(mode).json(path)


def review_history(history: DataFrame, run: DataFrame, keep: int = 10) -> DataFrame:
    """SNK-07: runs (run_id, seq, entity_id) with the new one, of which the latest keep stay."""
    every = history.unionByName(run)
    latest = every.select("run_id", "seq").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.desc("seq")))).filter(F.col("k") <= keep)  # one row a run
    return every.join(latest.select("run_id"), "run_id", "left_semi")


def write_results(results: DataFrame, path: str, run_id: str) -> None:
    """SNK-08, SNK-09: a run's rows in a partition of their own."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
