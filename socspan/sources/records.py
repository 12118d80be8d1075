"""Readers of the tables beside the canonical six: entities, labels, quarantine, reviews, ledger, verdicts (SRC-05, SRC-09..11, SRC-17..20)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "run_id string, seq long, ts string, event_type string, payload_json string, prev_hash string, entry_hash string"
VERDICTS = "disagreement_id string, verdict string, reviewer_id string, comment string, adjudicated_at string"
REVIEWS = "runs array<struct<run_id:string,queue:array<struct<entity_id:string,signal_id:string>>>>, last_reviewed map<string,string>"


def _json_or_empty(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """JSON at path by schema; no rows where the path doesn't exist. Any other failure is raised."""
    try:
        return spark.read.schema(schema).options(**options).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def entities(registry: DataFrame, alerts: DataFrame) -> DataFrame:
    """SRC-09: entity_id of registered entities that sent alerts, each once."""
    return registry.select("entity_id").distinct().join(alerts.select("entity_id"), "entity_id", "left_semi")


def expert_labels(rows: DataFrame) -> DataFrame:
    """SRC-10: labels (entity_id, signal_id, severity, reviewer_id, confidence, note) from either layout.

    severity if the column is there and not blank, else HIGH or LOW by
    expected_flag; signal_id or issue_type; rationale or note. A null
    confidence is 0, a lacking column 1.
    """
    has = lambda c, default: F.col(c) if c in rows.columns else default
    none = F.lit(None).cast("string")
    flag = F.when(F.coalesce(has("expected_flag", F.lit(0)).cast("int"), F.lit(0)) != 0, "HIGH").otherwise("LOW")
    note = has("rationale", has("note", none))
    return rows.select(
        F.coalesce(has("entity_id", none), F.lit("")).alias("entity_id"), F.coalesce(has("signal_id", has("issue_type", none)), F.lit("")).alias("signal_id"),
        F.coalesce(F.nullif(has("severity", none), F.lit("")), flag).alias("severity"), has("reviewer_id", F.lit("synthetic")).alias("reviewer_id"),
        F.coalesce(has("confidence", F.lit(1.0)).cast("double"), F.lit(0.0)).alias("confidence"), F.nullif(note, F.lit("")).alias("note"),
    )


def training_labels(rows: DataFrame) -> DataFrame | None:
    """SRC-11: the rows, or None where they have no expected_flag or there are none."""
    return None if "expected_flag" not in rows.columns or rows.isEmpty() else rows


def quarantine_rates(rejected: DataFrame, alerts: DataFrame) -> DataFrame:
    """SRC-17: rejected rows of each entity over its alerts (or 1), for every entity of either."""
    sides = [df.groupBy("entity_id").agg(F.count(F.lit(1)).alias(n)) for df, n in ((rejected, "bad"), (alerts, "n"))]
    d = sides[0].join(sides[1], "entity_id", "full_outer").na.fill(0)
    return d.select("entity_id", (F.col("bad") / F.greatest(F.lit(1), "n")).alias("quarantine_rate"))


def review_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-18: (run_id, seq, entity_id, signal_id) and (entity_id, ts) of the review history; both empty where there is no file."""
    d = _json_or_empty(spark, path, REVIEWS, multiLine=True)
    runs = d.select(F.posexplode("runs").alias("seq", "r")).select("r.run_id", "seq", F.inline("r.queue"))
    return runs, d.select(F.explode("last_reviewed").alias("entity_id", "t")).select("entity_id", F.try_to_timestamp("t").alias("ts"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """SRC-19: entries of the audit ledger; a malformed line raises, no file is no entries."""
    return _json_or_empty(spark, path, LEDGER, mode="FAILFAST")


def adjudications(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: recorded verdicts; none where there is no file."""
    return _json_or_empty(spark, path, VERDICTS)


def quality(tables: dict[str, DataFrame], rejected: DataFrame) -> DataFrame:
    """RPT-02: rows of an entity's tables, valid and rejected ones, rate (4 places), empty cells, and the reason; nested columns count as cells."""
    out = None
    for df in tables.values():
        cells = sum((F.count(F.when(F.col(c).isNull(), 1)) for c in df.columns if c != "entity_id"), F.lit(0))
        part = df.groupBy("entity_id").agg(F.count(F.lit(1)).alias("total"), cells.cast("long").alias("null_cells"))
        out = part if out is None else out.unionByName(part)
    d = out.groupBy("entity_id").agg(F.sum("total").alias("total"), F.sum("null_cells").alias("null_cells"))
    d = d.join(rejected.groupBy("entity_id").agg(F.count(F.lit(1)).alias("quarantined")), "entity_id", "left").na.fill(0, ["quarantined"])
    return d.select("entity_id", "total", F.greatest(F.lit(0), F.col("total") - F.col("quarantined")).alias("valid"), "quarantined", F.round(F.col("quarantined") / F.greatest(F.lit(1), "total"), 4).alias("quarantine_rate"), "null_cells", F.when(F.col("quarantined") > 0, "partial feed").otherwise("-").alias("top_reason"))


def window_labels(registry: DataFrame, alerts: DataFrame) -> DataFrame:
    """SCR-06: "first..last" day of each entity's alerts, unknown where it has none."""
    day = alerts.groupBy("entity_id").agg(F.to_date(F.min("detected_ts")).cast("string").alias("a"), F.to_date(F.max("detected_ts")).cast("string").alias("b"))
    return registry.select("entity_id").distinct().join(day, "entity_id", "left").select("entity_id", F.coalesce(F.concat("a", F.lit(".."), "b"), F.lit("unknown")).alias("window"))
