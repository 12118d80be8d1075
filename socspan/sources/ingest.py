"""Reading, mapping, validating and quarantining raw submissions (SRC-01..08, MAP-05, MAP-07, VAL-*, SNK-02); whole submissions are in submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import minutes_between
from ..params import DEFAULT, DISPOSITIONS, SEVERITIES, SEVERITY_MAP, STATUSES, TIERS, Params

#: Time formats that are tried in order; seconds may have a fraction.
TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]Z", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]", "dd/MM/yyyy HH:mm"]
#: What a text must match to fit each of them at all: a format that is tried in vain costs an exception, many times a match.
TIME_SHAPES = ["(?i)t.*[+-]\\d{4}$", "(?i)t.*([+-]\\d{2}:\\d{2}|z)$", "(?i)t.*\\d$", "\\d \\d", "/"]
TIMES = ["detected_ts", "ack_ts", "triage_start_ts", "triage_end_ts", "open_ts", "close_ts"]


def read_submissions(spark: SparkSession, base: str, table: str, suffix: str) -> DataFrame:
    """SRC-01..04, SRC-07: a table's files of all entities below base/<entity>/, all columns text but for parquet; entity_id from the path.

    A JSON file may hold a list, or an object with a list under "records" or
    the table's name; any other document raises a ValueError.
    """
    path = f"{base}/*/{table}.{suffix}"
    if suffix == "csv":
        df = spark.read.option("header", True).option("escape", '"').csv(path)
    elif suffix in ("jsonl", "ndjson"):
        df = spark.read.option("primitivesAsString", True).json(path)
    elif suffix == "json":
        whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("f"), F.ltrim("value").alias("v"))
        lists = F.coalesce(*(F.get_json_object("v", f"$.{k}") for k in ("records", table)), F.lit(""))
        odd = whole.filter(~F.startswith("v", F.lit("[")) & ~F.startswith(lists, F.lit("["))).select("f").first()
        if odd:
            raise ValueError(f"{odd['f']} holds no list of records")
        df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
        if lists := [c for c in ("records", table) if c in df.columns]:
            at, own = F.col("_metadata.file_path").alias("_path"), [c for c in df.columns if c not in lists]
            one_by_one = df.filter(F.coalesce(*lists).isNull()).select(*own, at)
            df = df.select(F.inline(F.coalesce(*lists)), at).unionByName(one_by_one, allowMissingColumns=True)
    else:
        df = spark.read.parquet(path)
    at = F.col("_path") if "_path" in df.columns else F.col("_metadata.file_path")
    return df.withColumn("entity_id", F.element_at(F.split(at, "/"), -2)).drop("_path")


def read_corpus(spark: SparkSession, base: str, table: str, schema: str) -> DataFrame:
    """SRC-08: canonical parquet of all entities; columns missing from a file are null."""
    return spark.read.schema(schema).parquet(f"{base}/{table}")


def parse_time(c: Column, zone: str = "UTC", formats: list[str] = TIME_FORMATS) -> Column:
    """MAP-07: text in the first format that fits, as UTC; times without an offset are of the zone.

    What no format fits is read as Spark reads a time (a date alone, minutes
    without seconds, a space before the offset); null where that fails too.
    """
    c, out = F.trim(c), []
    shapes = dict(zip(TIME_FORMATS, TIME_SHAPES, strict=True))
    for f in formats:
        t = F.try_to_timestamp(c, F.lit(f))
        if f in shapes:
            t = F.when(c.rlike(shapes[f]), t)
        out.append(t if f.endswith(("Z", "X")) else F.to_utc_timestamp(t, zone))
    general = F.try_to_timestamp(c)
    return F.coalesce(*out, F.when(c.rlike("(Z|UTC|GMT|[+-]\\d{2}:?\\d{2})$") & c.rlike("\\d:\\d"), general).otherwise(F.to_utc_timestamp(general, zone)))


def severity_norm(raw: Column) -> Column:
    """MAP-05, SRC-12: look-up of the trimmed upper-case text, UNKNOWN where it isn't known."""
    known = F.create_map(*(F.lit(x) for kv in SEVERITY_MAP.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.upper(F.trim(raw))), F.lit("UNKNOWN"))


def severity_like(raw: Column) -> Column:
    """MAP-08: the trimmed upper-case text if it is a level, else the level that it names in part, else MEDIUM."""
    t = F.upper(F.trim(raw))
    return F.when(t.isin(SEVERITIES), t).when(t.contains("CRIT"), "CRITICAL").when(t.contains("HIGH"), "HIGH").when(t.contains("LOW"), "LOW").otherwise("MEDIUM")


def check(rows: DataFrame, as_of: str, required: list[str], enums: dict[str, list[str]], assets: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """VAL-01..05: rows with reason: the first rule broken, of future times, order of times, unknown asset, missing value, unknown enum; else null."""
    late = F.lit(as_of).cast("timestamp") + F.expr(f"interval {p.future_seconds} seconds")
    have = [t for t in TIMES if t in rows.columns]
    any_of = lambda cs: F.coalesce(*cs, F.lit(False)) if len(cs) == 1 else F.array_contains(F.array(*(F.coalesce(c, F.lit(False)) for c in cs)), True) if cs else F.lit(False)
    order = [(a, b) for a, b in (("detected_ts", "ack_ts"), ("ack_ts", "triage_start_ts"), ("triage_start_ts", "triage_end_ts"), ("detected_ts", "close_ts")) if a in have and b in have]
    reasons = [F.when(any_of([F.col(t) > late for t in have]), "FUTURE_TIMESTAMP"), F.when(any_of([minutes_between(F.col(a), F.col(b)) < 0 for a, b in order]), "NON_MONOTONIC")]
    if assets is not None:
        known = assets.select("entity_id", "asset_id", F.lit(True).alias("_known")).distinct()
        rows = rows.join(known, ["entity_id", "asset_id"], "left")
        reasons.append(F.when(F.col("asset_id").isNotNull() & F.col("_known").isNull(), "ORPHAN_REFERENCE"))
    reasons.append(F.when(any_of([F.col(c).isNull() | (F.length(F.col(c).cast("string")) == 0) for c in required]), "REQUIRED_MISSING"))
    reasons.append(F.when(any_of([~F.col(c).isin(v) for c, v in enums.items()]), "ENUM_INVALID"))
    return rows.withColumn("reason", F.coalesce(*reasons)).drop("_known")


ALERT_ENUMS = {"severity_norm": SEVERITIES, "status": STATUSES}
CASE_ENUMS = {"severity_norm": SEVERITIES, "status": STATUSES, "disposition_code": DISPOSITIONS, "tier": TIERS}


def quarantine(checked: DataFrame, run_id: str) -> DataFrame:
    """VAL-05, VAL-07: rejected rows as text, equal ones once with their number of copies, and a fingerprint of the whole row that doesn't depend on the run.

    details is the row's first 500 characters, for display.
    """
    raw = F.to_json(F.struct(*(c for c in checked.columns if c != "reason")), {"ignoreNullFields": "false"})
    d = checked.filter("reason is not null").groupBy("entity_id", F.col("reason").alias("reason_code"), raw.alias("raw_record")).agg(F.count(F.lit(1)).alias("copies"))
    return d.select("entity_id", F.lit(run_id).alias("run_id"), "reason_code", "raw_record", "copies", F.substring("raw_record", 1, 500).alias("details"), F.sha2(F.concat_ws("|", "entity_id", "reason_code", "raw_record"), 256).alias("_fingerprint"))


def append_new(new: DataFrame, existing: DataFrame) -> DataFrame:
    """SNK-02: the rows of new whose fingerprint existing doesn't have, once each; appending them twice adds nothing."""
    return new.join(existing.select("_fingerprint").distinct(), "_fingerprint", "left_anti").dropDuplicates(["_fingerprint"])


def scorecard(checked: DataFrame) -> DataFrame:
    """VAL-06, SNK-03: rows, valid and quarantined rows, rate and counts of reasons by entity."""
    n = checked.groupBy("entity_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    d = n.groupBy("entity_id").agg(F.sum("n").alias("total_rows"), F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("valid_rows"), F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))).alias("reasons"))
    bad = F.col("total_rows") - F.col("valid_rows")
    return d.select("entity_id", "total_rows", "valid_rows", bad.alias("quarantined_rows"), (bad / F.greatest(F.lit(1), "total_rows")).alias("quarantine_rate"), "reasons")


def health(rate: Column) -> Column:
    """RPT-03: POOR from 0.20, DEGRADED from 0.05."""
    return F.when(rate >= 0.20, "POOR").when(rate >= 0.05, "DEGRADED").otherwise("HEALTHY")
