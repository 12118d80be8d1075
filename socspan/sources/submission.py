"""A whole submission as one job: mapping of all six tables, derived tables, provenance, checks, report (MAP-01..13, VAL-07, SNK-03)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import pseudonym, strip_formula
from ..functions.tables import written
from ..params import DEFAULT, STATUSES, Params
from .ingest import ALERT_ENUMS, CASE_ENUMS, TIERS, check, parse_time, quarantine, severity_like, severity_norm

# Names under which submissions send the canonical columns (case and punctuation don't count).
ALIASES = {
    "alerts": {
        "alert_id": ["alert_id", "id"], "asset_id": ["asset_id", "host_id", "hostname", "device_id"], "title": ["title", "subject", "alert_name", "description", "category"],
        "severity_raw": ["severity_raw", "severity", "priority", "level"], "severity_norm": ["severity_norm", "severity", "priority", "level"], "status": ["status", "state", "alert_status"],
        "category": ["category", "alert_category", "type"], "detected_ts": ["detected_ts", "alert_timestamp", "created_at", "timestamp", "event_time"],
    },
    "cases": {
        "case_id": ["case_id", "incident_id", "id"], "asset_id": ["asset_id", "host_id"], "severity_norm": ["severity_norm", "severity", "priority", "level"], "status": ["status", "state", "case_status"],
        "open_ts": ["open_ts", "opened", "opened_at", "created_at", "timestamp"], "close_ts": ["close_ts", "closed", "closed_at", "resolved_at"], "disposition_code": ["disposition_code", "disposition", "resolution"],
    },
    "investigations": {"investigation_id": ["investigation_id", "id"], "case_id": ["case_id", "incident_id"], "notes": ["notes", "investigation_notes", "comments"]},
    "escalations": {
        "escalation_id": ["escalation_id", "id"], "case_id": ["case_id", "incident_id"], "from_tier": ["from_tier", "source_tier"], "to_tier": ["to_tier", "destination_tier", "target_tier"],
        "escalated_ts": ["escalated_ts", "escalated_at", "timestamp"],
    },
    "assets": {
        "asset_id": ["asset_id", "host_id", "device_id"], "hostname": ["hostname", "host_name", "name"], "criticality": ["criticality", "asset_criticality", "business_criticality"],
        "environment": ["environment", "env"], "os_family": ["os_family", "operating_system", "os"], "internet_facing": ["internet_facing", "internet_exposed", "publicly_exposed"],
    },
    "telemetry": {
        "telemetry_id": ["telemetry_id", "id"], "asset_id": ["asset_id", "host_id", "device_id"], "source": ["source", "source_system", "sensor"],
        "observed_ts": ["observed_ts", "observed_at", "timestamp", "event_time"],
    },
}
# Canonical columns that a row can't do without.
REQUIRED = {
    "alerts": ["alert_id", "asset_id", "title", "severity_raw", "severity_norm", "detected_ts"], "cases": ["case_id", "severity_norm", "open_ts"], "investigations": ["investigation_id", "case_id"],
    "escalations": ["escalation_id", "case_id"], "assets": ["asset_id", "criticality", "environment", "os_family"], "telemetry": ["telemetry_id", "asset_id", "source", "observed_ts"],
}
ENUMS = {"alerts": ALERT_ENUMS, "cases": {c: CASE_ENUMS[c] for c in ("severity_norm", "status", "disposition_code")}, "escalations": {"from_tier": TIERS, "to_tier": TIERS}}
CODES = ["status", "disposition_code", "from_tier", "to_tier"]


@dataclass(frozen=True)
class Field:
    """Where a canonical column comes from; a hashed one is pseudonymised with the job's salt, a severity that isn't looked up goes by the level it names."""

    source: str
    hashed: bool = False
    looked_up: bool = True


@dataclass(frozen=True)
class Submission:
    """The canonical rows that passed by table, what was rejected, and counts by entity and table."""

    tables: dict[str, DataFrame]
    rejected: DataFrame
    report: DataFrame
    checked: dict[str, DataFrame]  # all rows, with their reason
    run_id: str


def auto_mapping(table: str, columns: list[str]) -> dict[str, Field]:
    """MAP-02: the first source column, in source order, that bears one of a canonical column's names."""
    plain = lambda s: "".join(x for x in s.lower() if x.isalnum())
    out = {}
    for target, names in ALIASES[table].items():
        known = {plain(n) for n in names}
        if hit := next((c for c in columns if plain(c) in known), None):
            out[target] = Field(hit)
    return out


def file_hashes(spark: SparkSession, files: str) -> DataFrame:
    """MAP-12: (_path, source_file_hash) of the files that the pattern names: SHA-256 of their bytes."""
    return spark.read.format("binaryFile").load(files).select(F.col("path").alias("_path"), F.sha2("content", 256).alias("source_file_hash"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Rows with i, their place (from 0) within the entity by key, a hash in hex: counted by its first two digits, so that one entity is many groups."""
    part = F.substring(key, 1, 2)
    n = rows.groupBy("entity_id", part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    start = n.select("entity_id", "_p", (F.sum("_n").over(Window.partitionBy("entity_id").orderBy("_p")) - F.col("_n")).alias("_start"))  # 256 rows an entity
    d = rows.withColumn("_p", part).withColumn("_k", F.row_number().over(Window.partitionBy("entity_id", "_p").orderBy(key)))
    return d.join(start, ["entity_id", "_p"]).withColumn("i", F.col("_start") + F.col("_k") - 1).drop("_p", "_k", "_start")


def _blank(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) == 0, F.lit(False))


def map_table(raw: DataFrame, table: str, as_of: str, mapping: dict[str, Field] | None = None, zone: str = "UTC", salt: str = "") -> DataFrame:
    """MAP-01, MAP-05..08, MAP-12: text rows (entity_id, .. and source_file_hash if known) as canonical rows with hashes and time offsets.

    Unmapped columns go. A null in a required mapped column stays null (check
    rejects it); a blank, or a column that the source lacks, gets the default
    of alerts. Times that no format fits are as_of,
    and times_unread counts them; null times stay null.
    """
    given = [c for c in raw.columns if c not in ("entity_id", "source_file_hash")]
    m = auto_mapping(table, given) if mapping is None else mapping
    whole = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(given))), {"ignoreNullFields": "false"}), 256)
    file = F.col("source_file_hash") if "source_file_hash" in raw.columns else F.sha2(F.concat_ws(":", "entity_id", F.lit(table)), 256)
    cols = {"record_hash": whole, "source_file_hash": file}
    for t, f in m.items():
        text = strip_formula(F.col(f"`{f.source}`").cast("string"))
        if t.endswith("_ts"):
            cols[t] = F.when(text.isNotNull(), F.coalesce(parse_time(text, zone), F.lit(as_of).cast("timestamp")))
            cols[f"{t}_orig_offset"] = F.regexp_extract(text, "([+-]\\d{2}:?\\d{2})$", 1)
        elif f.hashed:
            cols[t] = pseudonym(text, salt)
        elif t in CODES:
            cols[t] = F.upper(F.replace(F.trim(text), F.lit(" "), F.lit("_")))
        elif t == "internet_facing":
            cols[t] = F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes"), F.lit(False))
        else:
            cols[t] = F.when(text.isNotNull(), severity_norm(text) if f.looked_up else severity_like(text)) if t == "severity_norm" else text
    times = [F.col(f"`{f.source}`").isNotNull() & parse_time(strip_formula(F.col(f"`{f.source}`").cast("string")), zone).isNull() for t, f in m.items() if t.endswith("_ts")]
    cols["times_unread"] = reduce(lambda a, b: a + b, [x.cast("int") for x in times], F.lit(0))
    rows = raw.select("entity_id", *(c.alias(t) for t, c in cols.items()), F.lit(as_of).cast("timestamp").alias("ingest_ts"))
    return _alert_defaults(rows, as_of) if table == "alerts" else rows


def _alert_defaults(rows: DataFrame, as_of: str) -> DataFrame:
    """MAP-08: ids and titles by the row's place, other columns by fixed defaults."""
    rows = numbered(rows, "record_hash")
    place = F.lpad((F.col("i") + 1).cast("string"), 5, "0")
    default = {
        "alert_id": F.concat(F.lit("ALT-"), "entity_id", F.lit("-"), F.when(F.length((F.col("i") + 1).cast("string")) > 5, (F.col("i") + 1).cast("string")).otherwise(place)),
        "asset_id": F.concat(F.lit("AST-"), "entity_id", F.lit("-01")), "title": F.concat(F.lit("Alert "), (F.col("i") + 1).cast("string")), "severity_raw": F.lit("MEDIUM"), "severity_norm": F.lit("MEDIUM"), "category": F.lit("SECURITY"),
    }
    out = {c: F.when(_blank(F.col(c)), v).otherwise(F.col(c)) if c in rows.columns else v for c, v in default.items()}
    out["category"] = F.coalesce(out["category"], default["category"])
    out["status"] = F.when(F.col("status").isin(STATUSES), F.col("status")).otherwise("OPEN") if "status" in rows.columns else F.lit("OPEN")
    if "detected_ts" not in rows.columns:
        out["detected_ts"] = F.lit(as_of).cast("timestamp")
    return rows.withColumns(out).drop("i")


def derived_cases(alerts: DataFrame) -> DataFrame:
    """MAP-09: a case for each alert of an entity without cases: closed on even places, true positive on every third, else benign."""
    d = numbered(alerts.withColumn("_h", F.sha2("alert_id", 256)), "_h")
    even = F.col("i") % 2 == 0
    return d.select("entity_id", F.concat(F.lit("CAS-"), "alert_id").alias("case_id"), "asset_id", "severity_norm", F.when(even, "CLOSED").otherwise("OPEN").alias("status"), F.when(F.col("i") % 3 == 0, "TRUE_POSITIVE").otherwise("BENIGN").alias("disposition_code"), F.col("detected_ts").alias("open_ts"), F.when(even, F.col("detected_ts")).alias("close_ts"))


def _assets_of(alerts: DataFrame) -> DataFrame:
    return numbered(alerts.filter("asset_id is not null").select("entity_id", "asset_id").distinct().withColumn("_h", F.sha2("asset_id", 256)), "_h")


def derived_assets(alerts: DataFrame) -> DataFrame:
    """MAP-10: the distinct assets of alerts with a profile by place, for entities without an inventory."""
    high, facing = F.col("i") % 2 == 0, F.col("i") % 3 == 0
    return _assets_of(alerts).select("entity_id", "asset_id", F.concat(F.lower(F.replace("asset_id", F.lit(" "), F.lit("-"))), F.lit(".corp")).alias("hostname"), F.when(high, "high").otherwise("medium").alias("criticality"), F.lit("production").alias("environment"), F.when(high, "linux").otherwise("windows").alias("os_family"), facing.alias("internet_facing"))


def derived_telemetry(alerts: DataFrame, as_of: str) -> DataFrame:
    """MAP-11: one row of an edr sensor for each asset of alerts, for entities without telemetry."""
    return _assets_of(alerts).select("entity_id", F.concat(F.lit("TEL-"), "entity_id", F.lit("-"), "asset_id").alias("telemetry_id"), "asset_id", F.lit("edr_sensor").alias("source"), F.lit(as_of).cast("timestamp").alias("observed_ts"))


def materialize(raw: dict[str, DataFrame], run_id: str, as_of: str, mappings: dict[str, dict[str, Field]] | None = None, zone: str = "UTC", salt: str = "", p: Params = DEFAULT, stage: bool = False) -> Submission:
    """MAP-13: raw text tables of all entities, by name, as a checked submission; alerts are needed, the others may lack.

    Cases, assets and telemetry of an entity that sent none are derived from
    its alerts. Empty tables give empty results; extra columns go. With stage
    the mapped rows are written first, as derived tables read the alerts again.
    """
    if "alerts" not in raw:
        raise ValueError("a submission needs a table of alerts")
    rows = {t: map_table(df, t, as_of, (mappings or {}).get(t), zone, salt) for t, df in raw.items()}
    if stage:
        rows = {t: written(df, f"mapped-{t}") for t, df in rows.items()}
    for t, make in (("cases", derived_cases), ("assets", derived_assets), ("telemetry", lambda a: derived_telemetry(a, as_of))):
        alerts = rows["alerts"]
        if t in rows:
            alerts = alerts.join((rows if stage else raw)[t].select("entity_id").distinct(), "entity_id", "left_anti")
        new = make(alerts)
        new = new.withColumns({"record_hash": F.sha2(F.to_json(F.struct(*sorted(new.columns))), 256), "source_file_hash": F.sha2(F.concat_ws(":", "entity_id", F.lit(t)), 256), "ingest_ts": F.lit(as_of).cast("timestamp")})
        rows[t] = rows[t].unionByName(new, allowMissingColumns=True) if t in rows else new
    checked = {}
    for t, df in rows.items():
        need = [c for c in REQUIRED[t] if c in df.columns]
        lacks = [c for c in REQUIRED[t] if c not in df.columns]
        enums = {c: v for c, v in ENUMS.get(t, {}).items() if c in df.columns}
        d = check(df, as_of, need, enums, None, p)
        reason = F.coalesce("reason", F.lit("REQUIRED_MISSING")) if lacks else F.coalesce("reason", F.when(~F.col("record_hash").rlike("^[0-9a-f]{64}$"), "SCHEMA_INVALID"))
        checked[t] = d.withColumn("reason", reason)
    return _submission(checked, run_id)


def _submission(checked: dict[str, DataFrame], run_id: str) -> Submission:
    counts = [d.groupBy("entity_id", F.lit(t).alias("record_type")).agg(F.count(F.lit(1)).alias("total_rows"), F.count(F.when(F.col("reason").isNull(), 1)).alias("valid_rows"), F.coalesce(F.sum("times_unread" if "times_unread" in d.columns else F.lit(0)), F.lit(0)).alias("times_unread")) for t, d in checked.items()]
    report = reduce(DataFrame.unionByName, counts).withColumn("quarantined_rows", F.col("total_rows") - F.col("valid_rows"))
    rejected = reduce(DataFrame.unionByName, [quarantine(d, run_id).withColumn("record_type", F.lit(t)) for t, d in checked.items()])
    return Submission({t: d.filter("reason is null").drop("reason", "times_unread") for t, d in checked.items()}, rejected, report, checked, run_id)


def write_submission(s: Submission, path: str) -> dict[str, dict[str, int]]:
    """SNK-01, SNK-03: canonical parquet of each table partitioned by entity, rejected rows, and the report as JSON, below path.

    The checked rows of a table are written once, to the shared folder, and
    the three outputs read them from there, so raw files aren't read again.
    Returns total, valid and quarantined rows by table, observed in that write.
    """
    stored, seen = {}, {}
    for t, df in s.checked.items():
        seen[t] = Observation(f"{t}-rows")
        stored[t] = written(df.observe(seen[t], F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("reason").isNull(), 1)).alias("valid")), f"checked-{t}")
    s = _submission(stored, s.run_id)
    for t, df in s.tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entity_id").parquet(f"{path}/{t}")
    s.rejected.write.mode("overwrite").json(f"{path}/quarantine")
    s.report.write.mode("overwrite").json(f"{path}/ingest_report")
    return {t: {**o.get, "quarantined": o.get["total"] - o.get["valid"]} for t, o in seen.items()}
