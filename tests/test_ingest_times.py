"""Times with fractions and odd forms, severity by the level a text names, JSON documents without a list."""

import pytest
from pyspark.sql import functions as F

from socspan.sources import ingest, submission

AS_OF = "2030-01-01 00:00:00"
TIMES = {
    "2024-01-02T03:04:05.123Z": "2024-01-02 03:04:05.123", "2024-01-02T03:04:05.123456+05:30": "2024-01-01 21:34:05.123456", "2024-01-02T03:04:05.5": "2024-01-02 03:04:05.5",
    "2024-01-02T03:04:05+0530": "2024-01-01 21:34:05", "2024-01-02T03:04:05.25+0530": "2024-01-01 21:34:05.25", "2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "2024-01-02 03:04:05.000001": "2024-01-02 03:04:05.000001",
    "02/01/2024 03:04": "2024-01-02 03:04:00", " 2024-01-02T03:04:05 ": "2024-01-02 03:04:05", "2024-01-02": "2024-01-02 00:00:00", "2024-01-02 03:04": "2024-01-02 03:04:00", "2024-01-02 03:04:05+02:00": "2024-01-02 01:04:05",
    "yesterday": None, "": None, None: None,
}


def test_times(spark):
    df = spark.createDataFrame([(k,) for k in TIMES], "s string")
    got = {r.s: r.t for r in df.select("s", ingest.parse_time(F.col("s")).cast("string").alias("t")).collect()}
    assert {k: v and v.removesuffix(":00") for k, v in got.items() if v} == {k: v.removesuffix(":00") for k, v in TIMES.items() if v}
    assert all(got[k] is None for k, v in TIMES.items() if v is None)
    east = df.filter("s in ('2024-01-02T03:04:05.5', '2024-01-02', '2024-01-02T03:04:05Z')").select("s", ingest.parse_time(F.col("s"), "Asia/Kolkata").cast("string")).collect()
    assert dict(map(tuple, east)) == {"2024-01-02T03:04:05.5": "2024-01-01 21:34:05.5", "2024-01-02": "2024-01-01 18:30:00", "2024-01-02T03:04:05Z": "2024-01-02 03:04:05"}


def test_event_times_are_kept_and_fallbacks_counted(spark):
    raw = spark.createDataFrame([("e", "a1", "h", "x", "high", "2024-01-02T03:04:05.123Z"), ("e", "a2", "h", "x", "high", "soon"), ("e", "a3", "h", "x", "high", None)], "entity_id string, id string, host_id string, title string, severity string, created_at string")
    rows = {r.alert_id: r for r in submission.map_table(raw, "alerts", AS_OF).collect()}
    assert [str(rows[k].detected_ts) for k in ("a1", "a2", "a3")] == ["2024-01-02 03:04:05.123000", "2030-01-01 00:00:00", "None"]
    assert [rows[k].times_unread for k in ("a1", "a2", "a3")] == [0, 1, 0]
    s = submission.materialize({"alerts": raw}, "r", AS_OF)
    assert s.report.filter("record_type = 'alerts'").first().times_unread == 1 and "times_unread" not in s.tables["alerts"].columns


@pytest.mark.parametrize("text, looked_up, level", [("Sev: critical!", False, "CRITICAL"), ("very high", False, "HIGH"), ("slow", False, "LOW"), (" info ", False, "INFO"), ("odd", False, "MEDIUM"), ("odd", True, "UNKNOWN"), ("P1", True, "CRITICAL"), ("very high", True, "UNKNOWN")])
def test_severity(spark, text, looked_up, level):
    raw = spark.createDataFrame([("e", "a1", text)], "entity_id string, id string, sev string")
    got = submission.map_table(raw, "alerts", AS_OF, {"alert_id": submission.Field("id"), "severity_norm": submission.Field("sev", looked_up=looked_up)})
    assert got.first().severity_norm == level


def test_json_documents(spark, tmp_path):
    for e, text in (("a", ' [{"id": 1}]'), ("b", '{"records": [{"id": 2}]}'), ("c", '{"alerts": [{"id": 3}, {"id": 4}]}')):
        (tmp_path / e).mkdir()
        (tmp_path / e / "alerts.json").write_text(text)
    assert sorted(r.id for r in ingest.read_submissions(spark, str(tmp_path), "alerts", "json").collect()) == ["1", "2", "3", "4"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "alerts.json").write_text('{"id": 5}')
    with pytest.raises(ValueError, match="d/alerts.json"):
        ingest.read_submissions(spark, str(tmp_path), "alerts", "json")


def test_a_submission_is_written_from_one_pass(spark, tmp_path):
    raw = spark.createDataFrame([(e, f"a{i}", "h", "x" if i else None, "high", "2024-01-02T03:04:05Z") for e in "ef" for i in range(4)], "entity_id string, id string, host_id string, title string, severity string, created_at string")
    raw = raw.withColumn("severity", F.when(F.expr("id = 'a3' and entity_id = 'e'"), F.lit(None)).otherwise(F.col("severity")))
    raw.write.parquet(f"{tmp_path}/raw")
    s = submission.materialize({"alerts": spark.read.parquet(f"{tmp_path}/raw")}, "run", AS_OF, stage=True)
    for df in [*s.tables.values(), s.report]:  # staged rows stand between the raw files and all that follows
        assert f"{tmp_path}/raw" not in df._jdf.queryExecution().executedPlan().toString() and not [f for f in df.inputFiles() if "/raw/" in f]
    counts = submission.write_submission(s, f"{tmp_path}/out")
    assert counts["alerts"] == {"total": 8, "valid": 8 - s.checked["alerts"].filter("reason is not null").count(), "quarantined": s.checked["alerts"].filter("reason is not null").count()}
    for t, c in counts.items():
        assert spark.read.parquet(f"{tmp_path}/out/{t}").count() == c["valid"]
    report = spark.read.json(f"{tmp_path}/out/ingest_report")
    assert {r.record_type: r.n for r in report.groupBy("record_type").agg(F.sum("total_rows").alias("n")).collect()} == {t: c["total"] for t, c in counts.items()}


def test_formats_are_tried_only_where_the_shape_fits(spark):
    odd = ["2024-01-02t03:04:05z", "2024-01-02T03:04:05-00:30", "2024-01-02T03:04:05.1-0330", "02/01/2024 03:04:05", "2024-01-02  03:04:05", "2024-1-2 3:04:05", "T1", "1/2", "2024-01-02 03:04:05.5+0530", "2024-01-02T03:04:05.123456789", "2024-01-02T03:04:05\n"]
    df = spark.createDataFrame([(k,) for k in [*TIMES, *odd]], "s string")
    c, each = F.trim("s"), []
    for f in ingest.TIME_FORMATS:
        t = F.try_to_timestamp(c, F.lit(f))
        each.append((t if f.endswith(("Z", "X")) else F.to_utc_timestamp(t, "Asia/Kolkata"), c.rlike(ingest.TIME_SHAPES[len(each)])))
    missed = df.select("s", *(F.coalesce(t.isNotNull() & ~m, F.lit(False)).alias(f"x{i}") for i, (t, m) in enumerate(each)))
    assert not [r for r in missed.collect() if any(r[1:])]


def test_the_submission_query_reads_mapped_rows(spark):
    from socspan.plans import score_queries

    files = score_queries.QUERIES["map_13_rejected"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/mapped-" in f for f in files)
