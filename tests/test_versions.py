"""Versioned tables: upserts, writers that die or collide, look-ups that read one bucket."""

import pytest
from pyspark.sql import functions as F

from socspan.sources import ingest, versions


def table(spark, tmp_path, **more):
    return versions.VersionedTable(spark, f"file://{tmp_path}/t", "k string, run string, v int", "k", **more)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, run string, v int")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upserts_replace_and_repeat(spark, tmp_path):
    t = table(spark, tmp_path, buckets=4)
    assert t.read().count() == 0 and t.lookup(["a"]).count() == 0
    assert t.upsert(frame(spark, [("a", "1", 1), ("a", "1", 2), ("b", "1", 3), (None, "1", 9)])) == 1
    new = frame(spark, [("a", "2", 5), ("c", "2", 6), (None, "2", 8)])
    assert t.upsert(new, "second") == 2
    want = [("a", "2", 5), ("b", "1", 3), ("c", "2", 6), (None, "2", 8)]
    assert rows_of(t.read()) == want
    assert t.upsert(new, "second") == 2 and t.upsert(new) == 3 and rows_of(t.read()) == want
    assert t.upsert(new.limit(0)) == 3
    assert rows_of(t.read(1)) == [("a", "1", 1), ("a", "1", 2), ("b", "1", 3), (None, "1", 9)] and t.read(0).count() == 0
    assert rows_of(t.lookup(["a", "c", "zz"])) == want[:1] + want[2:3]
    with pytest.raises(KeyError, match="zz"):
        t.get("zz")
    with pytest.raises(ValueError, match="keys"):
        t.lookup(["x"] * (versions.KEYS_MOST + 1))


def test_identity_of_key_and_run(spark, tmp_path):
    t = table(spark, tmp_path, identity=("k", "run"))
    t.upsert(frame(spark, [("a", "1", 1), ("b", "1", 1)]))
    t.upsert(frame(spark, [("a", "2", 2)]))
    t.upsert(frame(spark, [("a", "2", 3)]))
    assert rows_of(t.read()) == [("a", "1", 1), ("a", "2", 3), ("b", "1", 1)]


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(frame(spark, [("a", "1", 1)]))

    def dies(entry):
        raise RuntimeError("killed between write and commit")

    monkeypatch.setattr(t, "_commit", dies)
    with pytest.raises(RuntimeError, match="killed"):
        t.upsert(frame(spark, [("a", "2", 2)]))
    again = table(spark, tmp_path)
    assert rows_of(again.read()) == [("a", "1", 1)]
    again.upsert(frame(spark, [("a", "2", 2)]))
    assert rows_of(again.read()) == [("a", "2", 2)] and again.entry()["version"] == 2


def test_of_two_writers_one_is_refused(spark, tmp_path, monkeypatch):
    a, b = table(spark, tmp_path), table(spark, tmp_path)
    commit = a._commit

    def late(entry):
        b.upsert(frame(spark, [("b", "b", 1)]))
        commit(entry)

    monkeypatch.setattr(a, "_commit", late)
    with pytest.raises(versions.Conflict):
        a.upsert(frame(spark, [("a", "a", 1)]))
    assert rows_of(a.read()) == [("b", "b", 1)]


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    t = table(spark, tmp_path, buckets=16)
    t.upsert(spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.lit("1").alias("run"), F.col("id").cast("int").alias("v")))
    key = t.read().filter("v = 77").first().k
    found = t.lookup([key])
    assert rows_of(found) == [(key, "1", 77)] and len(found.inputFiles()) == 1 < len(t.read().inputFiles()) == 16
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(k" in plan or "In(k" in plan


def test_finding_index_over_runs(spark, tmp_path):
    t = versions.finding_index(spark, f"file://{tmp_path}/index")
    row = lambda run, flag: spark.createDataFrame([("f1", run, "e", "EG-001", 0.4, 1.0, "HIGH", "MEDIUM", flag)], versions.FINDINGS)
    t.upsert(row("run-1", True), "run-1")
    t.upsert(row("run-2", False), "run-2")
    assert versions.find(t, "f1") == ("run-2", "e", "EG-001", False) and t.get("f1").count() == 2
    with pytest.raises(KeyError):
        versions.find(t, "nothing")


def test_quarantine_counts_copies_once(spark, tmp_path):
    bad = lambda n, run: ingest.quarantine(spark.createDataFrame([("e", "x", "ENUM_INVALID")] * n, "entity_id string, a string, reason string"), run)
    t = versions.quarantine_store(spark, f"file://{tmp_path}/q")
    versions.add_quarantined(t, bad(1, "run-1"))
    versions.add_quarantined(t, bad(2, "run-2"))
    versions.add_quarantined(t, bad(2, "run-2"))
    assert [(r.run_id, r.copies) for r in t.read().collect()] == [("run-1", 2)]
    assert ingest.append_new(bad(2, "run-2"), bad(1, "run-1")).count() == 0
