"""The ledger over all runs: chain, appends that go on, verification, mirror, roots of many entries."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from socspan.operators import audit, ledger


def events(spark, n, start=0):
    return spark.range(start, start + n).select(F.concat(F.lit("run-"), (F.col("id") % 3).cast("string")).alias("run_id"), F.format_string("2024-01-01T%010d", "id").alias("ts"), F.lit("SCORED").alias("event_type"), F.format_string('{"k":%d}', "id").alias("payload_json")).repartition(5)


def chain(rows, seq=0, prev="0" * 64):
    out = []
    for run, ts, kind, payload in sorted(rows, key=lambda r: (r[1], r[0], r[2], r[3])):
        h = hashlib.sha256("||".join((prev, payload, str(seq), ts, run, kind)).encode()).hexdigest()
        out.append((seq, run, ts, prev, h))
        seq, prev = seq + 1, h
    return out


def rows_of(spark, path):
    return [(r.seq, r.run_id, r.ts, r.prev_hash, r.entry_hash) for r in ledger.read(spark, path).orderBy("seq").collect()]


def test_appends_continue_from_the_last_hash(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "PART_ROWS", 100)
    path = f"file://{tmp_path}/ledger"
    a, b = events(spark, 1000), events(spark, 250, 1000)
    assert ledger.head(ledger.read(spark, path)) == (0, "0" * 64) and ledger.verify(ledger.read(spark, path)).collect() == [(0, True, None)]
    ledger.append(a, path, "a")
    got = ledger.append(b, path, "b", key="k")
    want = chain([tuple(r) for r in a.unionByName(b).collect()])
    assert rows_of(spark, path) == want and got == (1250, want[-1][-1])
    assert ledger.append(b.limit(0), path, "none") == got and ledger.append(b, path, "b") == got
    assert ledger.verify(ledger.read(spark, path)).collect() == [(1250, True, None)]
    assert ledger.read(spark, path).filter("signature is not null").count() == 250
    assert ledger.read(spark, path).select("part").distinct().count() >= 10


def test_an_append_cut_short_goes_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "PART_ROWS", 100)
    path = f"file://{tmp_path}/ledger"
    calls, fold = [], ledger._chained

    def dies(seq, prev):
        calls.append(seq)
        if len(calls) == 4:
            raise RuntimeError("killed")
        return fold(seq, prev)

    monkeypatch.setattr(ledger, "_chained", dies)
    with pytest.raises(RuntimeError, match="killed"):
        ledger.append(events(spark, 600), path, "a")
    there = ledger.read(spark, path).count()
    assert 0 < there < 600 and ledger.verify(ledger.read(spark, path)).first().ok
    ledger.append(events(spark, 600), path, "a")
    assert rows_of(spark, path) == chain([tuple(r) for r in events(spark, 600).collect()])


def test_ties_nulls_and_repeats(spark, tmp_path):
    df = spark.createDataFrame([("r", "t", "E", "{}")] * 5 + [(None, None, None, None), ("r", "", "E", None)], "run_id string, ts string, event_type string, payload_json string")
    ledger.append(df, f"file://{tmp_path}/l", "x")
    assert ledger.verify(ledger.read(spark, f"file://{tmp_path}/l")).collect() == [(7, True, None)]


@pytest.mark.parametrize("change, broken", [("seq = 250", 250), ("seq = 300", 300)])
def test_tampering_and_mirror(spark, tmp_path, monkeypatch, change, broken):
    monkeypatch.setattr(ledger, "PART_ROWS", 100)
    path, mirror = f"file://{tmp_path}/ledger", f"file://{tmp_path}/mirror"
    ledger.append(events(spark, 500), path, "a")
    good = rows_of(spark, path)
    assert len(ledger.rebuild_mirror(spark, path, mirror)) >= 5 and rows_of(spark, mirror) == good
    assert ledger.rebuild_mirror(spark, path, mirror) == []
    there = ledger.read(spark, mirror)
    part = there.filter(change).first().part
    bad = spark.createDataFrame(there.filter(F.col("part") == part).withColumn("payload_json", F.when(F.expr(change), F.lit("{}")).otherwise(F.col("payload_json"))).drop("part").collect(), there.drop("part").schema)
    bad.write.mode("overwrite").parquet(f"{mirror}/part={part}")
    bad.limit(3).write.parquet(f"{mirror}/part=99999")
    assert ledger.verify(ledger.read(spark, mirror).filter("part < 99999")).collect() == [(500, False, broken)]
    assert ledger.rebuild_mirror(spark, path, mirror) == [part, 99999]
    assert rows_of(spark, mirror) == good
    bad.write.mode("overwrite").parquet(f"{path}/part={part}")
    with pytest.raises(ValueError, match="broken"):
        ledger.rebuild_mirror(spark, path, mirror)


def test_a_missing_part_is_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "PART_ROWS", 100)
    path = f"file://{tmp_path}/ledger"
    ledger.append(events(spark, 400), path, "a")
    rows = ledger.read(spark, path)
    parts = sorted(r.part for r in rows.select("part").distinct().collect())
    assert ledger.verify(rows.filter(F.col("part") != parts[1])).first().first_broken_seq == parts[2]


def test_chains_of_long_runs(spark):
    """A run of 40,000 events: an array of hashes that is copied for each event would take minutes. Nulls are left out of a hash."""
    ev = spark.range(120_000).select(F.concat(F.lit("run-"), (F.col("id") % 3).cast("string")).alias("run_id"), F.floor(F.col("id") / 3).alias("seq"), F.when(F.col("id") % 7 > 0, F.lit("t")).alias("ts"), F.lit("X").alias("event_type"), F.when(F.col("id") % 5 > 0, F.format_string("%d", "id")).alias("payload_json")).repartition(7)
    start = time.monotonic()
    got = audit.build_chain(ev)
    assert time.monotonic() - start < 60
    prev = ["0" * 64] * 3
    for r in got.orderBy("seq", "run_id").collect():
        k = int(r.run_id[-1])
        assert r.prev_hash == prev[k]
        prev[k] = hashlib.sha256("||".join(x for x in (prev[k], r.payload_json, str(r.seq), r.ts, r.run_id, "X") if x is not None).encode()).hexdigest()
        assert r.entry_hash == prev[k]
    assert audit.verify_runs(got).filter("all_ok").count() == 3


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 31, 33, 64, 65, 100])
def test_merkle_roots(spark, monkeypatch, n):
    monkeypatch.setattr(ledger, "SUBTREE", 4)
    df = spark.createDataFrame([("a", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(n)] + [("b", 0, "ab" * 32)], "run_id string, seq long, entry_hash string")
    level = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    while len(level) > 1:
        level += level[-1:] * (len(level) % 2)
        level = [hashlib.sha256(level[k] + level[k + 1]).digest() for k in range(0, len(level), 2)]
    got = {r.run_id: r.merkle_root for r in ledger.merkle_roots(df).collect()}
    assert got == {"a": level[0].hex(), "b": "ab" * 32} == {r.run_id: r.merkle_root for r in audit.merkle_roots(df).collect()}
