"""One hash chain over all runs, its mirror, and roots of large runs (AUD-01, AUD-03, AUD-04).

A chain can't be computed side by side, but it needs no more than the last
hash: events are put in order by a range sort, numbered by the counts of the
ranges before, and folded range by range. A range is one task that streams its
rows and starts from the hash that the range before left behind; each is
committed as a part of the ledger before the next begins, so what a lost
executor costs is one range, and an append that was cut short goes on where it
stopped. Verification and mirroring work on all parts at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import hmac_sha256
from ..functions.tables import written
from .audit import GENESIS

PART_ROWS = 1_000_000  # events of a part, about
SUBTREE = 1 << 14  # leaves that a task hashes to one node
FIELDS = ["run_id", "ts", "event_type", "payload_json"]
SCHEMA = "seq long, run_id string, ts string, event_type string, payload_json string, prev_hash string, entry_hash string, signature string, batch string, part long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path; empty if there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def head(ledger: DataFrame) -> tuple[int, str]:
    """Next sequence number and last hash; 0 and the genesis hash of an empty ledger."""
    last = ledger.agg(F.max(F.struct("seq", "entry_hash")).alias("x")).first()["x"]
    return (last["seq"] + 1, last["entry_hash"]) if last else (0, GENESIS)


def _chained(first: int, prev: str):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, last = first, prev
        for batch in batches:
            before, hashes, seqs = [], [], range(seq, seq + batch.num_rows)
            for n, run, ts, kind, payload in zip(seqs, *(batch.column(c).to_pylist() for c in FIELDS), strict=True):
                before.append(last)
                last = hashlib.sha256("||".join((last, payload, str(n), ts, run, kind)).encode()).hexdigest()
                hashes.append(last)
            seq += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), *(batch.column(c) for c in FIELDS), pa.array(before, pa.string()), pa.array(hashes, pa.string())], ["seq", *FIELDS, "prev_hash", "entry_hash"])

    return fold


def append(events: DataFrame, path: str, batch: str, key: str | None = None) -> tuple[int, str]:
    """AUD-01: append events (run_id, ts, event_type, payload_json) in the order of ts, run, type and payload; returns head().

    Nulls count as empty texts; repeated events are entries of their own; no
    events leave the ledger as it is. A batch that is appended again is found
    by its name: entries it has already are left, the rest follow. One writer
    at a time. key signs each entry's hash.
    """
    spark = events.sparkSession
    rows = events.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FIELDS))
    n = rows.count()
    order = ["ts", "run_id", "event_type", "payload_json"]
    spread = rows.repartitionByRange(max(1, -(-n // PART_ROWS)), *order).sortWithinPartitions(*order)
    placed = written(spread.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ledger-events")
    sizes = dict(placed.groupBy("_range").count().orderBy("_range").collect())
    done = read(spark, path).filter(F.col("batch") == batch).count()
    for r, size in sizes.items():
        skip, done = min(done, size), max(0, done - size)
        if skip == size:
            continue
        seq, last = head(read(spark, path))
        part = placed.filter(F.col("_range") == r).coalesce(1).sortWithinPartitions("_at")
        if skip:  # the range sort may cut a repeated batch elsewhere, its order is the same
            part = part.orderBy("_at").offset(skip).coalesce(1)
        chained = part.select(*FIELDS).mapInArrow(_chained(seq, last), "seq long, run_id string, ts string, event_type string, payload_json string, prev_hash string, entry_hash string")
        signature = F.lit(None).cast("string") if key is None else hmac_sha256(F.col("entry_hash"), key)
        chained.withColumns({"signature": signature, "batch": F.lit(batch)}).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/part={seq}")
    return head(read(spark, path))


def _hash(prev: Column) -> Column:
    return F.sha2(F.concat_ws("||", prev, "payload_json", F.col("seq").cast("string"), "ts", "run_id", "event_type"), 256)


def verify(ledger: DataFrame) -> DataFrame:
    """AUD-02 over the whole chain: one row (n, ok, first_broken_seq).

    Hashes are recomputed row by row, links within each part by a window over
    the part, and links between parts from their first and last rows.
    """
    w = Window.partitionBy("part").orderBy("seq")
    d = ledger.withColumns({"before": F.lag("entry_hash").over(w), "gap": F.col("seq") - F.lag("seq").over(w)})
    bad = (_hash(F.col("prev_hash")) != F.col("entry_hash")) | (F.coalesce("before", "prev_hash") != F.col("prev_hash")) | (F.coalesce("gap", F.lit(1)) != 1)
    parts = d.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(bad, F.col("seq"))).alias("broken"), F.min(F.struct("seq", "prev_hash")).alias("first"), F.max(F.struct("seq", "entry_hash")).alias("last"))
    over = Window.orderBy("part")  # a row a part
    j = parts.withColumns({"last_before": F.lag("last").over(over)})
    apart = (F.col("first.prev_hash") != F.coalesce("last_before.entry_hash", F.lit(GENESIS))) | (F.col("first.seq") != F.coalesce(F.col("last_before.seq") + 1, F.lit(0)))
    j = j.withColumn("broken", F.least("broken", F.when(apart, F.col("first.seq"))))
    return j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("broken").alias("first_broken_seq")).select("n", F.col("first_broken_seq").isNull().alias("ok"), "first_broken_seq")


def _digests(ledger: DataFrame) -> DataFrame:
    row = F.xxhash64(F.to_json(F.struct(*sorted(c for c in ledger.columns if c != "part"))))
    return ledger.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("digest"))


def broken_parts(ledger: DataFrame, mirror: DataFrame) -> DataFrame:
    """(part, in_ledger): parts that differ, by count and sum of row hashes, or are in one of the two only."""
    a = _digests(ledger).select("part", F.struct("n", "digest").alias("a"))
    b = _digests(mirror).select("part", F.struct("n", "digest").alias("b"))
    return a.join(b, "part", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("part", F.col("a").isNotNull().alias("in_ledger"))


def rebuild_mirror(spark: SparkSession, path: str, mirror: str) -> list[int]:
    """AUD-03: make the mirror equal the ledger, by writing only the parts that differ; returns these. A broken ledger is refused.

    Parts that only the mirror has become empty. The driver handles part
    numbers, a row for each PART_ROWS events.
    """
    ledger = read(spark, path)
    if not verify(ledger).first()["ok"]:
        raise ValueError("the ledger itself is broken; its mirror isn't touched")
    wrong = {r["part"]: r["in_ledger"] for r in broken_parts(ledger, read(spark, mirror)).collect()}
    for part in sorted(wrong):
        rows = ledger.filter(F.col("part") == part) if wrong[part] else ledger.limit(0)
        rows.drop("part").coalesce(1).write.mode("overwrite").parquet(f"{mirror.rstrip('/')}/part={part}")
    return sorted(wrong)


def _subtree(leaves: int):
    """The node over a block's leaves; a block that isn't the only one of its run is lifted to the full height."""

    def node(table: pa.Table) -> pa.Table:
        rows = table.sort_by("i")
        level, alone, span = [bytes.fromhex(h) for h in rows.column("h").to_pylist()], rows.column("alone")[0].as_py(), 1
        while len(level) > 1 or (not alone and span < leaves):
            if len(level) % 2:
                level.append(level[-1])
            level = [hashlib.sha256(level[k] + level[k + 1]).digest() for k in range(0, len(level), 2)]
            span *= 2
        return pa.table({"run_id": rows.column("run_id")[:1], "i": rows.column("block")[:1], "h": [level[0].hex()]})

    return node


def merkle_roots(ledger: DataFrame) -> DataFrame:
    """AUD-04: (run_id, merkle_root): pairs are hashed level by level, an odd last node with itself.

    SUBTREE leaves at a time become one node in a task, so a run of a billion
    entries takes three rounds; each round is written.
    """
    w = Window.partitionBy("run_id").orderBy("seq")
    level = ledger.select("run_id", (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("entry_hash").alias("h"))
    most = ledger.groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    out = T.StructType([ledger.schema["run_id"], T.StructField("i", T.LongType()), T.StructField("h", T.StringType())])
    while most > 0:
        n = level.groupBy("run_id").agg((F.count(F.lit(1)) <= SUBTREE).alias("alone"))
        blocks = level.join(n, "run_id").withColumn("block", F.floor(F.col("i") / SUBTREE).cast("long"))
        level = written(blocks.groupBy("run_id", "block").applyInArrow(_subtree(SUBTREE), out), "merkle")
        if most <= SUBTREE:
            break
        most = -(-most // SUBTREE)
    return level.select("run_id", F.col("h").alias("merkle_root"))
