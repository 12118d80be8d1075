"""Hash-chained ledger, Merkle root and manifest (AUD-01..06)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import hmac_sha256
from ..functions.tables import written

GENESIS = "0" * 64


def _entry(prev: Column, x) -> Column:
    return F.sha2(F.concat_ws("||", prev, x["payload_json"], x["seq"].cast("string"), x["ts"], x["run_id"], x["event_type"]), 256)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by run and sequence number, with prev_hash and entry_hash in place of tail; a run begins with the genesis hash."""
    run, last = object(), GENESIS
    for batch in batches:
        before, after = [], []
        for r, tail in zip(batch.column("run_id").to_pylist(), batch.column("tail").to_pylist(), strict=True):
            if r != run:
                run, last = r, GENESIS
            before.append(last)
            last = hashlib.sha256((last + tail).encode()).hexdigest()
            after.append(last)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(before, pa.string()), pa.array(after, pa.string())], [*batch.schema.names[:-1], "prev_hash", "entry_hash"])


def build_chain(events: DataFrame) -> DataFrame:
    """AUD-01: events (run_id, seq, ts, event_type, payload_json) with prev_hash and entry_hash, a chain for each run.

    A chain is sequential, so chains are keyed by run and built side by side;
    a run's sorted events stream through one task, which holds the last hash.
    Nulls are left out of a hash. The chain is written once.
    """
    rows = events.select("run_id", "seq", "ts", "event_type", "payload_json")
    schema = T.StructType([*rows.schema, T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])
    rows = rows.withColumn("tail", F.concat_ws("||", F.lit(""), "payload_json", F.col("seq").cast("string"), "ts", "run_id", "event_type"))
    return written(rows.repartition("run_id").sortWithinPartitions("run_id", "seq", "ts", "event_type", "payload_json").mapInArrow(_folded, schema), "chain")


def verify_chain(ledger: DataFrame) -> DataFrame:
    """AUD-02: (run_id, n, ok, first_broken_seq): hashes recomputed, links and gap-free sequence checked, in parallel over entries."""
    w = Window.partitionBy("run_id").orderBy("seq")
    d = ledger.withColumns({"before": F.coalesce(F.lag("entry_hash").over(w), F.lit(GENESIS)), "step": F.col("seq") - F.lag("seq").over(w)})
    row = {c: F.col(c) for c in ("payload_json", "seq", "ts", "run_id", "event_type")}
    bad = (_entry(F.col("prev_hash"), row) != F.col("entry_hash")) | (F.col("prev_hash") != F.col("before")) | (F.coalesce("step", F.lit(1)) != 1)
    return d.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(bad, F.col("seq"))).alias("first_broken_seq")).withColumn("ok", F.col("first_broken_seq").isNull())


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """AUD-03: first sequence number at which two ledgers of a run differ, null where they don't."""
    x, y = (df.select("run_id", "seq", F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias(n)) for df, n in ((a, "x"), (b, "y")))
    d = x.join(y, ["run_id", "seq"], "full_outer")
    return d.groupBy("run_id").agg(F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("seq"))).alias("first_difference"))


def merkle_roots(ledger: DataFrame) -> DataFrame:
    """AUD-04: root over the entry hashes of each run: pairs are hashed level by level, an odd last leaf with itself."""
    level = ledger.select("run_id", (F.row_number().over(Window.partitionBy("run_id").orderBy("seq")) - 1).alias("i"), F.col("entry_hash").alias("h"))
    most = ledger.groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    n = ledger.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    level = level.join(n, "run_id")
    while most > 1:
        up = level.groupBy("run_id", F.floor(F.col("i") / 2).alias("i")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("h"))).alias("l"), F.max(F.when(F.col("i") % 2 == 1, F.col("h"))).alias("r"), F.max("n").alias("n"))
        done = F.col("n") == 1
        level = up.select("run_id", "i", F.when(done, F.col("l")).otherwise(F.sha2(F.concat(F.unhex("l"), F.unhex(F.coalesce("r", "l"))), 256)).alias("h"), F.ceil(F.col("n") / 2).alias("n"))
        most = (most + 1) // 2
    return level.select("run_id", F.col("h").alias("merkle_root"))


def manifest(ledger: DataFrame, key: str) -> DataFrame:
    """AUD-05: counts, time and sequence range, root and signature of each run."""
    d = ledger.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("seq").alias("seq_from"), F.max("seq").alias("seq_to"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.count_distinct(F.get_json_object("payload_json", "$.entity_id")).alias("n_entities"))
    d = d.join(merkle_roots(ledger), "run_id")
    return d.withColumn("signature", hmac_sha256(F.concat_ws("|", "run_id", "n_events", "merkle_root"), key))


def verify_runs(ledger: DataFrame) -> DataFrame:
    """AUD-06: each run with the verdict over all of them."""
    v = verify_chain(ledger)
    return v.select("run_id").crossJoin(F.broadcast(v.agg(F.bool_and("ok").alias("all_ok"))))  # one row
