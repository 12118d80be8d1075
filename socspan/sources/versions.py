"""Tables of immutable versions, upserted by key and looked up by key (SNK-02, SNK-04, SNK-09, EXP-03, EXP-04, RPT-11).

A table is a folder with data and a log. Rows lie in buckets by the hash of
their key, sorted, with Bloom filters on it. An upsert writes new files for the
buckets that it touches and then one log entry, which says where each bucket
of the new version lies. The entry is renamed into place under its number, and
fails if that number is taken: readers see the old version or the new one,
a writer that died before leaves the old one, and of two writers at a time one
is refused. A look-up opens the buckets of its keys and no other file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
KEYS_MOST = 10_000  # keys of one look-up, which are part of its plan


class Conflict(RuntimeError):
    """Another writer has committed since this one read the table."""


class VersionedTable:
    """A table at path with rows of schema, in buckets by key.

    identity names the columns by which an upsert replaces rows, the key alone
    by default: with ("finding_id", "run_id") a run replaces only its own rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, identity: Sequence[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.identity = list(identity or [key])
        self.schema = spark.createDataFrame([], schema).schema
        jvm = spark._jvm
        self._fs_path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # The log

    def _entries(self) -> list[str]:
        log = self._fs_path(f"{self.path}/log")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(log) if s.getPath().getName().endswith(".json")) if self._fs.exists(log) else []

    def entry(self, version: int | None = None) -> dict:
        """The log entry of a version, of the latest by default; version 0 is the empty table."""
        names = self._entries()
        version = int(names[-1][:-5]) if version is None and names else version or 0
        if not version:
            return {"version": 0, "buckets": {}, "batches": []}
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/log/{version:012d}.json").first()
        return json.loads(text[0])

    def _commit(self, entry: dict) -> None:
        jvm = self.spark._jvm
        new, to = self._fs_path(f"{self.path}/log/.{uuid.uuid4().hex}"), self._fs_path(f"{self.path}/log/{entry['version']:012d}.json")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._fs.makeQualified(new), self._fs.makeQualified(to), none)
        except Exception as e:
            self._fs.delete(new, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {entry['version']} of {self.path} is there already") from None
            raise

    # Reading

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, of the latest by default."""
        return self._read(sorted(self.entry(version)["buckets"].values()))

    def lookup(self, keys: Sequence[str], version: int | None = None) -> DataFrame:
        """The rows of up to KEYS_MOST keys. Only the buckets of the keys are opened; more keys should be joined with read()."""
        if len(keys) > KEYS_MOST:
            raise ValueError(f"more than {KEYS_MOST} keys; join with read() instead")
        if not keys:
            return self._read([])
        asked = self.spark.createDataFrame([(k,) for k in keys], "k string").select(self._bucket(F.col("k")).alias("b")).distinct().collect()
        at = self.entry(version)["buckets"]
        return self._read(sorted(at[str(r["b"])] for r in asked if str(r["b"]) in at)).filter(F.col(self.key).isin(list(keys)))

    def get(self, key: str) -> DataFrame:
        """EXP-03: the rows of a key; KeyError if there are none."""
        rows = self.lookup([key])
        if rows.isEmpty():
            raise KeyError(key)
        return rows

    # Writing

    def upsert(self, rows: DataFrame, batch: str = "", merge: dict[str, str] | None = None) -> int:
        """SNK-04: rows replace those of the same identity; returns the version.

        Rows that repeat an identity all stay, as after a delete and an insert.
        merge turns that about: rows of one identity become one, with the given
        SQL aggregates of columns over old and new ones and any value of the
        others. A batch whose name the table has is not applied again. Null
        keys lie in a bucket of their own; no rows make no version.
        """
        base = self.entry()
        if batch and batch in base["batches"]:
            return base["version"]
        names = [f.name for f in self.schema]
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).withColumn("_bucket", self._bucket(F.col(self.key)))
        touched = [str(r["_bucket"]) for r in rows.select("_bucket").distinct().collect()]  # at most one number a bucket
        if not touched:
            return base["version"]
        old = self._read(sorted(base["buckets"][b] for b in touched if b in base["buckets"])).withColumn("_bucket", self._bucket(F.col(self.key)))
        if merge:
            both = old.unionByName(rows).groupBy(*self.identity, "_bucket").agg(*((F.expr(merge[c]) if c in merge else F.any_value(c)).alias(c) for c in names if c not in self.identity)).select(*names, "_bucket")
        else:
            ids = rows.select(*(F.col(c).alias(f"_{c}") for c in self.identity)).distinct()
            same = None
            for c in self.identity:
                same = F.col(c).eqNullSafe(F.col(f"_{c}")) if same is None else same & F.col(c).eqNullSafe(F.col(f"_{c}"))
            both = old.join(ids, same, "left_anti").unionByName(rows)
        folder = uuid.uuid4().hex
        dealt = both.repartition(len(touched), "_bucket").sortWithinPartitions("_bucket", *self.identity)
        dealt.write.option(f"parquet.bloom.filter.enabled#{self.key}", True).partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        entry = {"version": base["version"] + 1, "buckets": {**base["buckets"], **{b: f"{folder}/_bucket={b}" for b in touched}}, "batches": [*base["batches"], *([batch] if batch else [])]}
        self._commit(entry)
        return entry["version"]


def find(table: VersionedTable, finding_id: str) -> tuple[str, str, str, bool]:
    """EXP-04: (run, entity, signal, flagged) of a finding by its id, from the latest run that has it; no signal is computed."""
    try:
        r = table.get(finding_id).orderBy(F.desc("run_id")).first()
    except PySparkException as e:
        raise RuntimeError(f"the index at {table.path} can't be read") from e
    return r["run_id"], r["entity_id"], r["signal_id"], r["is_flagged"]


FINDINGS = "finding_id string, run_id string, entity_id string, signal_id string, value double, score double, severity string, confidence string, is_flagged boolean"


def finding_index(spark: SparkSession, path: str) -> VersionedTable:
    """SNK-09: the results of all runs by finding_id; a run replaces its own rows."""
    return VersionedTable(spark, path, FINDINGS, "finding_id", ("finding_id", "run_id"))


EVIDENCE = "finding_id string, signal_id string, entity_id string, supporting array<string>, evidence_id string"


def evidence_store(spark: SparkSession, path: str) -> VersionedTable:
    """SNK-04: evidence by finding_id; a finding's newer evidence replaces the older."""
    return VersionedTable(spark, path, EVIDENCE, "finding_id")


QUARANTINE = "entity_id string, run_id string, reason_code string, raw_record string, copies long, details string, _fingerprint string"


def quarantine_store(spark: SparkSession, path: str) -> VersionedTable:
    """SNK-02: rejected rows by fingerprint."""
    return VersionedTable(spark, path, QUARANTINE, "_fingerprint")


def add_quarantined(table: VersionedTable, rows: DataFrame) -> int:
    """SNK-02: rows that aren't there yet are added; of known ones the larger number of copies and the first run stay, so repeating changes nothing."""
    return table.upsert(rows, merge={"copies": "max(copies)", "run_id": "min(run_id)"})
