"""Tables of SQLite files as a data source (SRC-05): a partition for each table and row range, Arrow batches, no driver jar.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite_tables").option("table", "alerts").load("/submissions/*/export.sqlite")

The path must be one that every executor can open, as SQLite reads a local or
mounted file. Rows are all text, as exports of different tools type the same
column differently; entity_id is the folder that holds the file.
"""

from __future__ import annotations

import glob
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_ROWS = 500_000  # rows of a partition, about
BATCH = 10_000
TABLES = ["alerts", "cases", "investigations", "escalations", "assets", "telemetry"]


def _open(path: str) -> sqlite3.Connection:
    c = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    c.text_factory = lambda b: b.decode("utf-8", "replace")
    return c


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _tables(c: sqlite3.Connection) -> dict[str, str]:
    """Names of the file's tables, by lower-case name."""
    return {n.lower(): n for (n,) in c.execute("select name from sqlite_master where type in ('table', 'view') order by name desc")}


def _files(pattern: str) -> list[str]:
    return sorted(f for p in pattern.removeprefix("file://").split(",") for f in glob.glob(p))


def _columns(path: str, table: str) -> list[str]:
    with _open(path) as c:
        name = _tables(c).get(table)
        return [] if name is None else [r[1] for r in c.execute(f"pragma table_info({_quoted(name)})")]


class _Range(InputPartition):
    """Rows of a file's table with rowids from low to high, or all of a table that has none."""

    def __init__(self, path: str, low: int | None, high: int | None):
        self.path, self.low, self.high = path, low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, files: list[str], table: str, rows: int):
        self.names, self.files, self.table, self.rows = [f.name for f in schema][:-1], files, table, rows

    def partitions(self) -> list[_Range]:
        out = []
        for path in self.files:
            with _open(path) as c:
                if (name := _tables(c).get(self.table)) is None:
                    continue
                try:
                    low, high = c.execute(f"select min(rowid), max(rowid) from {_quoted(name)}").fetchone()
                except sqlite3.OperationalError:  # a view, or a table without rowid
                    out.append(_Range(path, None, None))
                    continue
                if low is not None:
                    out += [_Range(path, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]
        return out or [_Range("", None, None)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        entity = (["", *partition.path.split("/")])[-2]
        with _open(partition.path) as c:
            name = _tables(c)[self.table]
            have = {x[1].lower(): x[1] for x in c.execute(f"pragma table_info({_quoted(name)})")}
            picked = ", ".join(f"cast({_quoted(have[n.lower()])} as text)" if n.lower() in have else "null" for n in self.names) or "null"
            where = "" if partition.low is None else f" where rowid between {partition.low} and {partition.high}"
            rows = c.execute(f"select {picked} from {_quoted(name)}{where}")
            while some := rows.fetchmany(BATCH):
                columns = list(zip(*some, strict=True))[: len(self.names)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in columns), pa.array([entity] * len(some), pa.string())], [*self.names, "entity_id"])


class SqliteSource(DataSource):
    """Options: table (one of TABLES), path (one or more glob patterns, split by commas), rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_tables"

    def _asked(self) -> tuple[list[str], str]:
        return _files(self.options["path"]), self.options["table"].lower()

    def schema(self) -> T.StructType:
        """The columns of all files' tables, in the order in which they come first, as text; then entity_id."""
        files, table = self._asked()
        names: dict[str, str] = {}
        for f in files:
            for c in _columns(f, table):
                names.setdefault(c.lower(), c)
        names.pop("entity_id", None)
        return T.StructType([*(T.StructField(c, T.StringType()) for c in names.values()), T.StructField("entity_id", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        files, table = self._asked()
        return SqliteReader(schema, files, table, int(self.options.get("rows", RANGE_ROWS)))


def read_databases(spark: SparkSession, path: str, tables: list[str] = TABLES, rows: int = RANGE_ROWS) -> dict[str, DataFrame]:
    """SRC-05: those of the tables that any of the files holds, each of all files together; files without any raise a ValueError."""
    spark.dataSource.register(SqliteSource)
    files = _files(path)
    found = {t for f in files for t in _present(f)}
    if empty := [f for f in files if not set(_present(f)) & set(tables)]:
        raise ValueError(f"{empty[0]} holds none of the tables {', '.join(tables)}")
    return {t: spark.read.format("sqlite_tables").option("table", t).option("rows", rows).load(path) for t in tables if t in found}


def _present(path: str) -> list[str]:
    with _open(path) as c:
        return list(_tables(c))
