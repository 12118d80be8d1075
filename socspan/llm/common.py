"""Shared folder, written tables and file access for the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Rows of an Arrow batch sent to Python. Texts vary from a word to megabytes, so batches are kept short.
BATCH_ROWS = 500


#: Folders that were named within temporary(), if one is entered.
_MADE: ContextVar[list[str] | None] = ContextVar("_MADE", default=None)


def refuse(df: DataFrame, *names: str) -> DataFrame:
    """df, if none of its columns has one of these names, which an operator adds or uses; else a ValueError says which."""
    if clash := sorted({c for c in df.columns if c.lower() in {n.lower() for n in names}}):
        raise ValueError(f"columns named {', '.join(clash)} are in the way; rename them first")
    return df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors see.

    Where that setting is missing in a local session (as in tests), a temporary
    folder of this machine is set as checkpoint folder first; a cluster must
    name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="socspan-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


@contextmanager
def temporary() -> Iterator[None]:
    """Removes on the way out the folders of shared_dir() and written() that were named within; nothing may read them after that."""
    token = _MADE.set(made := [])
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            fs, name = file_at(path)
            if fs.get_file_info(name).type == pafs.FileType.Directory:
                fs.delete_dir(name)


def short_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python small enough for long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(key, str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read back: lineage ends here."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_at(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system that holds a URI or an absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def struct_of(columns: str) -> T.StructType:
    """The struct of "name type, name type"; unlike a DDL string it needs no session when a module is imported."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(", "))])
