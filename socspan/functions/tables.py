"""Tables in the shared folder: lineage ends in them, so a lost executor costs no more than the step since."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the files exchanged for an action are removed when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that were named within temporary(), if one is entered.
_MADE: ContextVar[list[str] | None] = ContextVar("_MADE", default=None)


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
            fs, name = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
            if fs.get_file_info(name).type == pafs.FileType.Directory:
                fs.delete_dir(name)


def write(df: DataFrame, path: str) -> None:
    """Writes df as Parquet; what was exchanged for it is removed at once, not when the driver next collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEAN, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read back."""
    path = shared_dir(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, written and read back; all else that was written for it is removed."""
    path = shared_dir(spark, name)
    with temporary():
        out = make()
        write(out, path)
    return spark.read.schema(out.schema).parquet(path)
