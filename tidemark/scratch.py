"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .sources.location import open_fs

OWN = "spark.tidemark.shared.dir"
#: Rows of a file of an intermediate table whose size is known.
FILE_ROWS = 100_000
_made: list[str] = []


class NoSharedFolder(RuntimeError):
    """On a cluster spark.checkpoint.dir has to name a folder that all executors see."""


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one of ours, which only local mode can share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN, None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise NoSharedFolder(f"spark.checkpoint.dir is unset, and executors of {master} don't see the driver's folders")
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set(OWN, at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is there at the application's end is deleted."""
    if not _made:
        atexit.register(clear)
    _made.append(f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _delete(path: str) -> None:
    with contextlib.suppress(Exception):  # what can't be deleted now only takes space
        fs, at = open_fs(path)
        fs.delete_dir(at)


def clear() -> None:
    """Deletes all intermediate tables so far: for a session that goes on after it has used its results."""
    while _made:
        _delete(_made.pop())


def cut(df: DataFrame, name: str = "cut", rows: int | None = None) -> DataFrame:
    """The same rows read from a table written to the shared folder: lineage ends there.

    `rows` is a bound of their number; the table then has no more files than these rows need.
    """
    spark = df.sparkSession
    at = shared_path(spark, name)
    (df if rows is None else df.repartition(max(1, -(-rows // FILE_ROWS)))).write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._tidemark_at = at  # type: ignore[attr-defined]
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that `cut` made and that nothing will read again."""
    at = getattr(df, "_tidemark_at", None)
    if at in _made:
        _made.remove(at)
        _delete(at)
