"""Guarded changes of the file list: all of the named files qualify, or nothing happens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def qualifies(files: DataFrame, ids: list[int], state: str | None) -> Column | DataFrame:
    """One row, ok: whether every id names a file in `state`. No ids, or one id twice, is false."""
    hit = F.col("seq_no").isin(ids) if ids else F.lit(False)
    if state is not None:
        hit = hit & (F.col("state") == state)
    return files.agg((F.count_if(hit) == len(ids)).alias("same")).select((F.col("same") & F.lit(bool(ids))).alias("ok"))


def mark(files: DataFrame, ids: list[int], before: str, after: str) -> DataFrame:
    """`files` with the named ones moved from one state to the next, if all of them are in the first."""
    changed = F.when(F.col("ok") & F.col("seq_no").isin(ids), F.lit(after)).otherwise(F.col("state"))
    return files.crossJoin(F.broadcast(qualifies(files, ids, before))).withColumn("state", changed)


def delete(files: DataFrame, ids: list[int], state: str | None) -> DataFrame:
    """`files` less the named ones, if all of them are in `state`."""
    return files.crossJoin(F.broadcast(qualifies(files, ids, state))).where(~(F.col("ok") & F.col("seq_no").isin(ids)))


def compaction_due(files: DataFrame, least: int = 16) -> DataFrame:
    """One row: new files, and whether they are enough to compact."""
    return files.agg(F.count_if((F.col("tier") == "wal") & (F.col("state") == "NEW")).alias("n_new")).withColumn("due", F.col("n_new") >= least)


def overlapping(files: DataFrame, least_key: str, greatest_key: str) -> DataFrame:
    """The files whose key range can hold a key of the span; a file without a range can hold any."""
    below = F.col("min_key").isNull() | (F.col("min_key") <= greatest_key)
    above = F.col("max_key").isNull() | (F.col("max_key") >= least_key)
    return files.where(below & above)
