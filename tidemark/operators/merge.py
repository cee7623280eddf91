"""Newest-wins merging of records, and what follows from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.varint import VERSION, raw_size, record_size


def concat(files: list[DataFrame]) -> DataFrame:
    """All records of several files."""
    return reduce(DataFrame.unionByName, files)


def newest_wins(records: DataFrame, order: list[str], by: list[str] = ["key"], keep: list[str] | None = None) -> DataFrame:  # noqa: B006
    """For each key the record that is last by `order`, tombstones included; all its columns, or those of `keep`.

    One shuffle by key, after each task has kept its own newest record of every key, so a key with many
    versions sends one row from each task. `order` has to tell all versions of a key apart.
    """
    rest = [c for c in records.columns if c not in by] if keep is None else keep
    best = records.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*by, *(F.col("r")[c].alias(c) for c in rest))


def visible(records: DataFrame) -> DataFrame:
    return records.where(~F.col("tombstone")).drop("tombstone")


def live(records: DataFrame, order: list[str]) -> DataFrame:
    """The keys that are visible now, with their values."""
    return visible(newest_wins(records, order, keep=["value", "tombstone"]))


def sealed(records: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """A batch ready to be a file: the last change of each key, in key order within partitions."""
    return newest_wins(records, [ordinal]).drop(ordinal).sortWithinPartitions("key")


def batch_stats(records: DataFrame, by: list[str]) -> DataFrame:
    """Key range, records, raw bytes and encoded bytes of each file."""
    size = record_size(F.col("key"), F.col("value"), F.col("tombstone"))
    return records.groupBy(*by).agg(
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.count(F.lit(1)).alias("n_records"),
        F.sum(raw_size(F.col("key"), F.col("value"))).alias("raw_bytes"),
        (F.sum(size) + VERSION).alias("size_bytes"),
    )
