"""Multi-key lookups over one file or over tiers of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .merge import newest_wins, visible


def key_set(keys: DataFrame) -> DataFrame:
    """The distinct requested keys."""
    return keys.select("key").where("key is not null").distinct()


def of_keys(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Records of the requested keys; Spark broadcasts the keys if its statistics say that they are few."""
    return records.join(key_set(keys), "key", "left_semi")


def file_lookup(records: DataFrame, keys: DataFrame, order: list[str]) -> DataFrame:
    """(key, outcome, value) with outcome found, deleted or missing, in one file.

    Of several records of a key in a file the last by `order` counts.
    """
    best = newest_wins(of_keys(records, keys), order, keep=["value", "tombstone"])
    outcome = F.when(F.col("tombstone").isNull(), "missing").when(F.col("tombstone"), "deleted").otherwise("found")
    return key_set(keys).join(best, "key", "left").select("key", outcome.alias("outcome"), "value")


def deciding(records: DataFrame, keys: DataFrame, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The record that decides each requested key that any tier holds, tombstones included.

    `order` sorts tiers and files from old to new. All files are read at once and one aggregation takes
    the place of probing tier after tier with the keys that remain.
    """
    return newest_wins(of_keys(records, keys), order, keep=keep)


def batch_get(records: DataFrame, keys: DataFrame, order: list[str]) -> DataFrame:
    """(key, value) of the requested keys that are visible; missing and deleted keys have no row."""
    return visible(deciding(records, keys, order, ["value", "tombstone"])).select("key", "value")


def remaining_by_file(records: DataFrame, keys: DataFrame, file_rank: str) -> DataFrame:
    """(rank, remaining): requested keys that no file of a smaller rank (newer) has decided.

    A file is probed only while keys remain.
    """
    wanted = key_set(keys)
    first = of_keys(records, keys).groupBy("key").agg(F.min(file_rank).alias("decided"))
    per_file = first.groupBy("decided").agg(F.count(F.lit(1)).alias("n"))
    ranks = records.select(F.col(file_rank).alias("rank")).distinct()
    total = wanted.agg(F.count(F.lit(1)).alias("total"))
    # One row for each file: the running sum goes over these.
    earlier = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before = ranks.join(per_file, F.col("decided") == F.col("rank"), "left").withColumn("gone", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return before.crossJoin(F.broadcast(total)).select("rank", (F.col("total") - F.col("gone")).alias("remaining")).where("remaining > 0")


def request_error(path: Column, keys: Column) -> Column:
    """Why a request for an array of keys in a file is refused, or null: an empty path, or no keys."""
    return F.when(F.coalesce(path, F.lit("")) == "", "object path is empty").when(F.coalesce(F.size(keys), F.lit(0)) <= 0, "no keys")


def as_map(rows: DataFrame) -> DataFrame:
    """One row with the response as a map; for small responses."""
    return rows.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("values"))
