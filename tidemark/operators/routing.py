"""Key ranges: routing keys to partitions and lookups in partition runs."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import cut
from .merge import newest_wins, visible

#: Up to so many start keys an array literal that each row searches routes.
ARRAY_STARTS = 512
#: Up to so many start keys, and bytes of them, are sent to all tasks and bisected; more of them are merged by a sort.
SENT_STARTS, SENT_BYTES = 1_000_000, 64 << 20


def route(keys: DataFrame, starts: DataFrame, *, strict: bool = False, array_starts: int = ARRAY_STARTS, sent_starts: int = SENT_STARTS) -> DataFrame:
    """`keys` with start_key, the greatest start that is not above the key (null if there is none).

    `starts` has start_key; null ones don't count. Keys compare by their bytes; a null key has no start.
    The result is the same on each of three ways, of which the number of starts chooses one.
    `strict` raises an error for a key below all starts.
    """
    found = starts.select("start_key").where("start_key is not null").distinct()
    n, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("start_key")), F.lit(0))).first()
    rows = keys.drop("start_key")
    if n <= array_starts:
        bounds = sorted(r["start_key"] for r in found.collect()) if n else []
        array = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<string>")
        out = rows.withColumn("start_key", F.array_max(F.filter(array, lambda b: b <= F.col("key"))))
    elif n <= sent_starts and size <= SENT_BYTES:
        out = _bisect_route(rows, found)
    else:
        out = _merge_route(rows, found)
    if strict:
        below = F.raise_error(F.concat(F.lit("no partition for key "), F.col("key")))
        out = out.withColumn("start_key", F.when(F.col("start_key").isNull() & F.col("key").isNotNull(), below).otherwise(F.col("start_key")))
    return out


def _bisect_route(keys: DataFrame, starts: DataFrame) -> DataFrame:
    """Each task bisects the sorted starts: no shuffle."""
    sent = keys.sparkSession.sparkContext.broadcast(sorted(x.encode() for x in starts.toArrow()["start_key"].to_pylist()))
    at = keys.columns.index("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = sent.value
        for batch in batches:
            places = (0 if k is None else bisect_right(bounds, k.encode()) for k in batch.column(at).to_pylist())
            got = pa.array([bounds[p - 1].decode() if p else None for p in places], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, "start_key"])

    return keys.mapInArrow(run, keys.withColumn("start_key", F.lit(None).cast("string")).schema)


def _merge_route(keys: DataFrame, starts: DataFrame) -> DataFrame:
    """Distinct keys and starts are sorted together by ranges; a range takes the last start before it along.

    The ranges are written once with their numbers, so that all that follows sees the same ones. A key with
    very many rows is one row in its range; Spark splits it in the join back.
    """
    both = keys.select("key", F.lit(1).alias("__k")).where("key is not null").distinct().union(starts.select("start_key", F.lit(0)))
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(both.repartitionByRange(parts, "key").withColumn("__p", F.spark_partition_id()), "ranges")
    last = dealt.groupBy("__p").agg(F.max(F.when(F.col("__k") == 0, F.col("key"))).alias("__m"))
    # One row for each range: the window goes over `parts` rows.
    carried = last.withColumn("__c", F.max("__m").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).select("__p", "__c")
    inside = Window.partitionBy("__p").orderBy("key", "__k").rowsBetween(Window.unboundedPreceding, 0)
    got = dealt.withColumn("__s", F.last(F.when(F.col("__k") == 0, F.col("key")), ignorenulls=True).over(inside)).where("__k = 1")
    got = got.join(F.broadcast(carried), "__p").select("key", F.coalesce("__s", "__c").alias("start_key"))
    return keys.join(got, "key", "left").select(*keys.columns, "start_key")


def groups(routed: DataFrame) -> DataFrame:
    """(start_key, n_keys, first_key, last_key) of each partition that keys were routed to."""
    return routed.groupBy("start_key").agg(F.countDistinct("key").alias("n_keys"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def runs(partitions: DataFrame) -> DataFrame:
    """(start_key, path, run_pos): a partition's runs by place; a later place is newer."""
    return partitions.select("start_key", F.posexplode("runs").alias("run_pos", "path"))


def partition_lookup(keys: DataFrame, partitions: DataFrame, records: DataFrame) -> DataFrame:
    """(key, value) of the keys that are visible in the runs of the partition they route to.

    `records` has path; the newest run that holds a key decides it, and a tombstone hides older runs.
    """
    wanted = route(keys.select("key").distinct(), partitions)
    placed = records.join(runs(partitions), "path")
    return visible(newest_wins(placed.join(wanted, ["key", "start_key"]), ["run_pos"], keep=["value", "tombstone"])).select("key", "value")
