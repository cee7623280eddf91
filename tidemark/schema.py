"""Row types: records, mutations, and the manifest's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One key's state in one file; `value` is null for a tombstone.
RECORD = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("value", T.BinaryType()),
        T.StructField("tombstone", T.BooleanType(), False),
    ]
)
#: One requested change; `ordinal` is its place among the changes of a request.
MUTATION = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("put", T.BinaryType()),
        T.StructField("delete", T.BooleanType()),
        T.StructField("ordinal", T.LongType(), False),
    ]
)
#: One immutable file: tier `wal`, `shared_run` or `partition`; a partition's runs also have a start key and a place.
FILE = T.StructType(
    [
        T.StructField("tier", T.StringType(), False),
        T.StructField("seq_no", T.LongType(), False),
        T.StructField("state", T.StringType()),
        T.StructField("path", T.StringType(), False),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("min_key", T.StringType()),
        T.StructField("max_key", T.StringType()),
        T.StructField("source_seq", T.LongType()),
        T.StructField("start_key", T.StringType()),
        T.StructField("run_pos", T.IntegerType()),
    ]
)
NEW, COMPACTING = "NEW", "COMPACTING"
TIERS = ("wal", "shared_run", "partition")


def records(mutations: DataFrame, *keep: str) -> DataFrame:
    """Mutations as records: delete wins over put, and neither of them is a put of an empty value."""
    tombstone = F.coalesce(F.col("delete"), F.lit(False))
    value: Column = F.when(~tombstone, F.coalesce(F.col("put"), F.lit(b"")))
    return mutations.select("key", value.alias("value"), tombstone.alias("tombstone"), *keep)


def invalid_writes(mutations: DataFrame) -> DataFrame:
    """The mutations that make their request fail: those with an empty or missing key."""
    return mutations.where("key is null or key = ''")
