"""Deterministic keys, values and key choices of the load generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
CLASSES = {"written": "W", "unwritten": "U", "deleted": "D"}


def filler(length: Column) -> Column:
    """The alphabet, again and again, up to a length."""
    return F.substring(F.repeat(F.lit(ALPHABET), (length / len(ALPHABET) + 1).cast("int")), F.lit(1), length)


def load_key(kind: Column, index: Column, size: int = 16) -> Column:
    """Class letter, four digits, underscore, then filler up to `size` characters."""
    head = F.format_string("%s%04d_", kind, index)
    return F.concat(head, filler(F.greatest(F.lit(0), F.lit(size) - F.length(head))))


def load_keys(spark: SparkSession, per_class: int = 30, size: int = 16) -> DataFrame:
    """(kind, index, key) for all classes."""
    kinds = F.explode(F.array(*map(F.lit, CLASSES.values()))).alias("kind")
    return spark.range(per_class).select(kinds, F.col("id").alias("index")).withColumn("key", load_key(F.col("kind"), F.col("index"), size))


def chosen_class(mode: str, i: Column) -> Column:
    """The class of keys that the i-th read asks for; `mixed` takes the three in turn."""
    if mode == "mixed":
        turn = F.pmod(i, F.lit(3))
        return F.when(turn == 0, "W").when(turn == 1, "U").otherwise("D")
    return F.lit({"written": "W", "notwritten": "U", "deleted": "D"}[mode])
