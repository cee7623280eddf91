"""File attributes as JSON with 64-bit integers as strings and empty fields left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "path string, createdAt string, sizeBytes string, minKey string, maxKey string"


def time_text(at: Column) -> Column:
    """A time stamp in UTC with no, three or six digits of the second's fraction, as many as it needs."""
    micros = F.pmod(F.unix_micros(at), F.lit(1_000_000))
    digits = F.when(micros == 0, "").when(micros % 1000 == 0, F.concat(F.lit("."), F.lpad((micros / 1000).cast("int").cast("string"), 3, "0"))).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), digits, F.lit("Z"))


def to_attrs(path: Column, created_at: Column, size_bytes: Column, min_key: Column, max_key: Column) -> Column:
    filled = lambda c: F.nullif(c, F.lit(""))
    stamp = time_text(created_at)
    size = F.when(size_bytes != 0, size_bytes.cast("string"))
    return F.to_json(F.struct(filled(path).alias("path"), stamp.alias("createdAt"), size.alias("sizeBytes"), filled(min_key).alias("minKey"), filled(max_key).alias("maxKey")))


def from_attrs(attrs: Column) -> Column:
    """A struct of path, created_at, size_bytes, min_key and max_key; absent fields are empty or zero."""
    x = F.from_json(attrs, SCHEMA)
    return F.struct(
        F.coalesce(x["path"], F.lit("")).alias("path"),
        F.to_timestamp(x["createdAt"]).alias("created_at"),
        F.coalesce(x["sizeBytes"].cast("long"), F.lit(0)).alias("size_bytes"),
        F.coalesce(x["minKey"], F.lit("")).alias("min_key"),
        F.coalesce(x["maxKey"], F.lit("")).alias("max_key"),
    )
