"""Which node serves a file: a hash of its path, modulo the nodes, and the next ones where it is down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLICAS = 2


def slot(path: Column, nodes: Column | int, hashed: Column | None = None) -> Column:
    """The place on a ring of `nodes`; by xxhash64 of the path unless a hash is given."""
    n = F.lit(nodes) if isinstance(nodes, int) else nodes
    return F.pmod(F.xxhash64(path) if hashed is None else hashed, n.cast("long"))


def replicas(path: Column, nodes: int, count: int = REPLICAS, hashed: Column | None = None) -> Column:
    """The nodes of a file in the order in which they are tried: its slot and those after it, each once."""
    first = slot(path, nodes, hashed)
    return F.array(*(F.pmod(first + k, F.lit(nodes).cast("long")) for k in range(min(count, nodes))))


def place(files: DataFrame, nodes: int, down: list[int] = [], *, count: int = REPLICAS, hashed: Column | None = None) -> DataFrame:  # noqa: B006
    """`files` (path) with node, the first of each file's replicas that isn't down; null where all are."""
    up = F.filter(replicas(F.col("path"), nodes, count, hashed), lambda k: ~k.isin(*down) if down else F.lit(True))
    return files.withColumn("node", F.get(up, 0))
