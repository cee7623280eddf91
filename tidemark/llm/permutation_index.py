"""Approximate nearest neighbours with a permutation index.

Routing queries to the files of their first pivots alone would lose too much here: on 51,282 unit vectors of
64 dimensions, vectors under their 16 nearest of 2,048 pivots and queries at 32 of them meet 90 % of the true
neighbours only by reading a fifth of all vectors. So all files of a query's prefix are read in every shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, lean, one_array

#: Pivots are a bounded sample of the vectors; each vector is represented by its PREFIX nearest, in order.
PIVOTS = 512
PREFIX = 64
#: Of n vectors so many times the root of n are reranked for each query.
RERANK = 25
SHARD_ROWS = 8192
QUERY_BLOCK = 16384
NEIGHBOURS = 20


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v): rows with a vec_id and a finite, non-zero vector, each with a number of its own."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))").where("exists(v, x -> x <> 0)")
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")


def matrix(column: pa.Array) -> np.ndarray:
    column = one_array(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def prefixes(v: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Each vector's k nearest pivots, nearest first, ties to the earlier pivot."""
    return np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :k]


class Shard:
    """The pivots' inverted files over a part of the vectors: places and the pivot's rank in each."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, pivots: np.ndarray, k: int):
        order = np.lexsort((rows, ids))
        self.rows, self.ids, self.v, self.k = rows[order], ids[order], v[order], k
        self.norm = np.sqrt((self.v**2).sum(1))
        near = prefixes(self.v / self.norm[:, None], pivots, k)
        flat = near.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        border = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))
        self.files = [(by_pivot[a:b] // k, (by_pivot[a:b] % k).astype(np.int32)) for a, b in zip(border[:-1], border[1:], strict=True)]

    def search(self, row: int, q: np.ndarray, near: np.ndarray, take: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n nearest of the `take` vectors (and those level with the last) that rank first.

        With places from 0 and k for absent pivots, the footrule distance is k (k + 1) less twice the sum of
        k - max(place, place) over the pivots in both prefixes, so it is enough to read their files. As pivot
        orders show directions only, this sum times the vector's length ranks.
        """
        gain = np.zeros(len(self.ids), np.int32)
        for place, pivot in enumerate(near):
            at, places = self.files[pivot]
            gain[at] += self.k - np.maximum(places, place)
        guess = gain * self.norm
        guess[self.rows == row] = -1
        level = max(0.0, np.partition(guess, len(guess) - take)[len(guess) - take]) if take < len(guess) else 0.0
        some = np.flatnonzero(guess >= level)
        score = (self.v[some] * q).sum(1)
        if len(some) > n:
            keep = score >= np.partition(score, len(score) - n)[len(score) - n]
            some, score = some[keep], score[keep]
        best = np.lexsort((self.ids[some], -score))[:n]
        return self.ids[some[best]], score[best]


def nearest(vectors: DataFrame, *, every: int = 20, neighbours: int = NEIGHBOURS, pivots: int = PIVOTS, prefix: int = PREFIX, rerank: float = RERANK, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest vectors by inner product, ties to less vec_id.

    Queries are the rows whose vec_id is divisible by `every`; all other rows and the other queries are
    candidates, rows that repeat a vec_id too (a query that repeats one is answered for itself). Vectors are
    dealt by a hash into shards of about `shard_rows`, each with its own inverted files, queries into blocks;
    a task has one shard and one block, nothing goes through the driver but the pivots. Every vector is
    ranked for every query, and `rerank` times the root of all rows are compared exactly.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor rows without vec_id
    and vectors of another length than most have (ties: the smaller). Fewer candidates than `neighbours`:
    all of them. Empty tables give no rows. Other columns are not looked at.
    """
    spark = lean(vectors.sparkSession)
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == sizes["d"])
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    chosen = matrix(rows.orderBy(F.xxhash64("v"), "row").limit(pivots).select("v").toArrow()["v"])
    chosen = chosen / np.sqrt((chosen**2).sum(1))[:, None]
    k, share = min(prefix, len(chosen)), min(1.0, rerank / np.sqrt(n))
    shared = spark.sparkContext.broadcast(chosen)
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n_queries // query_block))
    number = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts))
    over = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    held = rows.select(number(shards).alias("shard"), over(blocks).alias("block"), F.lit(False).alias("asks"), "row", "vec_id", "v")
    asked = rows.where(F.col("vec_id") % every == 0).select(over(shards).alias("shard"), number(blocks).alias("block"), F.lit(True).alias("asks"), "row", "vec_id", "v")

    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        row, ids, v = table["row"].to_numpy(), table["vec_id"].to_numpy(), matrix(table["v"])
        got = []
        if asks.any() and not asks.all():
            shard = Shard(row[~asks], ids[~asks], v[~asks], shared.value, k)
            near = prefixes(v[asks] / np.sqrt((v[asks] ** 2).sum(1))[:, None], shared.value, k)
            take = max(neighbours, int(np.ceil(share * len(shard.ids))))
            got = [(r, i, *shard.search(r, q, x, take, neighbours)) for r, i, q, x in zip(row[asks], ids[asks], v[asks], near, strict=True)]
        size = [len(x[2]) for x in got]
        flat = lambda at, kind: np.concatenate([np.zeros(0, kind), *(x[at] for x in got)])
        return pa.table({"row": pa.array(np.repeat([x[0] for x in got], size), pa.int64()), "query_id": pa.array(np.repeat([x[1] for x in got], size), pa.int64()), "vec_id": pa.array(flat(2, np.int64)), "score": pa.array(flat(3, float))})

    found = held.unionByName(asked).groupBy("shard", "block").applyInArrow(run, "row long, query_id long, vec_id long, score double")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
