import numpy as np
import pytest
from tidemark.llm.permutation_index import Shard, nearest, prefixes


def brute(rows, every, n):
    out = []
    for i, q in rows:
        if i % every == 0:
            got = sorted((-float((np.array(v, float) * np.array(q, float)).sum()), j) for j, v in rows if j != i)[:n]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(got)]
    return out


def test_gain_is_footrule_distance():
    rng = np.random.default_rng(0)
    v, pivots, k = rng.normal(size=(30, 5)), rng.normal(size=(9, 5)), 4
    near = prefixes(v, pivots, k)
    pivots /= np.linalg.norm(pivots, axis=1)[:, None]
    near = prefixes(v / np.linalg.norm(v, axis=1)[:, None], pivots, k)
    shard = Shard(np.arange(30), np.arange(30), v, pivots, k)
    for q in range(30):
        place = {p: i for i, p in enumerate(near[q])}
        distance = [sum(abs(place.get(p, k) - ({x: i for i, x in enumerate(near[r])}).get(p, k)) for p in range(9)) for r in range(30)]
        gain = np.zeros(30, int)
        for i, p in enumerate(near[q]):
            rows, places = shard.files[p]
            gain[rows] += k - np.maximum(places, i)
        assert [k * (k + 1) - 2 * g for g in gain] == distance


@pytest.mark.parametrize("spread", [0, 0.5, 1, 2])
def test_recall_and_exact_scores(spark, spread):
    """Unit vectors, and lengths spread by a log-normal factor; two shards, several blocks of queries."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 32)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v *= np.exp(rng.normal(size=(3000, 1)) * spread).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in nearest(df, every=50, shard_rows=1500, query_block=25).collect()]
    want = brute(rows, 50, 20)
    pairs = {(a, c): s for a, _, c, s in want}
    hits = [(a, c, s) for a, _, c, s in got if (a, c) in pairs]
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)
    assert all(s == pytest.approx(pairs[a, c], rel=1e-12) for a, c, s in hits)
    assert sorted(r for a, r, *_ in got if a == 0) == list(range(1, 21))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [inf, 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (1, [1.0, 0.0]), (20, [0.0, 2.0])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<double>, rank string")
    assert sorted(map(tuple, nearest(df).collect())) == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 3, 0.5), (0, 5, 20, 0.0), (20, 1, 3, 2.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 1, 0.0), (20, 5, 2, 0.0)]
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, nearest(twice).collect())) == [(0, 1, 1, 1.0), (0, 1, 1, 2.0), (0, 2, 0, 0.0), (0, 2, 0, 0.0)]
    assert nearest(df.limit(0)).count() == 0
    same = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(900)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in nearest(same, shard_rows=300).where("query_id = 40").orderBy("rank").collect()] == list(range(20))
