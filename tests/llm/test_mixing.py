import random

import duckdb
import pytest
from tidemark.llm import mixing


def fill(sizes, weights, cap):
    """Targets by sharing the excess again until none is above."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    rest = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if rest * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = rest * weights[i] / w
            break
        for i in over:
            target[i] = cap * sizes[i]
            rest -= target[i]
            open_.discard(i)
    return target


def sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_apportion_against_one_seat_after_the_other(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for g in range(12):
        votes, seats = [rng.choice([0, 1, 5, 50, 1000]) + g % 3 for _ in range(rng.randint(1, 9))], rng.choice([0, 1, 7, 300])
        if not sum(votes):
            seats = 0
        for k, (v, s) in enumerate(zip(votes, sainte_lague(votes, seats) if sum(votes) else [0] * len(votes), strict=True)):
            rows.append((g, k, v, seats))
            want[g, k] = s
    df = spark.createDataFrame(rows, "g int, k int, v long, seats long")
    assert {(r.g, r.k): r.won for r in mixing.apportion(df, ["g"], "v", "seats", ["k"], "won").collect()} == want


def test_apportion_with_room(spark):
    """No party gets more than its room; what full ones can't take goes on by quotients of the others."""
    rng = random.Random(2)
    rows = []
    for g in range(30):
        seats = rng.choice([0, 3, 40, 500])
        for k in range(rng.randint(1, 7)):
            rows.append((g, k, rng.choice([0, 1, 5, 50, 1000]), seats, rng.choice([0, 1, 10, 100, 1000])))
    df = spark.createDataFrame(rows, "g int, k int, v long, seats long, room long")
    got = {(r.g, r.k): r.won for r in mixing.apportion(df, ["g"], "v", "seats", ["k"], "won", "room").collect()}
    for g in range(30):
        mine = [r for r in rows if r[0] == g]
        able = sum(r[4] for r in mine if r[2])
        won = [got[g, r[1]] for r in mine]
        assert all(w <= r[4] for w, r in zip(won, mine)) and sum(won) == min(mine[0][3], able), (mine, won)
        open_ = [(r[2], w) for r, w in zip(mine, won) if w < r[4] and r[2]]
        if open_:  # whoever has room has had no higher quotient left than the lowest that others won with, but for a seat
            assert max(v / (2 * w + 3) for v, w in open_) <= min((v / (2 * w - 1) for v, w in open_ if w), default=1e18)


def documents(seed, n=300):
    rng = random.Random(seed)
    sources = ["hot"] * 12 + ["a", "b", "Z", "é", None, "tiny"]
    return [(k if k % 40 else None, rng.choice(sources), " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 30, 200])))) for k in range(n)]


@pytest.mark.parametrize("shard,block,group", [(8, 1, 2), (1024, 1, 1024), (4, 37, 3), (4, 500, 3)])
def test_targets_and_takings(spark, shard, block, group):
    docs = documents(3)
    df = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, source string, text string, size string")
    got = mixing.mix_sources(df, shard_docs=shard, block=block, group_shards=group).collect()
    again = mixing.mix_sources(df.repartition(7), shard_docs=shard, block=block, group_shards=group).collect()
    key = lambda r: str((r.doc_id, r.source, r["size"], r.taken))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(docs)
    names = sorted({s for _, s, _ in docs if s is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len(t.split()) for _, s, t in docs if s == n) for n in names]
    want = dict(zip(names, fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    for n, size in zip(names, sizes, strict=True):
        mine = [r for r in got if r.source == n]
        assert {r.source_size for r in mine} == {size} and all(r.target == pytest.approx(want[n]) for r in mine)
        # As far as whole blocks of each shard go, a source comes within a block of its target.
        able = 3 * size - 3 * block * -(-len(mine) // shard)  # each shard may lose parts of blocks
        taken = sum(r.taken for r in mine)
        assert min(want[n], able) - block <= taken <= 3 * size
        if block == 1:
            assert abs(taken - want[n]) <= 1
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)


@pytest.mark.parametrize("shard,group,limit", [(1024, 1024, 100_000), (8, 2, 100_000), (8, 2, 0)])
def test_sql_is_the_same(spark, monkeypatch, shard, group, limit):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
    docs = [d for d in documents(5) if d[0] is not None]
    docs += [docs[7]] * 5 + [docs[8]] * 3
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    sql = mixing.SQL.replace(f"docs / {mixing.SHARD_DOCS}", f"docs / {shard}").replace(f"shard // {mixing.GROUP_SHARDS}", f"shard // {group}")
    want = sorted(con.execute(sql.format(documents="documents")).fetchall())
    assert sorted(tuple(r) for r in mixing.mix_sources(df, shard_docs=shard, group_shards=group).select("doc_id", "size", "source_size", "target", "taken").collect()) == want


def test_edges(spark):
    one = spark.createDataFrame([(1, None, None), (1, None, None), (2, None, "a b c"), (3, None, "x " * 100000)], "doc_id long, source string, text string")
    got = {(r.doc_id, r["size"], r.taken) for r in mixing.mix_sources(one).collect()}
    assert got == {(1, 0, 0), (2, 3, 3), (3, 100000, 100000)}
    assert mixing.mix_sources(one.limit(0)).count() == 0
    none = mixing.mix_sources(one.where("doc_id = 1")).collect()
    assert [(r.target, r.taken) for r in none] == [(0.0, 0)] * 2
    plan = mixing.mix_sources(one)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
