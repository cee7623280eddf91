import random

import numpy as np
import pytest
from tidemark.llm import ngram_join
from tidemark.llm.common import mix
from tidemark.llm.ngram_join import Hot, block_keys, classes, components, keep_one, similarity_classes


def shingles(text, k=5):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(docs, percent=80):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * 100 >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(docs)), key=str)


def made(rng, n, words=40):
    """Families of texts, each a base with few or many words replaced, chains of changes, and copies."""
    docs = []
    while len(docs) < n:
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 5, 6, 9, words, 3 * words]))]
        text = list(base)
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            docs.append((len(docs), " ".join(text)))
            if rng.random() < 0.5:
                text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = f"W{rng.randrange(400)}"
    return docs


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 4, 5, 7, 9, 10, 11, 12, 30, 77, 300, 1500):
        for _ in range(40 if n < 300 else 6):
            m = rng.integers(-(-80 * n // 100), n + 1)  # the smaller size
            union_limit = n
            common = -(-80 * (n + m) // 180)
            while common * 100 < 80 * (n + m - common):
                common += 1
            if common > m:
                continue
            x = mix(rng.integers(0, 1 << 63, n + m - common, dtype=np.uint64))
            a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:common], x[n:]]))
            for hot in (0, n // 3, n):
                hot = Hot(rng.choice(np.union1d(a, b), hot, replace=False)) if hot else None
                assert len(np.intersect1d(block_keys(a, 80, hot), block_keys(b, 80, hot))), (n, m, common)
            assert union_limit


def test_against_brute_force(spark, monkeypatch):
    docs = made(random.Random(11), 260)
    rng = random.Random(4)
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for params, limit in (({}, 1_000_000), ({"group": 3, "chunk": 2}, 0)):
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", limit)
        monkeypatch.setattr(ngram_join, "LOCAL_LINKS", limit)
        got = similarity_classes(df, **params)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(docs)


def test_edges(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = [(None, text), (5, text + " x"), (3, None), (4, ""), (4, ""), (7, "a b"), (8, "A B"), (9, "a b c"), (10, None), (11, "z " * 60000), (12, "z z z z z z"), (13, text), (13, "q r s t u v"), (14, "q r s t u v")]
    df = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, node string")
    got = similarity_classes(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == [x if x[1] else (x[0], 0, x[0]) for x in brute(docs)]
    assert similarity_classes(df.limit(0)).count() == 0
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [3, 4, 4, 10, 5, 7, 9, 11, 13]))


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(ngram_join, "LOCAL_LINKS", limit)
    links = [(k, k + 1) for k in range(40)] + [(100, 101)]
    got = {(r.node, r.comp) for r in components(spark.createDataFrame(links, "a long, b long"), 41).collect()}
    assert got == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}
    rng = random.Random(3)
    links = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long"), 260).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), 0).count() == 0


def test_links_are_all_counted(spark):
    """Families of more than GROUP variants, of which some are linked and others only through a third."""
    rng = random.Random(5)
    docs = []
    for family in range(2):
        base = [f"f{family}w{k}" for k in range(200)]
        for _ in range(60):
            text = list(base)
            for _ in range(rng.choice([1, 1, 1, 1, 1, 3])):
                text[rng.randrange(len(text))] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(text)))
    docs += [(1000 + k, docs[k][1].upper()) for k in range(9)]
    sets = {d: frozenset(shingles(t)) for d, t in docs}
    distinct = set(sets.values())
    links = {a: sum(a != b and len(a & b) * 100 >= 80 * len(a | b) for b in distinct) for a in distinct}
    assert len(set(links.values())) > 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for params in ({}, {"group": 3, "chunk": 2, "counted": 700}):
        got = classes(df, **params).collect()
        assert {r.doc_id: r.n_links for r in got} == {d: links[x] for d, x in sets.items()} and len(got) == len(docs)


def test_near_copies_without_id(spark):
    """Sets that only rows without doc_id hold have links, and lead from one set to another."""
    words = [f"w{k}" for k in range(60)]
    head = ["a", "b", "c", "d", *words[4:]]
    chain = [" ".join(x) for x in (words, head, [*head[:-4], "e", "f", "g", "h"])]
    lone = " ".join(f"n{k}" for k in range(40))
    docs = [(7, chain[0]), (None, chain[1]), (5, chain[2]), (None, lone), (None, lone + " x"), (None, lone + " x")]
    assert brute(docs)[:3] != brute([d for d in docs if d[0] is not None])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = similarity_classes(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs)
    assert sorted(r.n_links for r in got) == [1, 1, 1, 1, 1, 2]
    kept = keep_one(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["5", "None"]


def test_hot_groups_are_dealt_by_node(spark, monkeypatch):
    """Groups above every bound, dealt over all tasks, and compared with a main component and what is outside it."""
    rng, docs = random.Random(8), []
    base = [f"w{k}" for k in range(120)]
    for _ in range(90):
        text = list(base)
        for _ in range(rng.choice([1, 1, 2, 2, 3, 9, 30])):
            text[rng.randrange(len(text))] = f"x{rng.random()}"
        docs.append((len(docs), " ".join(text)))
    docs += [(500 + k, t) for k, (_, t) in enumerate(docs[:40])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute(docs)
    assert len({c for *_, c in want}) > 3
    for least, group in ((4, 3), (10, 3), (50, 24)):
        monkeypatch.setattr(ngram_join, "KEY_LEAST", least)
        got = similarity_classes(df, group=group, chunk=7)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == want
