import random

import pytest
from tidemark.llm import decontaminate as module
from tidemark.llm.decontaminate import SUBSTITUTIONS, WINDOW, allowed, contamination, covers, decontaminate, masks


def brute(docs, items, window=WINDOW, substitutions=SUBSTITUTIONS):
    found = set()
    for d, text in docs:
        x = (text or "").lower().split()
        for k, item in items:
            y = (item or "").lower().split()
            need = min(window, len(y))
            spare = substitutions * need // window
            if y and any(sum(a != b for a, b in zip(x[i : i + need], y[j : j + need])) <= spare for i in range(len(x) - need + 1) for j in range(len(y) - need + 1)):
                found.add((d, k))
    return found


def test_masks_find_any_substitutions():
    assert not covers(("111111111111",), 13, 2) and not covers(("11111",), 13, 2)
    for window, substitutions in ((13, 2), (13, 0), (13, 1), (13, 3), (8, 2), (20, 4), (5, 1), (3, 3)):
        for length in range(1, window + 1):
            spare = allowed(length, window, substitutions)
            if spare < length:
                assert covers(masks(length, spare), length, spare), (length, spare)


@pytest.mark.parametrize("sent_items", [20000, 3])
def test_against_brute_force(spark, sent_items):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice("abcdefghijklmno") * rng.randint(1, 2) for _ in range(rng.choice([1, 4, 6, 9, 13, 20])))) for k in range(12)]
    docs = []
    for d in range(150):
        words = [rng.choice("abcdefghijklmno") for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            y = rng.choice(items)[1].upper().split()
            for _ in range(rng.randint(0, 4)):
                y[rng.randrange(len(y))] = "zz"
            words[rng.randint(0, len(words)) : 0] = y[rng.randint(0, 3) :]
        docs.append((d, " ".join(words)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = contamination(df, bench, sent_items=sent_items).collect()
    want = brute(docs, items)
    assert len(got) == len(want) and {(r.doc_id, r.item_id) for r in got} == want and want
    assert {r.doc_id for r in decontaminate(df, bench, sent_items=sent_items).collect()} == set(range(150)) - {d for d, _ in want}


@pytest.mark.parametrize("window,substitutions,sent_items", [(8, 1, 99), (10, 3, 99), (13, 0, 99), (10, 3, 0)])
def test_other_windows_and_seeds_of_many_items(spark, monkeypatch, window, substitutions, sent_items):
    monkeypatch.setattr(module, "HITS", 40)
    rng = random.Random(9)
    common = [rng.choice("abcdef") for _ in range(14)]
    items = [(k, " ".join([*common, *(rng.choice("abcdef") for _ in range(rng.choice([0, 3, 9])))])) for k in range(25)]
    items += [(100 + k, " ".join(rng.choice("abcdef") for _ in range(rng.choice([7, 9, 12])))) for k in range(10)]
    docs = []
    for d in range(60):
        words = [rng.choice("abcdef") for _ in range(20)]
        if d % 3 == 0:
            y = list(rng.choice(items)[1].split())
            for _ in range(rng.randint(0, 4)):
                y[rng.randrange(len(y))] = "zz"
            words[5:5] = y
        docs.append((d, " ".join(words)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, *items[:5]], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in contamination(df, bench, window=window, substitutions=substitutions, sent_items=sent_items).collect()]
    want = brute(docs, items, window, substitutions)
    assert sorted(got) == sorted(want) and 0 < len(want)


@pytest.mark.parametrize("sent_items", [99, 0])
def test_edges(spark, sent_items):
    passage = " ".join(f"w{k}" for k in range(15))
    docs = spark.createDataFrame([(None, passage, 1), (1, None, 2), (2, "", 3), (3, "x " * 100000 + passage, 4), (3, "x " * 100000 + passage, 4)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(None, passage), (7, None), (8, ""), (9, "a b")], "item_id long, text string")
    assert sorted(map(tuple, contamination(docs, bench, sent_items=sent_items).collect()), key=str) == [(3, None, 15, 100000), (3, None, 15, 100000), (None, None, 15, 0)]
    assert sorted(r.doc_id for r in decontaminate(docs, bench, sent_items=sent_items).collect()) == [1, 2]
    assert decontaminate(docs, bench, sent_items=sent_items).columns == docs.columns
    assert contamination(docs, bench.limit(0), sent_items=sent_items).count() == 0 and contamination(docs.limit(0), bench, sent_items=sent_items).count() == 0
