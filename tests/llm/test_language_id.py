import math
import random
from collections import Counter

import numpy as np
from tidemark.llm.language_id import DISCOUNT, KneserNey, Model, identify, train


def brute(texts, order):
    """Interpolated Kneser-Ney by dictionaries: a function of (context, symbol)."""
    rows = []
    for t in texts:
        letters = "".join(c.lower() if c.isalpha() else "\0" for c in "\0" + t)
        rows.append("".join(c for k, c in enumerate(letters) if c != "\0" or k == 0 or letters[k - 1] != "\0"))
    grams = {k: Counter(r[i - k + 1 : i + 1] for r in rows for i in range(max(k - 1, 1 if k == 1 else 0), len(r))) for k in range(1, order + 1)}
    counts = {order: grams[order]}
    for k in range(1, order):
        spread = Counter(g[1:] for g in grams[k + 1])
        counts[k] = {g: max(spread[g], 1) for g in grams[k]}

    def p(context, c):
        k = len(context) + 1
        below = 1 / (len(counts[1]) + 1) if k == 1 else p(context[1:], c)
        inside = {g: n for g, n in counts[k].items() if g[:-1] == context}
        if not inside:
            return below
        total = sum(inside.values())
        return max(inside.get(context + c, 0) - DISCOUNT, 0) / total + DISCOUNT * len(inside) / total * below

    return p, rows


def test_probabilities_against_dictionaries():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aab c.Éx") for _ in range(40)) for _ in range(5)]
    p, rows = brute(texts, 3)
    model = KneserNey(texts, 3, DISCOUNT)
    for g in ["ab\0", "aa", "\0", "xé\0", "qqa", "aqb", "é"]:
        got = model.probability(np.array([[ord(c) for c in g]], np.uint32))[0]
        assert math.isclose(got, p(g[:-1], g[-1]), rel_tol=1e-9), g
    both = Model({"x": texts, "y": ["zzab zab"]}, order=3)
    probe = ["ab xa. qab", "c", "Éé  a"]
    bits, n, letters = both.entropies(probe)
    for k, t in enumerate(probe):
        row = brute([t], 1)[1][0]
        want = [-math.log2(p(row[max(0, i - 2) : i], row[i])) for i in range(1, len(row))]
        assert n[k] == len(want) and math.isclose(bits[k, 0], sum(want) / len(want), rel_tol=1e-9)


def corpus(rng, words, n):
    return [" ".join(rng.choice(words) for _ in range(rng.randint(3, 60))) for _ in range(n)]


def test_held_out_accuracy_and_rejection(spark):
    rng = random.Random(2)
    langs = {"aa": ["the", "and", "with", "thing", "other"], "bb": ["der", "und", "nicht", "schön", "über"]}
    rows = [(t, x) for x, w in langs.items() for t in corpus(rng, w, 80)]
    model = train(spark.createDataFrame(rows + [(None, "aa"), ("abc", None)], "text string, lang string"))
    assert model.languages == ["aa", "bb"]
    fresh = [(k, t, x) for x, w in langs.items() for k, t in enumerate(corpus(rng, w, 50))]
    got = identify(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), model).collect()
    assert len(got) == 100 and all(r.lang == r.lang_pred and not r.rejected and 0 <= r.score <= 1 for r in got)
    odd = [(1, None), (2, ""), (3, "12 ... 3"), (4, "zqxjkvw" * 200), (None, "the and " * 200000), (None, "the and " * 200000)]
    df = spark.createDataFrame([(*x, "clash", 1.5) for x in odd], "doc_id long, text string, lang_pred string, score double")
    out = {r.doc_id: r for r in identify(df, model).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(out[k].rejected and out[k].score == 0 for k in (1, 2, 3))
    assert out[4].rejected and out[None].lang_pred == "aa" and not out[None].rejected
    kept = identify(df, model, only_accepted=True)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [None, None]
    assert identify(df.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    model = train(spark.createDataFrame([], "text string, lang string"))
    out = identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).collect()
    assert out[0].lang_pred == "und" and out[0].rejected


def made_language(seed, n_words=400):
    """Words of the language's own syllables, the frequent ones shorter."""
    rng = random.Random(seed)
    syllables = ["".join(rng.choice(x) for x in ("bcdfghklmnprstvwz", "aeiouäéü", "nrslmt"))[: rng.choice([2, 3])] for _ in range(30)]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n_words)]
    return lambda rng, n: [" ".join(rng.choice(words[: rng.choice([20, n_words])]) for _ in range(rng.randint(3, 300))) for _ in range(n)]


def test_rejection_is_calibrated(spark):
    """Texts of the learnt languages stay; junk of letters and a language that was left out go."""
    rng = random.Random(7)
    langs = [made_language(k) for k in range(5)]
    learn = [(t, f"l{k}") for k in range(4) for t in langs[k](rng, 400)]
    model = train(spark.createDataFrame(learn, "text string, lang string"))
    frame = lambda texts: spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    own = identify(frame([t for k in range(4) for t in langs[k](rng, 250)]), model).collect()
    assert sum(r.rejected for r in own) <= 5
    long = [t for t in langs[4](rng, 200) if len(t) > 100]
    assert sum(r.rejected for r in identify(frame(long), model).collect()) >= 0.9 * len(long)
    junk = ["".join(rng.choice("bcdfghjklmnpqrstvwxyzaeiou   ") for _ in range(rng.randint(60, 400))) for _ in range(100)]
    assert sum(r.rejected for r in identify(frame(junk), model).collect()) >= 98
    tied = Model({"b": ["aaa"], "a": ["aaa"]}, order=2)
    assert tied.predict(["aa", "aa"])[0].tolist() == [0, 0] and tied.languages[0] == "a"
