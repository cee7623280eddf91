import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemark.llm import maxent_lm as lm
from tidemark.llm.common import word_hash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").translate(LOWER).replace("\v", " ").replace("\f", " ").split() + [None]


def base(docs):
    c = Counter(w for _, t, out in docs if not out for w in words(t))
    n, v = sum(c.values()), len(c)
    return {(d, t): (len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for d, t, _ in docs}


def corpus(n, seed=0):
    rng = random.Random(seed)
    sides = [[f"{p}{k}" for k in range(40)] for p in ("a", "b")]
    docs = []
    for k in range(n):
        side = rng.choice(sides)
        docs.append((k, " ".join(rng.choice(side + ["the"] * 10) if rng.random() < 0.9 else f"{rng.random()}" for _ in range(rng.randint(1, 80))), k % 10 == 0))
    return docs


@pytest.mark.parametrize("frequent", [1 << 17, 30])
def test_base_scores_and_held_out_gain(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = [*corpus(600), (1000, None, True), (1001, "", False), (None, "The\tTHE the", False), (1002, "zz " * 70000, True), (1002, "zz " * 70000, True)]
    df = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, out boolean, score string").repartition(3)
    learn = df.where("not out")
    counts = lm.count_tokens(learn)
    vocab, least = lm.vocabulary(counts)
    model = lm.train(learn, vocab)
    got = lm.score(df, model, counts, least).collect()
    want = base(docs)
    assert len(got) == len(docs)
    by_id = {(d): v for (d, t), v in want.items()}
    for r in got:
        n_tokens, n_known, n, b = by_id[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(b, rel=1e-9)
    if frequent > 30:
        held = [r for r in got if r.out and r.doc_id < 1000]
        assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(corpus(60), "doc_id long, text string, out boolean")
    counts = lm.count_tokens(docs)
    vocab, _ = lm.vocabulary(counts)
    model = lm.Model(vocab)
    rng = np.random.default_rng(0)
    model.ratio = rng.normal(size=model.ratio.shape).astype(np.float16)
    scorer = lm.Scorer(model)
    all_ = sorted({w for _, t, _ in corpus(60) for w in words(t)[:-1]})
    c = Counter(w for _, t, _ in corpus(60) for w in words(t))
    total = 0.0
    for w in [*all_, None]:  # the token after "a1 b2": the word itself, or the end
        h, kind, first = lm.tokens(pa.array(["a1 b2" + (f" {w}" if w is not None else "")]))
        leaf, count = vocab.find(h)
        logs = scorer.log_probability(leaf, kind, first)[2]
        total += math.exp(logs) * (1 if leaf[2] >= 0 else (c[w] + lm.SMOOTH) / vocab.tail[kind[2]])
        assert count[2] == c[w]
    h, kind, first = lm.tokens(pa.array(["a1 b2 x"]))
    for k in range(lm.TAIL):  # what each tail class holds for unseen tokens
        kind[2] = k
        total += math.exp(scorer.log_probability(np.array([*vocab.find(h)[0][:2], -1, 0]), kind, first)[2]) * lm.SMOOTH / vocab.tail[k]
    assert total == pytest.approx(1, abs=1e-3)


def brute_scores(docs, model):
    """Counts by dictionaries and sums by math.fsum; the model's hashing, and its trained scales, are taken as they are."""
    vocab = model.vocabulary
    seen = Counter()
    places = {}
    for d, t, out in docs:
        h, kind, first = lm.tokens(pa.array([t]))
        leaf, count = vocab.find(h)
        f = lm.features(leaf, kind, first)
        at = [int(x) if x >= 0 else lm.LEAVES - lm.TAIL + int(k) for x, k in zip(leaf, kind)]
        places[d] = []
        for i, y in enumerate(at):
            way = []
            for level in range(lm.LEVELS):
                node = int(vocab.first_node[level]) + y // lm.WIDTH ** (lm.LEVELS - level)
                part = y // lm.WIDTH ** (lm.LEVELS - level - 1) % lm.WIDTH
                rows = [int(r) for r in vocab.row(f[i : i + 1], np.array([node]))[0]]
                way.append((level, node, part, rows))
                if not out:
                    for r in rows:
                        seen[r, part] += 1
            share = 0.0 if leaf[i] >= 0 else math.log((max(count[i], 0) + lm.SMOOTH) / vocab.tail[kind[i]])
            places[d].append((way, share))
    total = Counter()
    for (r, _), n in seen.items():
        total[r] += n
    result = {}
    for d, found in places.items():
        logs = []
        for way, share in found:
            logs.append(share)
            for level, node, part, rows in way:
                x = []
                for j in range(lm.WIDTH):
                    p = vocab.share[node, j]
                    x.append(max(math.log(p), -1e4) if p > 0 else -1e4)
                    for k, r in enumerate(rows):
                        if total[r]:
                            bucket = min(total[r].bit_length(), lm.BUCKETS - 1)
                            x[-1] += model.scale[k, level, bucket] * math.log((seen[r, j] + lm.PRIOR * p + lm.EVEN) / ((total[r] + lm.PRIOR) * p + lm.EVEN))
                most = max(x)
                logs.append(x[part] - most - math.log(math.fsum(math.exp(v - most) for v in x)))
        result[d] = math.fsum(logs) / math.log(10)
    return result


def test_scores_against_dictionaries(spark):
    docs = [*corpus(80, 3), (500, "", True), (501, "a1 b2 unknown-word a3", True)]
    df = spark.createDataFrame(docs, "doc_id long, text string, out boolean")
    learn = df.where("not out")
    counts = lm.count_tokens(learn)
    vocab, least = lm.vocabulary(counts)
    model = lm.train(learn, vocab)
    assert not np.allclose(model.scale, lm.SCALE)
    want = brute_scores(docs, model)
    for r in lm.score(df, model, counts, least).collect():
        assert r.score == pytest.approx(want[r.doc_id], rel=2e-3), r.doc_id


def test_dealing_does_not_matter(spark):
    docs = spark.createDataFrame(corpus(150, 4), "doc_id long, text string, out boolean")
    one, many = ({r.doc_id: r.score for r in lm.train_and_score(docs.repartition(n), "out").collect()} for n in (1, 9))
    assert one == pytest.approx(many, rel=1e-6)


def test_words_are_those_of_the_contract():
    h, _, first = lm.tokens(pa.array(["A\u00a0b  C", None]))
    assert first.tolist() == [0, 3, 4]
    assert [int(x) for x in h] == [word_hash("a\u00a0b"), word_hash("c"), int(lm.END), int(lm.END)]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, out boolean")
    (r,) = lm.train_and_score(df, "out").collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(3 * math.log10(0.1 / 0.1)) and math.isfinite(r.score)
    assert lm.train_and_score(df.limit(0), "out").count() == 0
    assert lm.train_and_score(df.withColumn("out", F.lit(False)), "out").first().n_known == 3


def test_every_kind_of_place_is_trained_on(spark):
    """In each context the successor that always follows is learned, with the parameters of the query."""
    pairs = [(f"a{k}", f"b{k}") for k in range(48)]
    rng = random.Random(2)
    docs = spark.createDataFrame([(k, " ".join(w for _ in range(60) for w in rng.choice(pairs))) for k in range(240)], "doc_id long, text string")
    vocab, _ = lm.vocabulary(lm.count_tokens(docs))
    scorer = lm.Scorer(lm.train(docs, vocab))
    better = 0
    for a, b in pairs:
        h, kind, first = lm.tokens(pa.array([f"{pairs[0][0]} {pairs[0][1]} {a} {b}"]))
        leaf, count = vocab.find(h)
        better += scorer.log_probability(leaf, kind, first)[3] / math.log(10) > vocab.base(count)[3] + 0.3
    assert better == len(pairs)


def local_model(texts, vocab):
    """The model before any round, and all places, without Spark."""
    h, kind, first = lm.tokens(pa.array(texts))
    leaf, _ = vocab.find(h)
    f, y = lm.features(leaf, kind, first), np.where(leaf >= 0, leaf, lm.LEAVES - lm.TAIL + kind)
    x = np.zeros((vocab.rows, lm.WIDTH))
    for _, node, part in vocab.steps(y):
        np.add.at(x, (vocab.row(f, node), part[:, None]), 1)
    seen, share = x.sum(1), vocab.share[vocab.kinds()[0]]
    ratio = np.log((x + lm.PRIOR * share + lm.EVEN) / ((seen + lm.PRIOR)[:, None] * share + lm.EVEN))
    ratio[seen == 0] = 0
    return lm.Model(vocab, ratio.astype(np.float16), seen.astype(np.float32)), f, y


def test_every_text_trains_the_scales(spark):
    """Scales come from all texts: also from those that no sixteenth of the first three holds, and each text counts once."""
    docs = spark.createDataFrame(corpus(400, 5), "doc_id long, text string, out boolean")
    late = docs.where(F.pmod(F.xxhash64("text"), F.lit(16)) >= 3)
    vocab, _ = lm.vocabulary(lm.count_tokens(late))
    assert not np.allclose(lm.train(late, vocab).scale, lm.SCALE)
    vocab, _ = lm.vocabulary(lm.count_tokens(docs))
    rows = docs.select("text", F.pmod(F.xxhash64("text"), F.lit(lm.ROUNDS)).alias("part")).collect()
    for rounds in (1, lm.ROUNDS):
        model, _, _ = local_model([r.text for r in rows], vocab)
        for turn in range(rounds):
            _, f, y = local_model([r.text for r in rows if rounds == 1 or r.part == turn], vocab)
            model.step(*model.gradient(f, y))
        assert np.allclose(lm.train(docs, vocab, rounds=rounds).scale, model.scale, atol=1e-4)


def test_gradient_against_plain_sums(spark):
    docs = spark.createDataFrame(corpus(40, 6), "doc_id long, text string, out boolean")
    vocab, _ = lm.vocabulary(lm.count_tokens(docs))
    model, f, y = local_model([r.text for r in docs.collect()], vocab)
    model.scale = model.scale * np.random.default_rng(0).uniform(-0.4, 1.5, model.scale.shape)
    g, h = model.gradient(f, y)
    want_g, want_h = np.zeros(model.scale.size), np.zeros(model.scale.size)
    for level, node, part in vocab.steps(y):
        rows = vocab.row(f, node)
        for i in range(len(y)):
            share, x, parts = vocab.share[node[i], part[i]], vocab.base_log[node[i]].astype(float), []
            for k in range(lm.FEATURES):
                v, n = model.ratio[rows[i, k]].astype(float), model.seen[rows[i, k]]
                expected, least = (n + lm.PRIOR) * share + lm.EVEN, lm.PRIOR * share + lm.EVEN
                v[part[i]] = math.log(max(math.exp(v[part[i]]) * expected - 1, least) / expected)
                v = v * (n > 1)
                parts.append(v)
                x += model.scale[k, level, model.bucket(n - 1)] * v
            p = np.exp(x - x.max())
            p /= p.sum()
            for k, v in enumerate(parts):
                at = (k * lm.LEVELS + level) * lm.BUCKETS + int(model.bucket(model.seen[rows[i, k]] - 1))
                want_g[at] += p @ v - v[part[i]]
                want_h[at] += p @ v**2 - (p @ v) ** 2
    assert np.allclose(g, want_g, rtol=1e-3, atol=1e-2) and np.allclose(h, want_h, rtol=1e-3, atol=1e-2)
