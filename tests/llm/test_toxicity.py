import random

import numpy as np
import pyarrow as pa
import pytest
from tidemark.llm.toxicity import FEATURES, Boosting, Lexicon, isotonic, sampled, score, train
from tidemark.llm.common import U64


def features(text):
    return dict(zip(FEATURES, Lexicon(np.zeros(0, U64), np.zeros(0)).features(pa.array([text, "pad you"]))[0], strict=True))


def test_features():
    f = features("You IDIOT! the id10t and i-d-i-o-t, st00pid")
    assert f["insult_density"] == pytest.approx(2 / 7)  # IDIOT and i-d-i-o-t
    assert f["hidden_count"] == pytest.approx(np.log1p(1))
    assert f["address_density"] == pytest.approx(1 / 7) and f["nearness"] == pytest.approx(1 / 2) and f["near_share"] == 1
    assert f["shouting"] == pytest.approx(1 / 7) and f["capitals"] == pytest.approx(6 / 27)
    assert f["symbols_inside"] == pytest.approx(1 / 7) and f["digits_inside"] == pytest.approx(2 / 7)
    assert not any(v for k, v in features("").items()) and not any(features(None).values())


def test_distance_stays_within_a_text():
    x = Lexicon(np.zeros(0, U64), np.zeros(0)).features(pa.array(["nice idiot", "you there", "you a b c d e f idiot"]))
    near = x[:, FEATURES.index("nearness")]
    assert near.tolist() == [0, 0, pytest.approx(1 / 8)] and x[2, FEATURES.index("near_share")] == 0


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 12, 80).astype(float), rng.integers(0, 2, 80).astype(float)
    at, centre, value = isotonic(x, y)
    assert (at <= centre).all() and (np.diff(centre) > 0).all()
    fit = value[np.searchsorted(at, x, "right") - 1]
    assert (np.diff(value) > 0).all()
    for k in range(12):  # every lower set is below, every upper set above its mean: the characterisation of the fit
        if (x <= k).any():
            assert (y[x <= k] - fit[x <= k]).sum() >= -1e-9
    assert (y - fit).sum() == pytest.approx(0)


def test_scores_between_pools_are_calibrated():
    rng = np.random.default_rng(3)
    x = rng.random(4000)
    _, centre, value = isotonic(x, (rng.random(4000) < x**3).astype(float))
    new = rng.random(20000)
    got = np.interp(new, centre, value)
    assert abs(got.mean() - (new**3).mean()) < 0.02
    for low in np.arange(0, 1, 0.2):
        at = (new >= low) & (new < low + 0.2)
        assert abs(got[at].mean() - (new[at] ** 3).mean()) < 0.05


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Boosting(x[:1500], y[:1500])
    assert ((model.margin(x[1500:]) > 0) == (y[1500:] == 1)).mean() > 0.95
    assert np.allclose(model.margin(x[:10]), model.margin(x)[:10])


def test_held_out_and_edges(spark):
    rng = random.Random(0)
    docs, labels = [], []
    for k in range(900):
        words = [rng.choice("the and of thing red blue was her".split()) for _ in range(rng.randint(5, 60))]
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["IDIOT", "scum", "you loser", "blorp"]))
        docs.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (5000, 1)], "doc_id long, toxic int")
    model = train(sampled(df.where("doc_id < 600"), lab))
    got = score(df.where("doc_id >= 600"), model).collect()
    assert len(got) == 300 and np.mean([r.predicted == (r.doc_id % 4 == 0) for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "you idiot " * 100000, "x"), (2, "", "x")], "doc_id long, text string, score string")
    out = score(odd, model).collect()
    assert len(out) == 4 and {r.predicted for r in out if r.doc_id} == {0} and [r.predicted for r in out if r.doc_id is None] == [1]
    assert score(odd.limit(0), model).count() == 0
    none = train(sampled(df.limit(0), lab))
    assert [r.predicted for r in score(odd, none).collect()] == [0] * 4
