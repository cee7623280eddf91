"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SEPARATOR, U64, Words, broadcast_if_small, chunks, cut, lean, one_array, text_bytes, tidy

#: Labelled texts that the model learns from at most (in expectation); the rest of the labels is not read.
SAMPLE_DOCS = 12_000
LEARNT_WORDS = 512
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS, LEAST = 80, 3, 0.15, 32, 20
NEAR = 5

# Words of abuse and of address.
INSULTS = """
idiot idiots moron morons stupid dumb fool loser losers scum trash garbage worthless pathetic disgusting clown
jerk creep filthy vile coward parasite vermin rat pig swine imbecile halfwit dimwit hate kill die shut
""".split()
ADDRESS = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta vous votre vos tú tu ti usted ustedes vosotros os vuestro".split()
#: Signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

FEATURES = (
    "insult_density insult_count hidden_density hidden_count learnt_density learnt_count learnt_weight address_density "
    "near_share nearness capitals shouting exclamations questions punctuation digits_inside symbols_inside words word_length"
).split()

_code = np.arange(256)
_alpha = ((_code >= 65) & (_code <= 90)) | ((_code >= 97) & (_code <= 122)) | (_code >= 128)
_upper = (_code >= 65) & (_code <= 90)
_digit = (_code >= 48) & (_code <= 57)
_kept = _alpha | _digit | SEPARATOR
_mark = ~_kept & (_code > 32)
_leet = LOWER.copy()
for _a, _b in LEET.items():
    _leet[ord(_a)] = ord(_b)
_leet_kept = _kept.copy()
_leet_kept[[ord("@"), ord("$")]] = True


def _plain(raw: np.ndarray, borders: np.ndarray) -> Words:
    """Words without ASCII marks."""
    keep = _kept[raw]
    return Words(raw[keep], np.concatenate([[0], np.cumsum(keep)])[borders])


def _bare(raw: np.ndarray, borders: np.ndarray) -> Words:
    """Words with signs read as letters, without other marks, and with repeated letters once."""
    low = _leet[raw]
    keep = _leet_kept[raw]
    low, at = low[keep], np.concatenate([[0], np.cumsum(keep)])[borders]
    once = np.ones(len(low), bool)
    once[1:] = (low[1:] != low[:-1]) | SEPARATOR[low[1:]]
    once[at[at < len(low)]] = True
    return Words(low[once], np.concatenate([[0], np.cumsum(once)])[at], lower=None)


def _hashes(words: list[str], how) -> np.ndarray:
    raw = [np.frombuffer(w.encode(), np.uint8) for w in words]
    return np.unique(how(np.concatenate(raw), np.concatenate([[0], np.cumsum([len(x) for x in raw])])).hash)


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


class Lexicon:
    """The fixed words, and the learnt ones with their weights."""

    def __init__(self, learnt: np.ndarray, weights: np.ndarray):
        order = np.argsort(learnt)
        self.learnt, self.weights = learnt[order], weights[order]
        self.insults, self.bare, self.address = _hashes(INSULTS, _plain), _hashes(INSULTS, _bare), _hashes(ADDRESS, _plain)

    def features(self, text: pa.Array) -> np.ndarray:
        """FEATURES of each text; all 0 for a text without words."""
        raw, borders = text_bytes(text)
        n = len(borders) - 1
        words, bare, whole = _plain(raw, borders), _bare(raw, borders), Words(raw, borders)
        count = words.counts
        some = np.maximum(count, 1)
        size = np.maximum(np.diff(borders), 1)
        sums = lambda mask, first: np.diff(np.concatenate([[0], np.cumsum(mask)])[first])
        insult, address = _among(words.hash, self.insults), _among(words.hash, self.address)
        at = np.minimum(np.searchsorted(self.learnt, words.hash), max(0, len(self.learnt) - 1))
        learnt = self.learnt[at] == words.hash if len(self.learnt) else np.zeros(len(words.hash), bool)
        weight = np.where(learnt, self.weights[at], 0.0) if len(self.learnt) else np.zeros(len(words.hash))
        insults = sums(insult, words.first)
        hidden = np.maximum(sums(_among(bare.hash, self.bare), bare.first) - insults, 0)
        bad = np.flatnonzero(insult | learnt)
        near, close = np.zeros(n), np.zeros(n)
        if len(bad):
            doc = np.searchsorted(words.first, bad, "right") - 1
            you = np.flatnonzero(address)
            gap = np.full(len(bad), 1 << 30)
            if len(you):
                k = np.searchsorted(you, bad)
                for side in (np.maximum(k - 1, 0), np.minimum(k, len(you) - 1)):
                    same = np.searchsorted(words.first, you[side], "right") - 1 == doc
                    gap = np.minimum(gap, np.where(same, np.abs(you[side] - bad), 1 << 30))
            near = np.bincount(doc, gap <= NEAR, n) / np.maximum(np.bincount(doc, minlength=n), 1)
            np.maximum.at(close, doc, 1 / (1 + np.minimum(gap, 1000)) * (gap < 1000))
        letters, upper, marks = sums(_alpha[raw], borders), sums(_upper[raw], borders), sums(_mark[raw], borders)
        up = np.concatenate([[0], np.cumsum(_upper[raw])])
        al = np.concatenate([[0], np.cumsum(_alpha[raw])])
        dg = np.concatenate([[0], np.cumsum(_digit[raw])])
        mk = np.concatenate([[0], np.cumsum(_mark[raw])])
        span = lambda total, a, b: total[np.maximum(b, a)] - total[a]
        a, b = whole.start, whole.end
        shout = (span(up, a, b) == span(al, a, b)) & (span(al, a, b) >= 3)
        lettered = span(al, a, b) >= 2
        inner = np.maximum(b - 1, a + 1)
        digits, symbols = (span(dg, a + 1, inner) > 0) & lettered, (span(mk, a + 1, inner) > 0) & lettered
        whole_n = np.maximum(whole.counts, 1)
        out = [insults / some, np.log1p(insults), hidden / some, np.log1p(hidden), sums(learnt, words.first) / some, np.log1p(sums(learnt, words.first)), np.diff(np.concatenate([[0], np.cumsum(weight)])[words.first]), sums(address, words.first) / some]
        out += [near, close, upper / np.maximum(letters, 1), sums(shout, whole.first) / whole_n, sums(raw == 33, borders) / size, sums(raw == 63, borders) / size, marks / size, sums(digits, whole.first) / whole_n, sums(symbols, whole.first) / whole_n, np.log1p(count), letters / some]
        return np.stack(out, 1).astype(np.float64)


class Boosting:
    """Trees of fixed depth on binned features, grown on the gradient of the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, least: int = LEAST):
        n, d = x.shape
        self.depth, self.edges = depth, [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for f in range(d)]
        share = np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        binned = self.bins(x)
        margin = np.full(n, self.base)
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(trees if n else 0):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, split = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, BINS, np.int64)
            for level in range(depth):
                k = 1 << level
                best, choice, where = np.full(k, 1e-6), np.zeros(k, np.int64), np.full(k, BINS, np.int64)
                for f in range(d):
                    cell = node * BINS + binned[:, f]
                    g, h, c = (np.cumsum(np.bincount(cell, w, k * BINS).reshape(k, BINS), 1) for w in (grad, hess, None))
                    gain = g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                    gain[(c < least) | (c[:, -1:] - c < least)] = 0
                    top = gain.argmax(1)
                    better = gain[np.arange(k), top] > best
                    best[better], choice[better], where[better] = gain[np.arange(k), top][better], f, top[better]
                feature[k - 1 : 2 * k - 1], split[k - 1 : 2 * k - 1] = choice, where
                node = 2 * node + (binned[np.arange(n), choice[node]] > where[node])
            g, h = np.bincount(node, grad, 1 << depth), np.bincount(node, hess, 1 << depth)
            leaf = rate * g / (h + 1)
            margin += leaf[node]
            self.feature.append(feature)
            self.cut.append(split)
            self.leaf.append(leaf)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self.bins(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, split, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = node + (1 << level) - 1
                node = 2 * node + (binned[rows, feature[at]] > split[at])
            out += leaf[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, centre, value) of the pools of the best non-decreasing fit of y on x, by pooling adjacent violators."""
    xs, at = np.unique(x, return_inverse=True)
    total, count = np.bincount(at, y), np.bincount(at).astype(float)
    pools: list[list[float]] = []
    for k in range(len(xs)):
        pools.append([xs[k] * count[k], total[k], count[k], xs[k]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            for i, v in enumerate(pools.pop()[:3]):
                pools[-1][i] += v
    return np.array([p[3] for p in pools]), np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray):
        self.lexicon, self.trees = lexicon, Boosting(x[~calibrate], y[~calibrate])
        # Between the centres of pools scores go in a straight line, so that a pool's texts have its rate on average.
        _, self.steps, self.values = isotonic(self.trees.margin(x[calibrate]), y[calibrate]) if calibrate.any() else (np.zeros(0),) * 3

    def scores(self, text: pa.Array) -> np.ndarray:
        margin = self.trees.margin(self.lexicon.features(text))
        if not len(self.steps):
            return 1 / (1 + np.exp(-margin))
        return np.clip(np.interp(margin, self.steps, self.values), 0, 1)


def train(labelled: DataFrame, *, learnt_words: int = LEARNT_WORDS) -> Model:
    """A model of `toxic` (0 or 1) by `text`; the rows should be a bounded sample.

    Seven tenths of the rows, by a hash of the text, give the learnt words and the trees; the others calibrate,
    so that no text counts for both. Trees see a text by words that were learnt from the other half of these
    rows, as they will see new ones. Null texts count as empty, repeated rows count each for itself; without
    rows, or with one label only, every text gets about the share of toxic rows.
    """
    part = F.pmod(F.xxhash64("text"), F.lit(20))
    fold = F.when(part < 6, 2).otherwise(part % 2).cast("int")  # 2: for calibration
    rows = cut(labelled.where("toxic is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("double").alias("toxic")).withColumn("fold", fold), "labelled")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, toxic, fold = one_array(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i, j in chunks(text):
                w = _plain(*text_bytes(text.slice(i, j - i)))
                found = [np.unique(w.hash[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                size = [len(x) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(toxic[i:j], size)), pa.array(np.repeat(fold[i:j], size))], names=["word", "toxic", "fold"])

    fit = rows.where("fold < 2")
    sums = {r["fold"]: (r["n"], r["bad"]) for r in fit.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).collect()}
    count = lambda k: F.count_if(F.col("fold") == k)
    bad_of = lambda k: F.sum(F.when(F.col("fold") == k, F.col("toxic")).otherwise(0.0))
    words = fit.mapInArrow(tidy(spread), "word long, toxic double, fold int").groupBy("word").agg(bad_of(0).alias("t0"), count(0).alias("c0"), bad_of(1).alias("t1"), count(1).alias("c1"))
    words = cut(words.where("t0 >= 2 or t1 >= 2"), "words")

    def learnt(folds: tuple[int, ...]) -> Lexicon:
        n, bad = (sum(sums.get(k, (0, 0.0))[i] for k in folds) for i in (0, 1))
        share, t, c = bad / max(n, 1), sum(F.col(f"t{k}") for k in folds), sum(F.col(f"c{k}") for k in folds)
        odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("c") - F.col("t") + 0.5) / (n - bad + 1))
        strength = (F.col("t") - share * F.col("c")) / F.sqrt(F.col("c") * share * (1 - share) + 1)
        found = words.select("word", t.alias("t"), c.alias("c")).where(F.col("t") >= 2 + len(folds)).withColumns({"odds": odds, "z": strength})
        best = found.where("odds > 1 and z > 5").orderBy(F.desc("z"), "word").limit(learnt_words).toArrow()
        return Lexicon(best["word"].to_numpy().view(U64), best["odds"].to_numpy())

    lexicon = learnt((0, 1))
    shared = rows.sparkSession.sparkContext.broadcast((learnt((1,)), learnt((0,)), lexicon))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(2).to_numpy()
            for k, own in enumerate(shared.value):
                part = batch.filter(pa.array(fold == k))
                text = one_array(part.column(0))
                x = np.concatenate([own.features(text.slice(i, j - i)) for i, j in chunks(text)]) if len(text) else np.zeros((0, len(FEATURES)))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, f]) for f in range(x.shape[1])), part.column(1), part.column(2)], names=[*FEATURES, "toxic", "fold"])

    table = rows.mapInArrow(tidy(dense), ", ".join(f"{f} double" for f in FEATURES) + ", toxic double, fold int").toArrow()
    x = np.stack([table[f].to_numpy() for f in FEATURES], 1)
    y, calibrate = table["toxic"].to_numpy(), table["fold"].to_numpy() == 2
    order = np.lexsort((y, *x.T))
    return Model(lexicon, x[order], y[order], calibrate[order])


def sampled(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(text, toxic) of a sample of the labelled documents, by a hash of doc_id.

    A document with several labels is toxic if one of them says so.
    """
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    part = labels.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_docs / max(n, 1))))
    part = cut(part, "labels")
    return docs.select("doc_id", "text").join(broadcast_if_small(part, part.count(), 4 * sample_docs), "doc_id").select("text", "toxic")


def score(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from `threshold` on), by whole text.

    Null and empty texts get the score of a text without words; repeated rows get equal scores; texts that tie
    in all features do too; an empty table gives an empty one; columns of `docs` named like the results are
    replaced.
    """
    made = ("score", "predicted")
    rows = docs.drop(*[c for c in docs.columns if c in made])
    columns = rows.columns
    at, shared = columns.index("text"), lean(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = one_array(batch.column(at))
            got = np.concatenate([shared.value.scores(text.slice(i, j - i)) for i, j in chunks(text)]) if len(text) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=[*columns, *made])

    return rows.mapInArrow(tidy(run), rows.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)
