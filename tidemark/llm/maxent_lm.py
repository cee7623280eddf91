"""Language-model scoring with a hashed maximum-entropy model.

The next token follows from a softmax that is factored into nested classes: each class has 16 parts, and four
choices lead to one of 65,536 leaves. Leaves hold the most frequent training tokens and some tail classes; any
other token, seen or not, is of a tail class by its last bytes, and its probability there is its share of the
class's training counts. Each choice is a maximum-entropy model with hashed n-gram and skip features of the
tokens before: a feature's row of the class's own part of the weight table has a weight for each of the 16
parts. Weights start as the smoothed log ratio of what was observed with the feature to what is expected at
zero weights, from all places; then rounds of gradients, summed over all tasks, train how much of it counts
for each kind of feature, level and number of observations. Each training text enters one of these rounds, and
none is left out. A place leaves its own observation out there.
With all weights at zero the model is the smoothed unigram distribution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, Words, chunks, cut, lean, list_array, mix, one_array, text_bytes, tidy

SMOOTH = 0.1
#: Parts of a class, choices to a leaf, leaves, and leaves that are tail classes.
WIDTH, LEVELS = 16, 4
LEAVES, TAIL = WIDTH**LEVELS, 64
#: The most frequent tokens stand for themselves in single and pair features, others by their last bytes.
CONTEXT_WORDS, PAIR_WORDS = 1 << 14, 1 << 12
FEATURES = 4
#: Rows of the weight table: one for so many training tokens, within these bounds (32 MB in half precision).
ROW_TOKENS, ROWS_LEAST, ROWS_MOST = 4, 1 << 15, 1 << 20
#: What a row's prior is worth: observations spread as without the feature, and one part of one for each choice.
PRIOR, EVEN = 8.0, 0.3
#: Classes of numbers of observations.
BUCKETS = 10
#: Gradient rounds for the scales of weights, among which all texts are dealt; the first scale, and the least that is not 0.
ROUNDS, SCALE, SCALE_LEAST = 3, 0.5, 1e-3
#: Weights go no further than this, so that no softmax needs its greatest exponent taken out in single precision.
LARGEST = 15.0
#: Counts of up to so many of the most frequent tokens (2.6 MB) are told to all tasks; others are joined.
FREQUENT = 1 << 17
#: Tokens that a task counts at once, and places that are worked on at once.
COUNTED_TOKENS, PLACES = 1 << 21, 1 << 13
END = U64(0x656E642D6F662D74)
SLICES = 16
#: A task of training goes through several splits, as each returns a table.
TASKS_A_CORE = 2


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail classes of all texts' words, each text's followed by the end; each text's first place."""
    raw, borders = text_bytes(text)
    w = Words(raw, borders)
    at = np.arange(len(w.hash)) + np.repeat(np.arange(len(text)), w.counts)
    first = w.first + np.arange(len(text) + 1)
    h = np.full(len(w.hash) + len(text), END)
    h[at] = w.hash
    kind = np.zeros(len(h), np.int64)
    last = LOWER[raw[w.end - 1]].astype(U64) if len(w.end) else np.zeros(0, U64)
    before = LOWER[raw[np.maximum(w.end - 2, w.start)]].astype(U64) if len(w.end) else np.zeros(0, U64)
    kind[at] = (mix(last * U64(256) + before) % U64(TAIL)).astype(np.int64)
    return h, kind, first


class Vocabulary:
    """Sorted hashes of the frequent tokens with their counts and leaves, all totals, and the tree of classes."""

    def __init__(self, h: np.ndarray, count: np.ndarray, total: int, distinct: int, tail: np.ndarray):
        order = np.argsort(h)
        self.hash, self.count = h[order], count[order]
        self.total, self.distinct = total, distinct
        rank = np.lexsort((self.hash, -self.count))
        rank = np.concatenate([rank[self.hash[rank] == END], rank[self.hash[rank] != END]])[: LEAVES - TAIL]
        self.slot = np.full(len(self.hash), -1)
        self.slot[rank] = np.arange(len(rank))
        # Tail masses: all training counts of the class, less its members among the leaves.
        self.tail = np.maximum(tail, 0) + SMOOTH
        mass = np.zeros(LEAVES)
        mass[: len(rank)] = self.count[rank] + SMOOTH
        mass[LEAVES - TAIL :] = self.tail
        levels = [mass]
        for _ in range(LEVELS):
            levels.insert(0, levels[0].reshape(-1, WIDTH).sum(1))
        share = [levels[k + 1].reshape(-1, WIDTH) / np.maximum(levels[k], 1e-300)[:, None] for k in range(LEVELS)]
        self.first_node = np.concatenate([[0], np.cumsum([len(x) for x in share])])
        self.share = np.concatenate(share)
        with np.errstate(divide="ignore"):
            self.base_log = np.maximum(np.log(self.share), -1e4).astype(np.float32)
        # Rows by the mass of the class, as many for each kind of feature.
        rows = min(ROWS_MOST, max(ROWS_LEAST, 1 << max(0, int(total // ROW_TOKENS).bit_length())))
        weight = np.concatenate(levels[:LEVELS]) ** 0.8
        self.part = 1 + np.floor((rows // FEATURES - len(weight)) * weight / max(weight.sum(), 1e-300)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.part * FEATURES)])
        self.rows = int(self.start[-1])
        self.salt = mix(np.arange(len(weight)).astype(U64) + U64(77)) | U64(1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each token (-1: tail) and its count (-1: not among the frequent)."""
        if not len(self.hash):
            return np.full(len(h), -1), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = self.hash[at] == h
        return np.where(hit, self.slot[at], -1), np.where(hit, self.count[at], -1)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """The class and the kind of feature of each row."""
        node = np.repeat(np.arange(len(self.part)), self.part * FEATURES)
        return node, (np.arange(self.rows) - self.start[node]) // self.part[node]

    def steps(self, leaf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, class, chosen part) on the way to each leaf."""
        for level in range(LEVELS):
            above = WIDTH ** (LEVELS - level)
            yield level, self.first_node[level] + leaf // above, leaf // (above // WIDTH) % WIDTH

    def row(self, f: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The row of each feature in a class's part of the table; fast where each kind of feature lies in one piece."""
        with np.errstate(over="ignore"):
            x = f.T ^ self.salt.take(node)
            x *= U64(0x9E3779B97F4A7C15)
            x ^= x >> U64(29)
            x *= U64(0xBF58476D1CE4E5B9)
            x >>= U64(32)
            part = self.part.take(node)
            x *= part.astype(U64)
            x >>= U64(32)
            row = x.view(np.int64)
            row += self.start.take(node)
            for k in range(1, FEATURES):
                row[k] += part * k
            return row.T


def features(leaf: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of the features at each place: the token before, the two before, and each of the two before that one alone."""
    depth = np.arange(len(leaf)) - np.repeat(first[:-1], np.diff(first))

    def back(k: int, words: int) -> np.ndarray:
        own = np.where((leaf >= 0) & (leaf < words), leaf, LEAVES + kind)
        out = np.full(len(leaf), LEAVES + TAIL, np.int64)
        out[k:] = own[:-k] if k < len(own) else own[:0]
        out[depth < k] = LEAVES + TAIL
        return out.astype(U64)

    pair = back(1, PAIR_WORDS) * U64(1 << 20) + back(2, PAIR_WORDS)
    one = U64(1 << 60)
    return np.stack([mix(back(1, CONTEXT_WORDS) + one), mix(pair + one * U64(2)), mix(back(2, CONTEXT_WORDS) + one * U64(3)), mix(back(3, CONTEXT_WORDS) + one * U64(4))]).T


class Model:
    """Log ratios of all rows, the observations of each, and the scales by kind, level and observations."""

    def __init__(self, vocabulary: Vocabulary, ratio: np.ndarray | None = None, seen: np.ndarray | None = None):
        self.vocabulary = vocabulary
        self.ratio = np.zeros((vocabulary.rows, WIDTH), np.float16) if ratio is None else ratio
        self.seen = np.zeros(vocabulary.rows, np.float32) if seen is None else seen
        self.scale = np.full((FEATURES, LEVELS, BUCKETS), SCALE)

    @staticmethod
    def bucket(seen: np.ndarray) -> np.ndarray:
        return np.clip(np.frexp(seen)[1], 0, BUCKETS - 1)

    def scales(self, seen: np.ndarray) -> np.ndarray:
        """The place in `scale` of each row, if it has so many observations."""
        node, kind = self.vocabulary.kinds()
        level = np.searchsorted(self.vocabulary.first_node, node, "right") - 1
        return (kind * LEVELS + level) * BUCKETS + self.bucket(seen)

    def weights(self) -> np.ndarray:
        """The weight table: ratios times scales."""
        return self._weights(self.scales(self.seen), np.float16)

    def _weights(self, at: np.ndarray, kind: type) -> np.ndarray:
        by_row = self.scale.ravel().astype(np.float32)[at]
        out = np.empty(self.ratio.shape, kind)
        for a in range(0, len(out), 1 << 16):
            out[a : a + (1 << 16)] = np.clip(self.ratio[a : a + (1 << 16)] * by_row[a : a + (1 << 16), None], -LARGEST, LARGEST)
        return out

    def training(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights as a place that is trained on sees them, with one observation less, and each row's number
        of observations and place in `scale` in one integer; made once in a process."""
        if not hasattr(self, "_training"):
            at = self.scales(np.maximum(self.seen - 1, 0))
            table = self._weights(at, np.float32)
            table[self.seen <= 1] = 0
            self._training = table, self.seen.astype(np.int64) << 16 | at
        return self._training

    def gradient(self, f: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over places of expected less observed, and of the variance, by scale; a place's own observation is left out.

        Sums are taken of weights, and divided by the scales at the end.
        """
        vocab, size = self.vocabulary, self.scale.size
        table, about = self.training()
        scale, share_of = self.scale.ravel().astype(np.float32), vocab.share.ravel()
        g, h, one = np.zeros(size), np.zeros(size), np.ones(WIDTH, np.float32)
        spare = np.empty((FEATURES + 2, min(PLACES, max(1, len(leaf))), WIDTH), np.float32)
        for a in range(0, len(leaf), PLACES):
            fa = f[a : a + PLACES]
            *held, x, product = spare[:, : len(fa)]
            i = np.arange(len(fa)) * WIDTH
            for _, node, part in vocab.steps(leaf[a : a + PLACES]):
                rows, own = vocab.row(fa, node).T, i + part
                vocab.base_log.take(node, 0, x, "clip")
                share = share_of.take(node * WIDTH + part)
                least = (PRIOR * share + EVEN).astype(np.float32)
                share, places = share.astype(np.float32), []
                for k in range(FEATURES):
                    weight = held[k]
                    table.take(rows[k], 0, weight, "clip")
                    known = about.take(rows[k])
                    at, n = known & 0xFFFF, (known >> 16).astype(np.float32)
                    s, expected = scale.take(at), n * share + least
                    v = np.exp(weight.ravel().take(own) / s) * expected - np.float32(1)
                    v = np.clip(s * np.log(np.maximum(v, least) / expected), -LARGEST, LARGEST)
                    v[n <= 1] = 0
                    weight.ravel()[own] = v
                    x += weight
                    places.append((at, v))
                np.exp(x, out=x)
                whole = x @ one
                for weight, (at, v) in zip(held, places, strict=True):
                    np.multiply(x, weight, out=product)
                    mean = (product @ one) / whole
                    product *= weight
                    g += np.bincount(at, mean - v, size)
                    h += np.bincount(at, (product @ one) / whole - mean * mean, size)
        return g / self.scale.ravel(), h / self.scale.ravel() ** 2

    def step(self, g: np.ndarray, h: np.ndarray) -> None:
        """A damped Newton step of the scales."""
        move = (g / (0.5 * FEATURES * h + 50)).reshape(self.scale.shape)
        scale = np.clip(self.scale - np.clip(move, -0.25, 0.25), -0.2, 1.2)
        self.scale = np.where(np.abs(scale) < SCALE_LEAST, SCALE_LEAST, scale)
        self.__dict__.pop("_training", None)


class Scorer:
    """What tasks need to score: the vocabulary and the finished weights."""

    def __init__(self, model: Model):
        self.vocabulary, self.table = model.vocabulary, model.weights()

    def wide(self) -> np.ndarray:
        """The weights in single precision, made once in a process: numpy adds half precision slowly."""
        if self.table.dtype != np.float32:
            self.table = self.table.astype(np.float32)
        return self.table

    def log_probability(self, leaf: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log of the way to each place's leaf; tail tokens lack their share of it."""
        f, leaf = features(leaf, kind, first), np.where(leaf >= 0, leaf, LEAVES - TAIL + kind)
        table, out, one = self.wide(), np.zeros(len(leaf)), np.ones(WIDTH, np.float32)
        spare = np.empty((2, min(PLACES, len(leaf)), WIDTH), np.float32)
        for a in range(0, len(leaf), PLACES):
            fa = f[a : a + PLACES]
            x, held = spare[:, : len(fa)]
            i = np.arange(len(fa)) * WIDTH
            for _, node, part in self.vocabulary.steps(leaf[a : a + PLACES]):
                rows = self.vocabulary.row(fa, node).T
                self.vocabulary.base_log.take(node, 0, x, "clip")
                for k in range(FEATURES):
                    x += table.take(rows[k], 0, held, "clip")
                own = x.ravel().take(i + part).astype(np.float64)
                np.exp(x, out=x)
                out[a : a + PLACES] += own - np.log(x @ one)
        return out

    def tail_share(self, count: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """log10 of a tail token's share of its class."""
        return np.log10((count + SMOOTH) / self.vocabulary.tail[kind])


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, kind, c): training counts of all tokens in `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def counted() -> pa.RecordBatch:
            h, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(kind[first]), pa.array(n.astype(np.int64))], names=["token", "kind", "c"])

        for batch in batches:
            text = one_array(batch.column(0))
            for i, j in chunks(text):
                h, kind, _ = tokens(text.slice(i, j - i))
                parts.append((h, kind.astype(np.int8)))
                held += len(h)
                if held >= COUNTED_TOKENS:
                    yield counted()
                    held = 0
        if held:
            yield counted()

    lean(docs.sparkSession)
    return cut(docs.select("text").mapInArrow(tidy(run), "token long, kind byte, c long").groupBy("token").agg(F.max("kind").alias("kind"), F.sum("c").alias("c")), "counts")


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary, and the least count of its frequent tokens.

    Frequent are the tokens with a count that at most FREQUENT tokens reach.
    """
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least, n = 1 << 62, 0
    levels = counts.groupBy("c").count().orderBy(F.desc("c")).limit(FREQUENT).toArrow()
    for c, k in zip(levels["c"].to_pylist(), levels["count"].to_pylist(), strict=True):
        n += k
        if n > FREQUENT:
            break
        least = c
    top = counts.where((F.col("c") >= least) | (F.col("token") == int(END.view(np.int64)))).toArrow()
    kinds = {r["kind"]: r["m"] for r in counts.groupBy("kind").agg((F.sum("c") + SMOOTH * F.count(F.lit(1))).alias("m")).collect()}
    tail = np.array([float(kinds.get(k, 0.0)) for k in range(TAIL)])
    vocab = Vocabulary(top["token"].to_numpy().view(U64), top["c"].to_numpy(), total, distinct, tail)
    own = vocab.slot >= 0
    kind = top["kind"].to_numpy()[np.argsort(top["token"].to_numpy().view(U64))]
    tail -= np.bincount(kind[own], vocab.count[own] + SMOOTH, TAIL)
    return Vocabulary(top["token"].to_numpy().view(U64), top["c"].to_numpy(), total, distinct, tail), least


def train(docs: DataFrame, vocab: Vocabulary, *, rounds: int = ROUNDS) -> Model:
    """The model of all texts in `text`.

    One pass counts, for the features of every place, which part each class chose; tables of counts are
    summed by slices and become log ratios. All texts are then dealt among the rounds by their hash, and each
    round sums the scales' gradients over its texts, so every place enters the scales once. Both are sums over
    places, so how texts are dealt over files and tasks doesn't matter.
    """
    spark = docs.sparkSession
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    rows = docs.select("text", F.pmod(F.xxhash64("text"), F.lit(max(1, rounds))).alias("part")).coalesce(tasks)
    told = spark.sparkContext.broadcast(vocab)
    border = np.linspace(0, vocab.rows, SLICES + 1).astype(np.int64)

    def places(vocab: Vocabulary, text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in chunks(text):
            h, kind, first = tokens(text.slice(i, j - i))
            leaf, _ = vocab.find(h)
            yield features(leaf, kind, first), np.where(leaf >= 0, leaf, LEAVES - TAIL + kind)

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = told.value
        table, any_ = np.zeros(vocab.rows * WIDTH, np.uint32), False
        for batch in batches:
            for f, leaf in places(vocab, one_array(batch.column(0))):
                any_ = any_ or len(leaf) > 0
                for a in range(0, len(leaf), PLACES):
                    for _, node, part in vocab.steps(leaf[a : a + PLACES]):
                        np.add.at(table, (vocab.row(f[a : a + PLACES], node) * WIDTH + part[:, None]).ravel(), np.uint32(1))
        for k in range(SLICES) if any_ else ():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([table[border[k] * WIDTH : border[k + 1] * WIDTH].tobytes()], pa.binary())], names=["slice", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, sums = told.value, {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(counts.as_buffer(), np.uint32)
                sums[k] = sums[k] + x if k in sums else x.astype(np.int64)
        if not sums:
            return
        node, _ = vocab.kinds()
        for k, x in sums.items():
            x = x.reshape(-1, WIDTH)
            seen = x.sum(1)
            share = vocab.share[node[border[k] : border[k + 1]]]
            ratio = np.log((x + PRIOR * share + EVEN) / ((seen + PRIOR)[:, None] * share + EVEN))
            ratio[seen == 0] = 0
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([ratio.astype(np.float16).tobytes()], pa.binary()), pa.array([seen.astype(np.float32).tobytes()], pa.binary())], names=["slice", "ratio", "seen"])

    counted = rows.mapInArrow(tidy(observe), "slice int, counts binary").repartition(SLICES, "slice")
    got = counted.mapInArrow(tidy(merge), "slice int, ratio binary, seen binary").toArrow()
    model = Model(vocab)
    if not got.num_rows:
        return model
    order = np.argsort(got["slice"].to_numpy())
    model.ratio = np.concatenate([np.frombuffer(got["ratio"][int(k)].as_buffer(), np.float16) for k in order]).reshape(-1, WIDTH)
    model.seen = np.concatenate([np.frombuffer(got["seen"][int(k)].as_buffer(), np.float32) for k in order])
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def slope(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            g, h = np.zeros(model.scale.size), np.zeros(model.scale.size)
            for batch in batches:
                for f, leaf in places(model.vocabulary, one_array(batch.column(0))):
                    x, y = model.gradient(f, leaf)
                    g, h = g + x, h + y
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary()), pa.array([h.tobytes()], pa.binary())], names=["g", "h"])

        sums = rows.where(F.col("part") == turn).select("text").mapInArrow(tidy(slope), "g binary, h binary").toArrow()
        g, h = (np.sum([np.frombuffer(x.as_buffer()) for x in sums[c]], axis=0) for c in ("g", "h"))
        model.step(g, h)
        shared.unpersist()
    return model


def score(docs: DataFrame, model: Model, counts: DataFrame, least: int) -> DataFrame:
    """`docs` less its text, with n_tokens, n_known, train_tokens, base_score and score.

    Places are scored in batches where the texts are read; a token that is not among the frequent ones
    takes its count by a join, and no token of that join has `least` or more in training.
    """
    made = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in docs.columns if c != "text" and c not in made and not c.startswith("__")]
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(model))
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        vocab = model.vocabulary
        for batch in batches:
            text = one_array(batch.column(n_keep))
            for i, j in chunks(text):
                h, kind, first = tokens(text.slice(i, j - i))
                leaf, count = vocab.find(h)
                logs = model.log_probability(leaf, kind, first) / np.log(10)
                rare, tail = count < 0, (leaf < 0) & (count >= 0)
                logs[tail] += model.tail_share(count[tail], kind[tail])
                base = np.where(rare, 0.0, vocab.base(np.maximum(count, 0)))
                at = first[:-1]
                per = np.add.reduceat(rare.astype(np.int64), at)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, j - i) for k in range(n_keep)), pa.array(np.diff(first)), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logs, at)), list_array(h[rare].view(np.int64), per, pa.int64()), list_array(kind[rare].astype(np.int8), per, pa.int8())],
                    names=[*keep, "n_tokens", "__known", "__base", "__score", "__rare", "__kind"],
                )

    schema = rows.drop("text").withColumns({"n_tokens": F.lit(0).cast("long"), "__known": F.lit(0).cast("long"), "__base": F.lit(0.0), "__score": F.lit(0.0), "__rare": F.array().cast("array<long>"), "__kind": F.array().cast("array<byte>")}).schema
    vocab = model.vocabulary
    got = cut(rows.mapInArrow(tidy(run), schema).withColumn("__row", F.monotonically_increasing_id()), "places")
    rare = got.select("__row", F.explode(F.arrays_zip("__rare", "__kind")).alias("x")).select("__row", F.col("x.__rare").alias("token"), F.col("x.__kind").alias("k"))
    few = counts.where(F.col("c") < least).select("token", "c")
    tail = F.array(*(F.lit(float(x)) for x in vocab.tail))
    joined = rare.join(few, "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    share = F.log10((F.col("c") + SMOOTH) / F.element_at(tail, F.col("k").cast("int") + 1))
    base = F.log10((F.col("c") + SMOOTH) / F.lit(vocab.total + SMOOTH * (vocab.distinct + 1)))
    sums = joined.groupBy("__row").agg(F.count_if(F.col("c") > 0).alias("k"), F.sum(base).alias("b"), F.sum(share).alias("s"))
    full = got.drop("__rare", "__kind").join(sums, "__row", "left")
    zero = F.lit(0)
    return full.select(
        *keep, "n_tokens", (F.col("__known") + F.coalesce("k", zero)).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("__base") + F.coalesce("b", zero)).alias("base_score"), (F.col("__score") + F.coalesce("s", zero)).alias("score"),
    )


def train_and_score(docs: DataFrame, held_out: str) -> DataFrame:
    """The scores of all rows of `docs`, by a model of those whose column `held_out` is false.

    Null text counts as empty, whose only token is the end; very long texts are scored whole. Repeated rows
    count and are scored each for itself; an empty table gives an empty one; without training rows every token
    has the count 0. Columns of `docs` named like the results, or beginning with "__", are replaced.
    """
    learn = docs.where(~F.col(held_out)).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = count_tokens(learn)
    vocab, least = vocabulary(counts)
    return score(docs, train(learn, vocab), counts, least)
