"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, U64, chunks, lean, one_array, tidy

ORDER = 4
DISCOUNT = 0.75
#: Texts of each language that are sampled for training, in expectation, and as many for calibration;
#: of those a model takes whole texts until it has this many characters.
SAMPLE_DOCS = 300
SAMPLE_CHARS = 600_000
#: Characters of the samples of all languages together; with very many languages each has less.
MODEL_CHARS = 60_000_000
#: Share of texts like those of calibration that may be rejected, symbols from which on a text is long, and the
#: bits for each symbol by which a text has to be above the calibrated bound as well.
FALSE_REJECTION, LONG, MARGIN = 0.001, 300, 0.5
UNKNOWN = "und"
SEED = "lid-1"


@cache
def _letters() -> np.ndarray:
    """Each code point's lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts in lower case, runs of others as one 0 before them; each text's start."""
    joined = "\n".join(x or "" for x in texts)
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)] if joined else np.zeros(0, np.uint32)
    ends = np.cumsum([len(x or "") + 1 for x in texts])
    codes = np.concatenate([np.zeros(1, np.uint32), codes])  # text k begins with the separator before it
    starts = np.concatenate([[0], ends[:-1]])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], np.append(place[starts], place[-1])


def _grams(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 to order the hash of the k symbols that end at each place (from place k - 1 on)."""
    out, h = [], np.zeros(len(codes), U64)
    with np.errstate(over="ignore"):
        values = codes.astype(U64) + U64(1)
        for k in range(order):
            h = h[:-1] * U64(BASE) + values[k:] if k else values.copy()
            out.append(h)
    return out


class KneserNey:
    """Counts of one language, from which any n-gram's log probability follows."""

    def __init__(self, texts: list[str], order: int, discount: float):
        codes, starts = _symbols(texts)
        depth = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
        self.order, self.grams, self.logs = order, [], []
        windows = [np.lib.stride_tricks.sliding_window_view(codes, k) if len(codes) >= k else np.zeros((0, k), np.uint32) for k in range(1, order + 1)]
        chars = []
        for k in range(1, order + 1):
            ok = depth[k - 1 :] >= k - 1 if k > 1 else depth >= 1
            chars.append(_distinct(windows[k - 1][ok]))
        lower_p = None
        for k in range(1, order + 1):
            uniq, count = chars[k - 1]
            if k < order:  # in how many contexts the n-gram stands
                _, inverse = np.unique(np.concatenate([_hash(uniq), _hash(chars[k][0][:, 1:])]), return_inverse=True)
                spread = np.bincount(inverse[len(uniq) :], minlength=inverse.max(initial=-1) + 1)[inverse[: len(uniq)]]
                count = np.maximum(spread, 1)
            context = _hash(uniq[:, :-1])
            _, at = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(at, count), np.bincount(at)
            rest = discount * kinds / total
            below = np.full(len(uniq), 1.0 / (len(uniq) + 1)) if k == 1 else lower_p(uniq[:, 1:])
            p = np.maximum(count - discount, 0) / total[at] + rest[at] * below
            h = _hash(uniq)
            sort = np.argsort(h)
            ctx, first = np.unique(context, return_index=True)
            self.grams.append((h[sort], p[sort], ctx, rest[at[first]]))
            lower_p = self.probability

    def probability(self, grams: np.ndarray) -> np.ndarray:
        """Of the last symbol after the others, for n-grams of up to as many symbols as are counted."""
        k = grams.shape[1]
        if k == 0:
            return np.full(len(grams), 1.0 / (len(self.grams[0][0]) + 1))
        h, p, ctx, rest = self.grams[k - 1]
        at, ok = _find(h, _hash(grams))
        out = np.zeros(len(grams))
        out[ok] = p[at[ok]]
        miss = np.flatnonzero(~ok)
        if len(miss):
            c, known = _find(ctx, _hash(grams[miss, :-1]))
            weight = np.where(known, rest[c], 1.0) if len(rest) else np.ones(len(miss))
            out[miss] = weight * self.probability(grams[miss, 1:])
        return out

    def backoff(self, grams: np.ndarray) -> np.ndarray:
        """What is left for unseen successors of these n-grams; 1 where none was seen."""
        ctx, rest = self.grams[grams.shape[1]][2:]
        at, ok = _find(ctx, _hash(grams))
        return np.where(ok, rest[at], 1.0) if len(rest) else np.ones(len(grams))


def _hash(grams: np.ndarray) -> np.ndarray:
    h = np.zeros(len(grams), U64)
    with np.errstate(over="ignore"):
        for k in range(grams.shape[1]):
            h = h * U64(BASE) + grams[:, k].astype(U64) + U64(1)
    return h


def _distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and how often each stands."""
    _, first, count = np.unique(_hash(grams), return_index=True, return_counts=True)
    return grams[first], count


def _find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, h), max(0, len(table) - 1))
    return at, (table[at] == h if len(table) else np.zeros(len(h), bool))


def _keeps(x: np.ndarray) -> float:
    """The value that all but FALSE_REJECTION of more such values stay under, as far as these can tell."""
    return float(np.sort(x)[min(len(x), int(np.ceil((len(x) + 1) * (1 - FALSE_REJECTION)))) - 1])


class Model:
    """The languages' models side by side: sorted n-gram hashes with each language's log probability."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER, discount: float = DISCOUNT):
        self.languages, self.order = sorted(texts), order
        models = [KneserNey(texts[x], order, discount) for x in self.languages]
        seen = []
        for x in self.languages:
            codes, _ = _symbols(texts[x])
            seen.append(codes)
        self.hash, self.logp, self.rest = [], [], []
        n = len(self.languages)
        for k in range(1, order + 1):
            windows = [_distinct(np.lib.stride_tricks.sliding_window_view(c, k))[0] for c in seen if len(c) >= k]
            grams = _distinct(np.concatenate(windows))[0] if windows else np.zeros((0, k), np.uint32)
            h = _hash(grams)
            sort = np.argsort(h)
            grams = grams[sort]
            self.hash.append(h[sort])
            self.logp.append(np.log2(np.stack([m.probability(grams) for m in models], 1)) if n else np.zeros((len(grams), 0)))
            self.rest.append(np.log2(np.stack([m.backoff(grams) for m in models], 1)) if n and k < order else np.zeros((len(grams), n)))
        self.floor = np.log2(np.stack([m.probability(np.zeros((1, 0), np.uint32)) for m in models], 1))[0] if n else np.zeros(0)
        self.unseen = np.log2(np.array([m.grams[0][3][0] if len(m.grams[0][3]) else 1.0 for m in models])) + self.floor if n else np.zeros(0)
        self.mean, self.slope = np.zeros(n), 1.0
        self.bound, self.short = np.inf, 0.0

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits for each symbol by language, the number of symbols, and whether one is a letter, of each text."""
        codes, starts = _symbols(texts)
        depth = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
        grams = _grams(codes, self.order)
        total = np.empty((len(codes), len(self.languages)))
        top = self.order - 1
        open_ = np.arange(len(codes))
        base = np.zeros((len(codes), len(self.languages)))
        for k in range(top, -1, -1):
            # Places whose n-gram of k + 1 symbols is not known go down, with the context's back-off.
            deep = depth[open_] >= k if k else np.ones(len(open_), bool)
            place = open_[deep]
            at, ok = self._lookup(k, grams, place)
            hit = place[ok]
            total[hit] = self.logp[k][at[ok]] + base[hit]
            missed = place[~ok]
            if k and len(missed):
                c, known = self._lookup(k - 1, grams, missed - 1)
                base[missed[known]] += self.rest[k - 1][c[known]]
            elif len(missed):
                total[missed] = self.unseen + base[missed]
            open_ = np.concatenate([open_[~deep], missed])
        total[starts[:-1]] = 0
        n = np.diff(starts) - 1
        sums = np.add.reduceat(total, starts[:-1], axis=0) if len(texts) else np.zeros((0, len(self.languages)))
        letters = np.add.reduceat((codes != 0).astype(np.int64), starts[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        return -sums / np.maximum(n, 1)[:, None], n, letters

    def _lookup(self, k: int, grams: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _find(self.hash[k], grams[k][place - k])

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index (-1: no letters), calibrated score, whether the text is rejected."""
        bits, n, has = self.entropies(texts)
        if not self.languages:
            return np.full(len(texts), -1), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = np.argmin(bits, 1)
        low = bits[np.arange(len(texts)), best]
        odds = np.exp(-np.minimum((bits - low[:, None]) * np.sqrt(np.maximum(n, 1))[:, None] * self.slope, 700))
        score = np.where(has, 1 / odds.sum(1), 0.0)
        reject = ~has | (low - self.mean[best] > self.bound + MARGIN + self.short / np.sqrt(np.maximum(n, 1)))
        return np.where(has, best, -1), score, reject

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        """Mean cross-entropy by language, the bound above it that a text may reach, and the slope of the score.

        What a text's cross-entropy is above its language's mean has a bound for long texts, and one that adds
        to it by the root of the length for short ones. Each is the value that all but FALSE_REJECTION of
        calibration texts keep, or all of them if they are fewer than that takes.
        """
        margins, above, sizes = [], [], []
        self.mean[:] = np.nan
        for k, x in enumerate(self.languages):
            if not texts.get(x):
                continue
            bits, n, ok = self.entropies(texts[x])
            if not ok.any():
                continue
            own, n = bits[ok, k], n[ok]
            self.mean[k] = np.average(own, weights=n)
            above.append(own - self.mean[k])
            sizes.append(n)
            margins.append((bits[ok] - own[:, None], n))
        if margins:
            self.mean[np.isnan(self.mean)] = np.nanmean(self.mean)  # a language without calibration texts is as the others
            e, n = np.concatenate(above), np.concatenate(sizes)
            self.bound = _keeps(e[n >= LONG] if (n >= LONG).any() else e)
            self.short = max(0.0, _keeps((e - self.bound) * np.sqrt(n)))
        slopes = 2.0 ** np.arange(-4, 8)
        losses = [sum(np.log(np.exp(-np.clip(m * np.sqrt(n)[:, None] * s, -700, 700)).sum(1)).sum() for m, n in margins) for s in slopes]
        self.slope = float(slopes[int(np.argmin(losses))]) if margins else 1.0


def train(labelled: DataFrame, *, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, seed: str = SEED) -> Model:
    """A model of the languages in `labelled` (text, lang), learnt from a bounded sample of each.

    A language's texts are sampled by a hash of the text, `sample_docs` of them in expectation for
    training and as many for calibration, whole texts until there are `sample_chars` characters. Rows
    with null text or lang are left out; of copies in a language one is taken.
    """
    rows = labelled.where("text is not null and lang is not null").select("lang", "text")
    counts = rows.groupBy("lang").count()
    pick = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) / float(1 << 30)
    n_languages = counts.count()
    sample_chars = min(sample_chars, MODEL_CHARS // max(1, 2 * n_languages))
    few = F.broadcast(counts) if n_languages <= 10_000 else counts
    picked = rows.join(few, "lang").withColumn("__pick", pick * F.col("count") / sample_docs).where("__pick < 2")
    picked = picked.select("lang", "text", "__pick").dropDuplicates(["lang", "text"])

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        """Whole texts in the order of the hash until each half's characters are reached."""
        pdf = pdf.sort_values(["__pick", "text"])
        out = []
        for half, part in ((0, pdf[pdf.__pick < 1]), (1, pdf[pdf.__pick >= 1])):
            size = part.text.str.len()
            out.append(part[size.cumsum() - size < sample_chars].assign(half=half))
        return pd.concat(out)[["lang", "half", "text"]]

    sample = picked.groupBy("lang").applyInPandas(take, "lang string, half int, text string").toArrow().to_pandas()
    halves = [{x: g.text.tolist() for x, g in sample[sample.half == h].groupby("lang")} for h in (0, 1)]
    for x in halves[1]:
        halves[0].setdefault(x, halves[1][x])
    model = Model(halves[0], order)
    model.calibrate({x: halves[1].get(x) or halves[0][x] for x in halves[0]})
    return model


def identify(docs: DataFrame, model: Model, *, only_accepted: bool = False) -> DataFrame:
    """`docs` with lang_pred, score and rejected, or the accepted rows of `docs` alone.

    lang_pred has the lowest cross-entropy for each symbol, ties to the first language in order; `und`
    with score 0 for null texts and those without letters, all of which are rejected. score is the
    calibrated probability of lang_pred among the languages. A text is also rejected if its cross-entropy is
    further above its language's mean than calibration texts of its length reach, of which one in a thousand
    would be. Texts that tie in cross-entropy, such as repeated rows, get the same. Symbols are lower-case letters; each run of
    other characters counts as one space. An empty table gives an empty one; columns of `docs` named like
    the results are replaced.
    """
    made = ("lang_pred", "score", "rejected")
    rows = docs if only_accepted else docs.drop(*[c for c in docs.columns if c in made])
    columns = rows.columns
    at, shared = columns.index("text"), lean(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            text = one_array(batch.column(at))
            best, score, reject = (np.concatenate(x) if x else np.zeros(0) for x in zip(*(model.predict(text.slice(i, j - i).to_pylist()) for i, j in chunks(text, 1 << 18)), strict=True)) if len(text) else ([], [], np.zeros(0, bool))
            if only_accepted:
                yield batch.filter(pa.array(~reject))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[np.asarray(best, int)], pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_())], names=[*columns, *made])

    if only_accepted:
        return rows.mapInArrow(tidy(run), rows.schema)
    return rows.mapInArrow(tidy(run), rows.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}).schema)
