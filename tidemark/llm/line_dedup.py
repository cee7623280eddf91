"""Line dedup by winnowing: runs of lines that stand earlier are deleted."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, U64, Words, broadcast_if_small, chunks, cut, cut_arrow, lean, list_array, mix, one_array, powers, text_bytes, tidy

#: Any repeated run of so many words is found and deleted.
MIN_WORDS = 50
#: Words of the line grams whose hashes are winnowed; at most MIN_WORDS.
GRAM_WORDS = 25
#: Tables of up to so many deleted runs (24 bytes each) are broadcast, larger ones shuffled.
BROADCAST_RUNS = 1_000_000
#: Tables of up to so many repeated fingerprints or runs (under 40 bytes each) are broadcast, larger ones shuffled.
BROADCAST_KEYS = 200_000
#: Another odd multiplier: runs are alike when two hashes of 64 bits are.
OTHER = 0xD6E8FEB86659FD93 | 1
BLANK = re.compile(r"[\x20\t-\r]*")
LINES = "__d long, __h long, line array<int>, hash array<long>, other array<long>, words array<int>"


def _line_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = one_array(batch.column(2))
        for i, j in chunks(text):
            raw, at = text_bytes(text.slice(i, j - i))
            w = Words(raw, at, lower=None)
            breaks = np.concatenate([[0], np.cumsum(raw == 10)])
            doc = np.repeat(np.arange(j - i), w.counts)
            line = breaks[w.start] + doc
            first = np.flatnonzero(np.diff(line, prepend=-1))
            end = np.append(first[1:], len(line))
            got = _runs(w.hash, first, end)
            base = breaks[at[:-1]] + np.arange(j - i)
            number = line[first] - base[doc[first]]
            per = np.bincount(doc[first], minlength=j - i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), list_array(number, per, pa.int32()), list_array(got.view(np.int64), per, pa.int64()), list_array(_runs(mix(w.hash), first, end, OTHER).view(np.int64), per, pa.int64()), list_array(end - first, per, pa.int32())],
                names=["__d", "__h", "line", "hash", "other", "words"],
            )


def _runs(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """A hash of h[start:end] for each pair, from prefix sums."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, U64)
        np.cumsum((h | U64(1)) * powers(base, len(h)), dtype=U64, out=total[1:])
        return mix((total[end] - total[start]) * powers(pow(base, -1, 1 << 64), len(h) + 1)[start] + (end - start).astype(U64))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Line numbers, both hashes and word counts of all rows, row borders, each line's row."""
    lists = [one_array(batch.column(k)) for k in (2, 3, 4, 5)]
    at = lists[0].offsets.to_numpy()
    line, h, other, words = (x.values.to_numpy(zero_copy_only=False)[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in lists)
    at = at - at[0]
    return line, h.view(U64), other.view(U64), words.astype(np.int64), at, np.repeat(np.arange(len(at) - 1), np.diff(at))


def _ends(words: np.ndarray, at: np.ndarray, row: np.ndarray, least: int) -> np.ndarray:
    """For each line the end of the shortest run from it of `least` words within its row, or -1."""
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[:-1] + least)
    return np.where(end <= at[row + 1], end, -1)


def _fingerprints(gram_words: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, h, _, words, at, row = _flat(batch)
            gram_end = _ends(words, at, row, gram_words)
            ok = np.flatnonzero(gram_end >= 0)
            gram = np.full(len(h), ~U64(0))
            gram[ok] = _runs(h, ok, gram_end[ok])
            # A window: the starts from a line on that hold min_words - gram_words words, one at least.
            stop = _ends(words, at, row, max(1, min_words - gram_words))
            best, low = np.arange(len(h)), gram.copy()
            step, live = 1, np.flatnonzero(stop > np.arange(len(h)) + 1)
            while len(live):
                less = live[gram[live + step] < low[live]]
                best[less], low[less] = less + step, gram[less + step]
                step += 1
                live = live[stop[live] > live + step]
            chosen = np.unique(best[(stop >= 0) & (low != ~U64(0))])
            d, k = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            r = row[chosen]
            yield pa.RecordBatch.from_arrays([pa.array(gram[chosen].view(np.int64)), pa.array(d[r]), pa.array(k[r]), pa.array((chosen - at[r]).astype(np.int32))], names=["fp", "__d", "__h", "pos"])

    return run


def _segments(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line, h, other, words, at, row = _flat(batch)
            end = _ends(words, at, row, min_words)
            i = np.flatnonzero(end >= 0)
            total = np.concatenate([[0], np.cumsum(words)])
            back = np.searchsorted(total, total[1:] - min_words, "right") - 1
            e = np.flatnonzero((total[1:] - min_words >= 0) & (back >= at[row]))
            runs = np.unique(np.concatenate([np.stack([i, end[i]], 1), np.stack([back[e], e + 1], 1)]), axis=0)
            found = one_array(batch.column(6))
            hits = np.sort(np.repeat(at[:-1], found.value_lengths().to_numpy()) + found.flatten().to_numpy())
            runs = runs[np.searchsorted(hits, runs[:, 1]) > np.searchsorted(hits, runs[:, 0])] if len(runs) else runs.reshape(0, 2)
            a, b = runs[:, 0], runs[:, 1]
            d, k = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            r = row[a]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_runs(h, a, b).view(np.int64)), pa.array(_runs(other, a, b, OTHER).view(np.int64)), pa.array(d[r]), pa.array(k[r]), pa.array((a - at[r]).astype(np.int32)), pa.array(line[a].astype(np.int32)), pa.array(line[b - 1].astype(np.int32))],
                names=["seg", "seg2", "__d", "__h", "pos", "first", "last"],
            )

    return run


def _delete(text: str | None, runs: list[dict] | None) -> tuple[str | None, int]:
    if text is None or not runs:
        return text, 0
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, np.int64)
    for r in runs:
        gone[r["first"]] += 1
        gone[r["last"] + 1] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    full = np.flatnonzero([not BLANK.fullmatch(x) for x in lines])
    for a, b in zip(full[:-1], full[1:], strict=True):
        keep[a + 1 : b] = keep[a] or keep[b]
    return "\n".join(x for x, k in zip(lines, keep, strict=True) if k), int((~keep).sum())


def repeated_runs(docs: DataFrame, *, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """(__d, __h, runs): for each text with deletions the ranges of line numbers that go."""
    lean(docs.sparkSession)
    gram_words = min(gram_words, min_words)
    keyed = docs.select(*_keys(), "text").where("text is not null")
    lines = cut_arrow(keyed, _line_table, LINES, "lines")
    prints = lines.mapInArrow(tidy(_fingerprints(gram_words, min_words)), "fp long, __d long, __h long, pos int")
    place = F.struct("__d", "__h", "pos")
    # Sums by key go out of each task first; what many texts share then meets them in a broadcast, or in a
    # join of its own that Spark can split.
    about = 4 * lines.count()  # of repeated fingerprints and runs, for the number of files
    repeated = cut(prints.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fp"), "fingerprints", about)
    hits = prints.join(broadcast_if_small(repeated, repeated.count(), BROADCAST_KEYS), "fp", "left_semi").groupBy("__d", "__h").agg(F.collect_set("pos").alias("hits"))
    seg = lines.join(hits, ["__d", "__h"]).select("__d", "__h", "line", "hash", "other", "words", "hits")
    seg = cut_arrow(seg, _segments(min_words), "seg long, seg2 long, __d long, __h long, pos int, first int, last int", "segments")
    first = cut(seg.groupBy("seg", "seg2").agg(F.min(place).alias("origin"), F.max(place).alias("end")).where("origin <> end").drop("end"), "origins", about)
    later = seg.join(broadcast_if_small(first, first.count(), BROADCAST_KEYS), ["seg", "seg2"]).where(place > F.col("origin"))
    return later.groupBy("__d", "__h").agg(F.collect_set(F.struct("first", "last")).alias("__runs"))


def _keys() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("__d"), F.xxhash64("text").alias("__h")]


def line_dedup(docs: DataFrame, *, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS, count: str | None = None, drop_emptied: bool = False) -> DataFrame:
    """`docs` with `text` less every run of consecutive lines of `min_words` words that also stands earlier.

    Earlier: in a smaller doc_id (null is smallest; texts of the same id in order of their hash), or
    further up in the same text. Lines are alike when their words are; lines without words don't count
    for runs and go where the lines before and after them go. Winnowing picks in each window of lines the
    least hash of a line gram, so any repeated run shares a fingerprint; positions are joined on it, and
    around each hit the runs of `min_words` words forward and backward of every line are compared by 128 bits
    of hashes, which together extend the match both ways to its full length. Rows alike in doc_id and text count as one document.
    Null text stays null, empty text empty; very long texts are taken whole; an empty table gives an empty one.
    Columns of `docs` whose names begin with "__" are dropped, others stay. `count` names a column for the
    number of deleted lines, which replaces one of that name; `drop_emptied` drops the rows that lost all
    their words.
    """
    rows = docs.drop(*[c for c in docs.columns if c.startswith("__") or c == count])
    runs = cut(repeated_runs(rows, min_words=min_words, gram_words=gram_words), "runs")
    n = runs.agg(F.coalesce(F.sum(F.size("__runs")), F.lit(0))).first()[0]
    d, h = _keys()
    joined = rows.withColumns({"__d": d, "__h": h}).join(broadcast_if_small(runs, n, BROADCAST_RUNS), ["__d", "__h"], "left").drop("__d", "__h")
    names = rows.columns
    at = names.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(len(names))
            texts, gone = batch.column(at), np.zeros(len(batch), np.int64)
            keep = np.ones(len(batch), bool)
            if marks.null_count < len(batch):
                texts = texts.to_pylist()
                for r in np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False)):
                    texts[r], gone[r] = _delete(texts[r], marks[int(r)].as_py())
                    keep[r] = not drop_emptied or bool(texts[r].strip(" \t\n\v\f\r"))
                texts = pa.array(texts, batch.column(at).type)
            columns = [texts if k == at else batch.column(k) for k in range(len(names))]
            out = pa.RecordBatch.from_arrays([*columns, *([pa.array(gone)] if count else [])], names=[*names, *([count] if count else [])])
            yield out if keep.all() else out.filter(pa.array(keep))

    schema = rows.schema if not count else rows.withColumn(count, F.lit(0).cast("long")).schema
    return joined.select(*names, "__runs").mapInArrow(tidy(apply), schema)
