"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, U64, Words, broadcast_if_small, chunks, cut, lean, mix, one_array, text_bytes, tidy

#: Words of an overlap, and how many of them may be substituted.
WINDOW = 13
SUBSTITUTIONS = 2
#: Items of so few words don't count; with 1, all of them do.
LEAST = 1
#: Any 13 words with up to two substituted agree on the 1s of one of these masks somewhere.
MASKS_13_2 = ("11101111", "11110010011", "10010111101")
#: A benchmark of up to so many different items and bytes is sent to all tasks; a larger one is joined by seeds.
SENT_ITEMS = 20_000
SENT_BYTES = 16_000_000
#: Bits of the sieve that is sent in its place (16 MB), in so many slices.
SIEVE_BITS, SIEVE_SLICES = 1 << 27, 64
SIEVE = 1 << 22
#: Tables of up to so many documents that go (some 10 MB) are broadcast, larger ones shuffled.
BROADCAST_ROWS = 100_000
#: Hits that are held at once.
HITS = 1 << 20


def allowed(length: int, window: int, substitutions: int) -> int:
    """Substitutions in an overlap of `length` words: in proportion where an item is shorter than the window."""
    return substitutions if length >= window else substitutions * length // window


def masks(length: int, substitutions: int) -> tuple[str, ...]:
    """Seeds of which every run of `length` words with so many substituted has one that none of them touches.

    For 13 and 2 three masks found by search; for others one mask of a part's length, as of as many parts of
    the run as substitutions, and one more, one is untouched.
    """
    if (length, substitutions) == (13, 2):
        return MASKS_13_2
    return ("1" * max(1, length // (substitutions + 1)),)


def covers(seeds: tuple[str, ...], length: int, substitutions: int) -> bool:
    """Whether the seeds do what `masks` says, by trying all places of substitutions."""
    spots = [{k + i for i, bit in enumerate(m) if bit == "1"} for m in seeds for k in range(length - len(m) + 1)]
    return all(any(not x & set(gone) for x in spots) for gone in combinations(range(length), min(substitutions, length)))


def _masked(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, int(mask, 2), U64)
    with np.errstate(over="ignore"):
        for k, bit in enumerate(mask):
            if bit == "1":
                out = out * U64(BASE) + h[k : k + n]
    return mix(out)


class Seeds:
    """Sorted hashes of all masked windows of a block of items, with the item and word of each."""

    def __init__(self, texts: pa.Array, window: int, substitutions: int, least: int = LEAST):
        raw, at = text_bytes(texts)
        words = Words(raw, at)
        self.window, self.substitutions = window, substitutions
        self.items = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        by_mask: dict[str, list[int]] = {}
        for k, x in enumerate(self.items):
            need = min(window, len(x))
            for mask in masks(need, allowed(need, window, substitutions)) if len(x) >= max(1, least) else ():
                by_mask.setdefault(mask, []).append(k)
        self.masks, found = sorted(by_mask), []
        for mask in self.masks:
            for k in by_mask[mask]:
                h = _masked(self.items[k], mask)
                found.append((h, np.full(len(h), k), np.arange(len(h))))
        h, item, word = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U64), np.zeros(0, int), np.zeros(0, int))
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.word = h[order], item[order], word[order]
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[self.hash & U64(SIEVE - 1)] = True

    def matches(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, overlapping words of the item, first such word of the text)."""
        if not len(self.hash):
            return
        covered: dict[tuple[int, int], list] = {}
        hits: list[np.ndarray] = []
        held = 0
        for mask in self.masks:
            h = _masked(words.hash, mask)
            at = np.flatnonzero(self.sieve[h & U64(SIEVE - 1)])
            lo, hi = np.searchsorted(self.hash, h[at]), np.searchsorted(self.hash, h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            # A seed that many items share makes many hits of each place: they are verified in parts.
            ends = np.cumsum(n)
            for a, b in _parts(ends, HITS):
                some = n[a:b]
                which = np.repeat(lo[a:b] - np.concatenate([[0], np.cumsum(some)[:-1]]), some) + np.arange(some.sum())
                place = np.repeat(at[a:b], some)
                hits.append(np.stack([np.searchsorted(words.first, place, "right") - 1, self.item[which], place - self.word[which]], 1))
                held += len(place)
                if held >= HITS:
                    self._verify(words, np.concatenate(hits), covered)
                    hits, held = [], 0
        if hits:
            self._verify(words, np.concatenate(hits), covered)
        for (doc, item), (seen, first) in covered.items():
            yield doc, item, int(seen.sum()), first

    def _verify(self, words: Words, hits: np.ndarray, covered: dict[tuple[int, int], list]) -> None:
        """Compares each item that a hit names with the words around the hit."""
        for doc, item, start in np.unique(hits, axis=0):
            _compare(words, int(doc), self.items[item], int(start), self.window, self.substitutions, covered, (int(doc), int(item)))


def _compare(words: Words, doc: int, x: np.ndarray, start: int, window: int, substitutions: int, covered: dict, key) -> None:
    """Marks in `covered` which words of item x a text has in overlaps, if x begins at word `start` of all."""
    need = min(window, len(x))
    a, b = max(start, words.first[doc]), min(start + len(x), words.first[doc + 1])
    if b - a < need:
        return
    same = words.hash[a:b] == x[a - start : b - start]
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[need:] - total[:-need] >= need - allowed(need, window, substitutions))
    if len(good):
        seen = covered.setdefault(key, [np.zeros(len(x), bool), int(a + good[0] - words.first[doc])])
        seen[1] = min(seen[1], int(a + good[0] - words.first[doc]))
        for g in good:
            seen[0][a - start + g : a - start + g + need] = True


def _parts(ends: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of places whose numbers add up to `size` at most, or one place."""
    a, done = 0, 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, done + size, "right")))
        yield a, b
        a, done = b, int(ends[b - 1])


def _items(benchmark: DataFrame) -> tuple[DataFrame, int, int]:
    """(k, item_id, text) of the different items with text, their number and bytes."""
    items = cut(benchmark.where("text is not null").distinct().select(F.monotonically_increasing_id().alias("k"), "item_id", "text"), "items")
    return items, *items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()


def _sent(items: DataFrame, window: int, substitutions: int, least: int) -> tuple[list, Seeds]:
    rows = items.toArrow()
    return rows["item_id"].to_pylist(), Seeds(one_array(rows["text"]).cast(pa.string()), window, substitutions, least)


def _keys() -> list:
    return [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__d"), F.xxhash64("text").alias("__h")]


def _joined(docs: DataFrame, items: DataFrame, window: int, substitutions: int, least: int) -> DataFrame:
    """(__d, __h, k, overlap, word) of texts and items that overlap, for a benchmark of any size.

    Seeds of the items and, as far as they pass a sieve of all seeds, of the texts meet by a join in one scan
    of the texts; each text that has hits is then compared with the items that they name.
    """
    spark = docs.sparkSession

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = Seeds(one_array(batch.column(1)), window, substitutions, least)
                k = batch.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(found.hash.view(np.int64)), pa.array(k[found.item] if len(found.item) else found.item), pa.array(found.word)], names=["seed", "k", "at"])

    own = cut(items.select("k", "text").mapInArrow(tidy(seeds), "seed long, k long, at long"), "seeds")
    size = SIEVE_BITS // SIEVE_SLICES

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            place = (batch.column(0).to_numpy().view(U64) & U64(SIEVE_BITS - 1)).astype(np.int64)
            for k in np.unique(place // size):
                held.setdefault(int(k), np.zeros(size, bool))[place[place // size == k] % size] = True
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(x).tobytes()], pa.binary())], names=["slice", "bits"])

    dealt = own.select("seed").repartition(SIEVE_SLICES, F.shiftright(F.col("seed").bitwiseAND(F.lit(SIEVE_BITS - 1)), (size - 1).bit_length()))
    sieve = np.zeros(SIEVE_BITS // 8, np.uint8)
    slices = dealt.mapInArrow(tidy(bits), "slice int, bits binary").toArrow()  # at most the sieve itself
    for k, x in zip(slices["slice"].to_pylist(), slices["bits"], strict=True):
        sieve[k * size // 8 : (k + 1) * size // 8] |= np.frombuffer(x.as_buffer(), np.uint8)
    lengths = items.select(F.least(F.size(F.expr("regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")), F.lit(window)).alias("n")).distinct().collect()
    all_masks = sorted({m for (n,) in lengths if n >= max(1, least) for m in masks(n, allowed(n, window, substitutions))})
    sent = spark.sparkContext.broadcast(sieve)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = one_array(batch.column(2))
            for i, j in chunks(text):
                words = Words(*text_bytes(text.slice(i, j - i)))
                for mask in all_masks:
                    h = _masked(words.hash, mask)
                    x = (h & U64(SIEVE_BITS - 1)).astype(np.int64)
                    at = np.flatnonzero(sent.value[x >> 3] & (np.uint8(128) >> (x & 7).astype(np.uint8)))
                    doc = np.searchsorted(words.first, at, "right") - 1
                    take = pa.array(i + doc)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(h[at].view(np.int64)), pa.array(at - words.first[doc])], names=["__d", "__h", "seed", "place"])

    keyed = docs.select(*_keys(), "text").where("text is not null")
    hits = cut(keyed.mapInArrow(tidy(probe), "__d string, __h long, seed long, place long"), "hits")
    named = hits.join(own.hint("merge"), "seed").select("__d", "__h", "k", (F.col("place") - F.col("at")).alias("start"))
    named = named.groupBy("__d", "__h", "k").agg(F.collect_set("start").alias("starts")).join(items.select("k", F.col("text").alias("item")).hint("merge"), "k")
    # A text with very many items is one row of all of them, as it is one row of its words.
    named = cut(named.groupBy("__d", "__h").agg(F.collect_list(F.struct("k", "item", "starts")).alias("asked")), "named")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, h, text, asked in zip(*(batch.column(c) for c in range(4)), strict=True):
                words, covered = Words(*text_bytes(pa.array([text.as_py()]))), {}
                for x in asked.as_py():
                    item = Words(*text_bytes(pa.array([x["item"]]))).hash
                    for start in sorted(x["starts"]):
                        _compare(words, 0, item, start, window, substitutions, covered, x["k"])
                if covered:
                    ks, values = zip(*covered.items(), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([d.as_py()] * len(ks)), pa.array([h.as_py()] * len(ks)), pa.array(ks, pa.int64()), pa.array([int(v[0].sum()) for v in values]), pa.array([v[1] for v in values], pa.int64())], names=["__d", "__h", "k", "overlap", "word"])

    once = keyed.join(named.hint("merge"), ["__d", "__h"]).dropDuplicates(["__d", "__h"])
    return cut(once.select("__d", "__h", "text", "asked").mapInArrow(tidy(verify), "__d string, __h long, k long, overlap long, word long"), "overlaps")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, substitutions: int = SUBSTITUTIONS, least: int = LEAST, sent_items: int = SENT_ITEMS) -> DataFrame:
    """(doc_id, item_id, overlap, word): a row for each text and benchmark item that overlap.

    They overlap where `window` consecutive words of each agree, up to `substitutions` of them; an item
    of fewer words must stand whole in the text, with substitutions in proportion. `overlap` counts the
    item's words in such windows, `word` is the place of the first in the text. Seeds find every overlap, for
    any window. Null or empty texts and items match nothing, nor items of under `least` words; repeated
    documents match each for itself, repeated items count once; empty tables give no rows. Other columns are
    not looked at. Up to `sent_items` items are sent to all tasks, of more the seeds are joined.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_arrow, spark = to_arrow_type(benchmark.schema["item_id"].dataType), lean(docs.sparkSession)
    items, n, size = _items(benchmark)
    if n > sent_items or size > SENT_BYTES:
        found = _joined(docs, items, window, substitutions, least).join(items.select("k", "item_id").hint("merge"), "k")
        return docs.select("doc_id", *_keys()).join(found.hint("merge"), ["__d", "__h"]).select("doc_id", "item_id", "overlap", "word")
    seeds = spark.sparkContext.broadcast(_sent(items, window, substitutions, least))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, index = seeds.value
        for batch in batches:
            text = one_array(batch.column(1))
            for i, j in chunks(text):
                got = list(index.matches(Words(*text_bytes(text.slice(i, j - i)))))
                if got:
                    doc, item, overlap, word = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + d for d in doc])), pa.array([ids[k] for k in item]).cast(item_arrow), pa.array(overlap, pa.int64()), pa.array(word, pa.int64())], names=["doc_id", "item_id", "overlap", "word"])

    return docs.mapInArrow(tidy(probe), f"doc_id {id_type}, item_id {item_type}, overlap long, word long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, substitutions: int = SUBSTITUTIONS, least: int = LEAST, sent_items: int = SENT_ITEMS) -> DataFrame:
    """`docs` without the rows whose text overlaps a benchmark item, as `contamination` finds them.

    Rows with null or empty text stay; repeated rows stay or go together; all columns stay as they are, whatever
    their names. With a benchmark that is sent there is no shuffle: each task drops rows as it reads them.
    """
    spark, at = lean(docs.sparkSession), docs.columns.index("text")
    items, n, size = _items(benchmark.select("item_id", "text"))
    if n > sent_items or size > SENT_BYTES:
        gone = cut(_joined(docs, items, window, substitutions, least).select("__d", "__h").distinct(), "gone")
        d, h = _keys()
        marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), d, h)
        return marked.join(broadcast_if_small(gone, gone.count(), BROADCAST_ROWS), ["__d", "__h"], "left_anti").select("__row.*")
    seeds = spark.sparkContext.broadcast(_sent(items, window, substitutions, least))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, keep = one_array(batch.column(at)), np.ones(len(batch), bool)
            for i, j in chunks(text):
                for doc, *_ in seeds.value[1].matches(Words(*text_bytes(text.slice(i, j - i)))):
                    keep[i + doc] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidy(clean), docs.schema)
