"""Similarity join on word shingles with parity sketches.

A set's parity sketch XORs one bit for each element into blocks that the element's hash chooses. A block
has 2**64 bits, folded to 64 by the XOR of its odd bits' hashes, so that unlike elements hardly ever look
alike. The Hamming distance in blocks of two sketches is at most the size of the symmetric difference,
as each element of it changes one block. Two sets with a Jaccard
similarity of at least t differ in at most q = (1 - t) / t times the smaller size elements, hence in at
most q blocks: if one of them shows its first q + 1 non-empty blocks, at least one of these is equal in
both. Bands of sizes hold sets that share a number of blocks; a set stands in its own band and in the one
below, so that any two linked sets meet in a band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, broadcast_if_small, chunks, cut, drop, lean, list_array, mix, one_array, shingle_sets, text_bytes, tidy

SHINGLE = 5
#: Similarity in per cent, as integers on both sides of the comparison.
PERCENT = 80
#: In groups of up to so many sets with an equal block all pairs are compared, in larger ones each with two leaders first.
GROUP = 24
#: Keys that a task packs at once.
HELD_KEYS = 1 << 19
#: Members of a large group that one task compares by sketches with as many others.
CHUNK = 2048
#: Shingles of the sets that one task counts links of, with as many others.
COUNTED_ITEMS = 1 << 21
#: Shingles of so large a share of a sample of so many texts are hot; at most so many (2 MB) are told to all tasks.
HOT_SHARE, HOT_SAMPLE, HOT_SHINGLES = 0.004, 20_000, 1 << 18
#: Keys that so large a share of another sample's sets show are hot: their groups are dealt by node over all tasks.
KEY_SHARE, KEY_SAMPLE, KEY_LEAST = 0.01, 5_000, 50
#: Components of up to so many links (16 MB) are found in one task, of more in rounds over all.
LOCAL_LINKS = 1_000_000
#: Node tables of up to so many rows (16 MB) are broadcast, larger ones shuffled.
BROADCAST_ROWS = 1_000_000
STAGE = "kind byte, doc_id long, h long, node long, n long, part int, data binary"
FOUND = "kind byte, doc_id long, h long, node long, n long, key long, other long, sketch binary"
DOC, PAIR, MEMBER = 0, 1, 2
SUM = U64(0x9E3779B97F4A7C15)


def band(n: int, percent: int) -> int:
    """Bands grow by the size ratio that linked sets can have at most."""
    return int(math.floor(math.log(n) / math.log(100 / percent) + 1e-9))


def blocks_of(b: int, percent: int) -> int:
    """Blocks of the sketches in band b: more than the most elements in which two of its sets differ."""
    return max(4, math.ceil(most_unlike(b, percent) * 1.08) + 3)


def most_unlike(b: int, percent: int) -> int:
    """Elements in which two linked sets can differ at most if the smaller one is of band b."""
    return int((100 - percent) / percent * (100 / percent) ** (b + 1) + 1e-6)


class Hot:
    """Hashes of very common shingles. Keys stay complete whichever shingles these are."""

    SIEVE = 1 << 20

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(U64))
        self.sieve = np.zeros(self.SIEVE, bool)
        self.sieve[self.hashes & U64(self.SIEVE - 1)] = True

    def without(self, u: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.sieve[u & U64(self.SIEVE - 1)])
        if not len(at):
            return u
        place = np.minimum(np.searchsorted(self.hashes, u[at]), len(self.hashes) - 1)
        return np.delete(u, at[self.hashes[place] == u[at]])


def _blocks(u: np.ndarray, b: int, q: int, percent: int, space: int) -> tuple[np.ndarray, bool]:
    """Keys of the first q + 1 non-empty blocks in band b, and whether there are fewer."""
    if not len(u):
        return u, True
    count = blocks_of(b, percent)
    at = ((u >> U64(32)) * U64(count)) >> U64(32)
    first = np.flatnonzero(np.diff(at, prepend=U64(count)))
    value = np.bitwise_xor.reduceat(mix(u + SUM), first)
    full = np.flatnonzero(value)[: q + 1]
    return mix(value[full] ^ mix(at[first[full]] + U64((b << 40) + (space << 38)))), len(full) <= q


def block_keys(u: np.ndarray, percent: int, hot: Hot | None = None) -> np.ndarray:
    """The keys under which a set (sorted distinct hashes) can meet all sets that it may be linked with.

    Blocks are made of the set without the hot shingles, which differs from another such set in no more
    elements. A set that has too few blocks then also shows those of the whole set, and if these are too
    few, one key that all such sets of the band have.
    """
    n = len(u)
    if not n:
        return np.zeros(0, U64)
    own, q = band(n, percent), (100 - percent) * n // percent
    rest = hot.without(u) if hot else u
    out = []
    for b in (own, own - 1) if own else (own,):
        limit = min(q, most_unlike(b, percent))  # in the band below, the other set is the smaller one
        keys, few = _blocks(rest, b, limit, percent, 0)
        out.append(keys)
        if few:
            keys, few = _blocks(u, b, limit, percent, 1)
            out.append(keys)
        if few:
            out.append(mix(np.array([(b << 40) + (1 << 39)], U64)))
    return np.concatenate(out)


def set_node(u: np.ndarray) -> int:
    """An id of the set itself: equal sets are one node."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(u + SUM).sum(dtype=U64) ^ mix(np.array([len(u)], U64))[0]], U64))[0].view(np.int64))


def bit_sketch(u: np.ndarray) -> bytes:
    """The parity of a set's elements by the low bits of their hash, in four to eight bits for each element."""
    bits = 1 << max(6, int(len(u) - 1).bit_length() + 2) if len(u) else 64
    odd = (np.bincount((u & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


class HotKeys:
    """Keys of large groups, each with two nodes that lead it wherever its rows are."""

    def __init__(self, key: np.ndarray, low: np.ndarray, high: np.ndarray):
        order = np.argsort(key)
        self.key, self.low, self.high = key[order], low[order], high[order]

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key (signed), -1 if it isn't hot."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)


def _sketch(parts: int, shingle: int, percent: int, hot, hot_keys):
    """Documents as (doc_id, node, n), and their keys packed by destination part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        seen: set[int] = set()  # copies in a pack show their keys once
        held = 0

        def packed() -> pa.RecordBatch:
            k, o = np.concatenate(keys), np.concatenate(owners)
            keys.clear()
            owners.clear()
            seen.clear()
            part = (k >> U64(40)) % U64(parts)
            spread = hot_keys.value.find(k.view(np.int64)) >= 0
            part[spread] = mix(o[spread].view(U64)) % U64(parts)
            order = np.argsort(part, kind="stable")
            part, both = part[order], np.stack([k[order].view(np.int64), o[order]], 1)
            first = np.flatnonzero(np.diff(part, prepend=U64(parts)))
            ends = np.append(first[1:], len(part))
            return _rows(FOUND_DOC, kind=pa.array(np.full(len(first), PAIR, np.int8)), part=pa.array(part[first].astype(np.int32)), data=pa.array([both[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()))

        for batch in batches:
            ids, text = batch.column(0), one_array(batch.column(1))
            for i, j in chunks(text):
                nodes, sketches, sizes = [], [], []
                for u in shingle_sets(Words(*text_bytes(text.slice(i, j - i))), shingle):
                    node = set_node(u)
                    nodes.append(node)
                    sizes.append(len(u))
                    sketches.append(bit_sketch(u))
                    if node in seen:
                        continue
                    seen.add(node)
                    got = block_keys(u, percent, hot.value)
                    keys.append(got)
                    owners.append(np.full(len(got), node, np.int64))
                    held += len(got)
                yield _rows(FOUND_DOC, kind=pa.array(np.full(j - i, DOC, np.int8)), doc_id=ids.slice(i, j - i), h=batch.column(2).slice(i, j - i), node=pa.array(nodes, pa.int64()), n=pa.array(sizes, pa.int64()), data=pa.array(sketches, pa.binary()))
                if held >= HELD_KEYS:
                    yield packed()
                    held = 0
        if held:
            yield packed()

    return run


FOUND_DOC = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("h", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])
FOUND_OUT = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("h", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("other", pa.int64()), ("sketch", pa.binary())])


def _rows(schema: pa.Schema, **columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def group_pairs(key: np.ndarray, node: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of nodes with an equal key, and the rows of large groups, from rows sorted by (key, node).

    All pairs of groups of up to `group` nodes; in larger ones, whose rows are returned, the pairs of the
    least and of the greatest node with all others. Groups of one family often have the same two leaders.
    """
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    size = np.diff(np.append(first, len(key)))
    a, b = [], []
    for k in range(2, group + 1):
        at = first[size == k]
        if len(at):
            x, y = np.triu_indices(k, 1)
            a.append(node[at[:, None] + x].ravel())
            b.append(node[at[:, None] + y].ravel())
    big = first[size > group]
    n = n_big = size[size > group]
    rows = np.repeat(big - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(big) else np.zeros(0, int)
    if len(rows):
        other = node[rows]
        for lead in (np.repeat(node[big], n), np.repeat(node[big + n_big - 1], n)):
            a.append(lead[other != lead])
            b.append(other[other != lead])
    return (np.concatenate(a), np.concatenate(b), rows) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64), rows)


def _meet(group: int, hot_keys):
    """Pairs and large groups of each part; documents pass through."""

    def met(packed: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(packed)
        packed.clear()
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        key, node = rows[order, 0], rows[order, 1]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        place = hot_keys.value.find(key)
        at = np.flatnonzero(place >= 0)
        a, b, big = group_pairs(key[place < 0], node[place < 0], group)
        big = np.flatnonzero(place < 0)[big]
        if len(at):
            big = np.concatenate([big, at])
            for lead in (hot_keys.value.low[place[at]], hot_keys.value.high[place[at]]):
                other = lead != node[at]
                a, b = np.concatenate([a, lead[other]]), np.concatenate([b, node[at][other]])
        if len(a):
            both = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            both = both[np.concatenate([[True], (both[1:] != both[:-1]).any(1)])]
            for k in range(0, len(both), 100_000):
                x = both[k : k + 100_000]
                yield _rows(FOUND_OUT, kind=pa.array(np.full(len(x), PAIR, np.int8)), node=pa.array(x[:, 0]), other=pa.array(x[:, 1]))
        for k in range(0, len(big), 100_000):
            at = big[k : k + 100_000]
            yield _rows(FOUND_OUT, kind=pa.array(np.full(len(at), MEMBER, np.int8)), node=pa.array(node[at]), key=pa.array(key[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part; the keys of one part are held at a time."""
        packed: list[np.ndarray] = []
        held = None
        for batch in batches:
            is_doc = batch.column(0).to_numpy(zero_copy_only=False) == DOC
            if is_doc.any():
                docs = batch.filter(pa.array(is_doc))
                yield _rows(FOUND_OUT, kind=docs.column(0), doc_id=docs.column(1), h=docs.column(2), node=docs.column(3), n=docs.column(4), sketch=docs.column(6))
            rest = batch.filter(pa.array(~is_doc))
            for part, x in zip(rest.column(5).to_pylist(), rest.column(6), strict=True):
                if packed and part != held:
                    yield from met(packed)
                held = part
                packed.append(np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2))
        if packed:
            yield from met(packed)

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = one_array(batch.column(0))
            for i, j in chunks(text):
                found = list(shingle_sets(Words(*text_bytes(text.slice(i, j - i))), shingle))
                sizes = np.array([len(u) for u in found])
                yield pa.RecordBatch.from_arrays([pa.array([set_node(u) for u in found], pa.int64()), list_array(np.concatenate(found).view(np.int64), sizes, pa.int64())], names=["node", "items"])

    return run


def _fold(sketch, words: int) -> np.ndarray:
    """The sketch of fewer bits: a parity of parities."""
    got = np.frombuffer(sketch, U64)
    return got if len(got) == words else np.bitwise_xor.reduce(got.reshape(-1, words), axis=0)


def _sift(percent: int):
    """The pairs whose sketches differ in no more bits than the sets of linked texts can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            for r, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = x.as_buffer(), y.as_buffer()
                words = min(len(x), len(y)) // 8
                unlike = int(np.bitwise_count(_fold(x, words) ^ _fold(y, words)).sum())
                keep[r] = unlike * (100 + percent) <= sizes[r] * (100 - percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _compare(percent: int):
    """Pairs of one cell (a chunk of a group's sets outside its main component against a chunk of the whole
    group) that may be linked, by their sketches."""

    def run(table: pa.Table) -> pa.Table:
        left = table["left"].to_numpy(zero_copy_only=False)
        node, comp, n = (table[c].to_numpy() for c in ("node", "comp", "n"))
        sketches = table["sketch"].to_pylist()
        words = min(len(x) for x in sketches) // 8
        folded = np.stack([_fold(x, words) for x in sketches])
        left, right = np.flatnonzero(left), np.flatnonzero(~left)
        out = []
        for k in range(0, len(left), 32):
            x = left[k : k + 32]
            unlike = sum(np.bitwise_count(folded[x, w][:, None] ^ folded[right, w][None, :]).astype(np.int32) for w in range(words))
            sizes = n[x][:, None] + n[right][None, :]
            may = (unlike * (100 + percent) <= sizes * (100 - percent)) & (comp[x][:, None] != comp[right][None, :])
            a, b = np.nonzero(may)
            out.append(np.stack([node[x[a]], node[right[b]]], 1))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _count(percent: int):
    """(node, n): each node's links inside one cell (chunk i against chunk j of a component), from the sets themselves."""

    def run(table: pa.Table) -> pa.Table:
        i, j, chunk, node = (table[c].to_numpy() for c in ("i", "j", "chunk", "node"))
        items = table["items"].combine_chunks()
        n = np.diff(items.offsets.to_numpy()).astype(np.int64)
        _, place = np.unique(items.flatten().to_numpy(), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(n)])
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        beside = np.concatenate([place[first[k] : first[k + 1]] for k in right]) if len(right) else place[:0]
        starts = np.concatenate([[0], np.cumsum(n[right])[:-1]]) if len(right) else right
        mark, links = np.zeros(len(place), bool), np.zeros(len(node), np.int64)
        for k in left if len(right) else left[:0]:
            own = place[first[k] : first[k + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[beside], starts, dtype=np.int64)
            mark[own] = False
            linked = (both * 100 >= (n[k] + n[right] - both) * percent) & (node[right] != node[k])
            links[k] += linked.sum()
            if i[0] != j[0]:
                links[right[linked]] += 1
        return pa.table({"node": node, "n": links})

    return run


def _common(shingle: int, least: int):
    """Shingles of at least `least` texts of a batch, with the number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = one_array(batch.column(0))
            found = [u for i, j in chunks(text) for u in shingle_sets(Words(*text_bytes(text.slice(i, j - i))), shingle)]
            u, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, U64), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(u[n >= least].view(np.int64)), pa.array(n[n >= least])], names=["shingle", "n"])

    return run


def hot_shingles(sample: DataFrame, shingle: int, least: int) -> np.ndarray:
    """Shingles of at least `least` of the sampled texts, at most HOT_SHINGLES of them."""
    found = sample.select("text").mapInArrow(tidy(_common(shingle, 2)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return found.orderBy(F.desc("n"), "shingle").limit(HOT_SHINGLES).toArrow()["shingle"].to_numpy().view(U64)


def common_keys(sample: DataFrame, shingle: int, percent: int, hot, least: int) -> HotKeys:
    """Keys of at least `least` different sets of the sampled texts, with their least and greatest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = one_array(batch.column(0))
            keys, nodes = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for i, j in chunks(text):
                for u in shingle_sets(Words(*text_bytes(text.slice(i, j - i))), shingle):
                    keys.append(block_keys(u, percent, hot.value))
                    nodes.append(np.full(len(keys[-1]), set_node(u), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    found = sample.select("text").mapInArrow(tidy(run), "key long, node long").groupBy("key").agg(F.countDistinct("node").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
    rows = found.where(F.col("n") >= least).toArrow()
    return HotKeys(*(rows[c].to_numpy() for c in ("key", "low", "high")))


def _local_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each link's two ends take the lesser of their labels, and labels their label's, until none changes."""
    ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if len(b)]
    if not ends:
        return
    node, place = np.unique(np.concatenate(ends), return_inverse=True)
    a, b = place.reshape(-1, 2).T
    label = np.arange(len(node))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not np.array_equal(far := new[new], new):
            new = far
        if np.array_equal(new, label):
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label])], names=["node", "comp"])


def components(links: DataFrame, rows: int, known: DataFrame | None = None) -> DataFrame:
    """(node, comp) of all nodes in `links` (a, b): comp is the least node reachable.

    A bounded number of links is worked on in one task. With more, each round takes the least label among
    neighbours, then the label of that label; every round's labels are a table in the shared folder. Rounds
    follow the logarithm of the longest path. `rows` is a bound of the number of links, `known` the
    components of a part of them.
    """
    if rows <= LOCAL_LINKS:
        return cut(links.select("a", "b").repartition(1).mapInArrow(tidy(_local_components), "node long, comp long"), "labels")
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", 2 * rows)
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node")
    if known is not None:
        labels = labels.join(known.withColumnRenamed("comp", "__c"), "node", "left").select("node", F.least("comp", "__c").alias("comp"))
    labels = before = cut(labels, "labels", 2 * rows)
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new = cut(step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("comp")), "labels", 2 * rows)
        changed = new.where("old <> comp").limit(1).count()
        drop(before)
        labels, before = new.select("node", "comp"), new
        if not changed:
            drop(both)
            return labels


def similarity_classes(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id), a row for each row of `docs`.

    Two rows are linked when their sets of distinct `shingle`-word shingles have a Jaccard similarity of
    at least `percent`; component_id is the least doc_id that links lead to. A text of fewer words is one
    shingle; one without words (or null) has none and is its own component. Equal sets are one node, so
    copies are never compared; n_links counts the other nodes with a verified link. Rows
    without doc_id count like others, but give no component an id: component_id is null where no row has
    one. An empty table gives an empty one. Nodes are 64-bit hashes of sets. `params`: shingle, percent,
    group (above so many members two leaders are compared first), chunk, counted.
    """
    return classes(docs, **params).select("doc_id", "n_shingles", "n_links", "component_id")


def classes(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, group: int = GROUP, chunk: int = CHUNK, count: bool = True, counted: int = COUNTED_ITEMS) -> DataFrame:
    """What similarity_classes returns, with the hash of the text and the component's node.

    In groups of more than `group` sets links that can't change a component are not looked for on the way.
    With `count`, components of these sets are compared whole at the end, in cells of two chunks of about
    `counted` shingles that give numbers of links, not pairs; without, n_links is a lower bound there.
    """
    spark = lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * width
    rows = docs.count()
    pick = F.pmod(F.xxhash64(F.lit("hot"), "text"), F.lit(1 << 20)) / (1 << 20)
    sample = cut(docs.select("text", pick.alias("pick")).where(F.col("pick") < HOT_SAMPLE / max(1, rows)), "sample")
    hot = spark.sparkContext.broadcast(Hot(hot_shingles(sample, shingle, max(8, int(min(rows, HOT_SAMPLE) * HOT_SHARE)))))
    again = sample.where(F.col("pick") < KEY_SAMPLE / max(1, rows)).dropDuplicates(["text"])
    hot_keys = spark.sparkContext.broadcast(common_keys(again, shingle, percent, hot, max(group + 1, KEY_LEAST, int(min(rows, KEY_SAMPLE) * KEY_SHARE))))
    staged = docs.mapInArrow(tidy(_sketch(parts, shingle, percent, hot, hot_keys)), STAGE)
    dealt = staged.repartition(width, F.coalesce("part", F.pmod(F.hash("doc_id", "h"), F.lit(parts))))
    found = cut(dealt.sortWithinPartitions("part").mapInArrow(tidy(_meet(group, hot_keys)), FOUND), "met")
    nodes = found.where(f"kind = {DOC}").select("doc_id", "h", "node", "n")
    members = found.where(f"kind = {MEMBER}").select("key", "node")
    large = members.select("node").distinct()
    n_docs, n_members = found.where(f"kind = {DOC}").count(), members.count()
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.col("h"))).alias("row")
    prints = found.where(f"kind = {DOC}").groupBy("node").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"), row)
    prints = cut(prints.select("node", "n", "sketch", F.col("row.d").alias("__d"), F.col("row.h").alias("h")), "sketches", 8 * n_docs)  # rows of some hundred bytes

    def sifted(pairs: DataFrame) -> DataFrame:
        left = prints.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
        right = prints.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
        near = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        return near.select("a", "b", "na", "nb", "x", "y").mapInArrow(tidy(_sift(percent)), "a long, b long")

    pairs = cut(sifted(found.where(f"kind = {PAIR}").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()), "pairs")
    n_pairs = pairs.count()
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("node")).distinct()
    chosen = cut(prints.join(wanted, "node", "left_semi").select("__d", "h").distinct(), "chosen", min(n_docs, 2 * n_pairs + n_members))
    few = broadcast_if_small(chosen, chosen.count(), BROADCAST_ROWS)
    keyed = docs.withColumn("__d", F.coalesce("doc_id", F.lit(-(2**63))))
    sets = keyed.join(few, ["__d", "h"], "left_semi").select("text").mapInArrow(tidy(_sets(shingle)), "node long, items array<long>")
    sets = cut(sets.withColumn("row", F.monotonically_increasing_id()), "sets")
    if sets.select("node").distinct().count() < sets.count():
        sets = sets.join(sets.groupBy("node").agg(F.min("row").alias("row")).select("row"), "row", "left_semi")

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
        both = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("x", "y")))
        return both.where(F.col("i") * 100 >= (F.size("x") + F.size("y") - F.col("i")) * percent).select("a", "b")

    links = cut(verified(pairs), "links", n_pairs)
    n_links = links.count()
    comps = components(links, n_links)
    if n_members:
        # Large groups whose members are not all in one component yet: only links from outside the group's
        # main component can change anything, so what is outside is compared with the whole group, once.
        named = cut(members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "named", n_members)
        held = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
        live = held.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("m").alias("k"), F.max(F.struct("m", "comp")).alias("main"))
        live = live.where("comps > 1").select("key", F.ceil(F.col("k") / chunk).alias("rights"), F.ceil((F.col("k") - F.col("main.m")) / chunk).alias("lefts"), F.col("main.comp").alias("main"))
        live = cut(live, "live", n_members)
        n_live = live.count()
        if n_live:
            rows = named.join(broadcast_if_small(live, n_live, BROADCAST_ROWS), "key")
            # Cell (i, j): chunk i of what is outside against chunk j of all.
            outside = rows.where("comp <> main").withColumns({"left": F.lit(True), "i": F.pmod(F.xxhash64("node"), F.col("lefts")), "j": F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights") - 1))})
            all_ = rows.withColumns({"left": F.lit(False), "i": F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1)), "j": F.pmod(F.xxhash64("node"), F.col("rights"))})
            spread = outside.unionByName(all_).select("key", "i", "j", "left", "node", "comp").join(prints.select("node", "n", "sketch"), "node")
            new = spread.groupBy("key", "i", "j").applyInArrow(_compare(percent), "a long, b long")
            new = cut(sifted(new.distinct().join(pairs, ["a", "b"], "left_anti")), "new", n_members)
            more = cut(verified(new), "links", n_members)
            if more.limit(1).count():
                links = links.union(more)
                comps = components(links, n_links + more.count(), comps)

    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    if count and n_members:
        sized = comps.join(prints.select("node", "n"), "node")
        open_ = sized.join(large.withColumn("large", F.lit(1)), "node", "left").groupBy("comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("items"), F.count("large").alias("large"))
        open_ = open_.where("k > 2 and large > 1").select("comp", F.ceil(F.col("items") / counted).alias("c"))
        spread = comps.join(open_, "comp").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("c")))
        spread = spread.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))).withColumns({"i": F.least("chunk", "o"), "j": F.greatest("chunk", "o")})
        cells = spread.select("comp", "i", "j", "chunk", "node").join(sets.select("node", "items"), "node")
        whole = cells.groupBy("comp", "i", "j").applyInArrow(_count(percent), "node long, n long").groupBy("node").agg(F.sum("n").alias("whole"))
        whole = cut(whole, "counted", n_docs)
        degree = degree.join(whole, "node", "left").select("node", F.coalesce("whole", "n_links").alias("n_links"))
    # One row for each node, then for each row: neither copies nor a large component meet in one task.
    own = cut(nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("d")), "own", n_docs)
    least = cut(comps.join(own, "node").groupBy("comp").agg(F.min("d").alias("component_id")), "least", n_docs)
    placed = comps.join(broadcast_if_small(least, least.count(), BROADCAST_ROWS), "comp").select("node", "comp", "component_id", F.lit(True).alias("linked"))
    facts = own.join(placed, "node", "left").join(degree, "node", "left")
    facts = facts.select("node", F.coalesce("comp", "node").alias("comp"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("d")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = nodes.where("n > 0").join(cut(facts, "facts", n_docs), "node").select("doc_id", "h", "comp", F.col("n").alias("n_shingles"), "n_links", "component_id")
    return named.union(nodes.where("n = 0").select("doc_id", "h", "node", F.col("n"), F.lit(0).cast("long"), F.col("doc_id")))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """`docs` with one row of each group of linked texts, that with the least doc_id (null is largest).

    Texts without words are linked with nothing and all stay. Among rows of a group with the least doc_id
    the text's hash decides; of rows alike in both, one stays.
    """
    found = cut(classes(docs, **params, count=False).where("n_shingles > 0").select("doc_id", "h", "comp"), "classes", docs.count())
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("h"))
    kept = found.groupBy("comp").agg(F.min(order).alias("k")).select("comp", "k.doc_id", "k.h")
    mark = [F.coalesce("doc_id", F.lit(-(2**63))).alias("__d"), F.col("h").alias("__h")]
    same = found.groupBy("comp", "doc_id", "h").agg(F.count(F.lit(1)).alias("rows"))
    best = same.join(kept.select("comp", F.col("doc_id").alias("kd"), F.col("h").alias("kh")), "comp")
    best = cut(best.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("kd")) & (F.col("h") == F.col("kh"))), "best")
    gone = best.where("not stays").select(*mark).distinct()
    twice = best.where("stays and rows > 1").select(*mark).distinct()
    keyed = docs.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__h": F.xxhash64("text")})
    left = keyed.join(broadcast_if_small(gone, gone.count(), BROADCAST_ROWS), ["__d", "__h"], "left_anti")
    n = twice.count()
    if n:
        twice = broadcast_if_small(twice, n, BROADCAST_ROWS)
        left = left.join(twice, ["__d", "__h"], "left_anti").unionByName(left.join(twice, ["__d", "__h"], "left_semi").dropDuplicates(["__d", "__h"]))
    return left.select(*docs.columns)


#: The same in DuckDB, by comparing every two documents that share a shingle; for small tables.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {documents}),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
c AS (SELECT k, min(doc_id) AS node, any_value(n) AS n FROM n GROUP BY k),
t AS (SELECT c.node, s.g FROM c JOIN s ON s.doc_id = c.node),
p AS (SELECT a.node AS x, b.node AS y, count(*) AS i FROM t a JOIN t b ON a.g = b.g AND a.node <> b.node GROUP BY a.node, b.node),
l AS (SELECT x, y FROM p JOIN c cx ON cx.node = x JOIN c cy ON cy.node = y WHERE 100 * i >= 80 * (cx.n + cy.n - i)),
r(a, b) AS (SELECT node, node FROM c UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a),
e AS (SELECT x, count(*) AS links FROM l GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(e.links, 0) AS n_links, coalesce(m.least, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (k) LEFT JOIN m ON m.a = c.node LEFT JOIN e ON e.x = c.node
"""
