"""Shared parts of the training-data operators.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D of the UTF-8 text, with A to Z
lower-cased. They are found and hashed for a whole batch of texts at once, on the Arrow buffer.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import ship
from ..scratch import cut as cut
from ..scratch import drop as drop
from ..scratch import shared_path as shared_path
from ..sources.location import open_fs as open_fs

U64 = np.uint64
#: Bytes of text that are held as numpy arrays at once; a longer text is still taken whole.
CHUNK_BYTES = 1 << 19
#: An odd multiplier for polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E6C63D0876A9A47 | 1
INVERSE = pow(BASE, -1, 1 << 64)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=U64)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array that hold about `limit` bytes each (one row at least)."""
    ends = text_offsets(column)[1:]
    i, n = 0, len(column)
    base = int(text_offsets(column)[0]) if n else 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield i, j
        base, i = int(ends[j - 1]), j


def text_offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, kind)
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, one after the other, and the row borders; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    at = text_offsets(column).astype(np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


class Words:
    """The words of a run of texts: start, end (byte positions), hash, and each text's first word."""

    def __init__(self, raw: np.ndarray, borders: np.ndarray, lower: np.ndarray | None = LOWER):
        word = ~SEPARATOR[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[borders] = True
        before = np.empty_like(word)
        after = np.empty_like(word)
        if len(raw):
            before[0] = after[-1] = False
            before[1:] = word[:-1]
            after[:-1] = word[1:]
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, borders)
        value = (raw if lower is None else lower[raw]).astype(U64) + U64(1)
        with np.errstate(over="ignore"):
            value *= powers(BASE, len(raw))
            total = np.zeros(len(raw) + 1, U64)
            np.cumsum(value, dtype=U64, out=total[1:])
            h = (total[self.end] - total[self.start]) * powers(INVERSE, len(raw) + 1)[self.start]
        self.hash = mix(h)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def word_hash(word: str) -> int:
    """The hash that Words gives this word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Words(raw, np.array([0, len(raw)])).hash[0])


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive values that begin at each position that has them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, k, U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * U64(BASE) + h[j : j + n]
    return mix(out)


def shingle_sets(words: Words, k: int = 5) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles, as sorted hashes; a shorter text is one shingle."""
    grams = gram_hashes(words.hash, k)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        else:
            yield gram_hashes(words.hash[a:b], int(b - a)) if b > a else np.zeros(0, U64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast where the counted rows stay under the limit; else a join by shuffle, whatever Spark guesses
    from the size of files, which it can split where keys are hot."""
    return F.broadcast(df) if rows <= limit else df.hint("merge")


#: Rows of a batch that goes to Python; with long texts the session's 10,000 take much memory on both sides.
BATCH_ROWS = 2_000


def lean(spark: SparkSession) -> SparkSession:
    """Limits the session's Arrow batches to BATCH_ROWS, and sees that the executors have this package."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that gives unused memory back to the system when a partition is done, as Python
    processes stay for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def held_out(doc_id: F.Column, parts: int, part: int) -> F.Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of a row group of the files that tasks write themselves.
GROUP_BYTES = 1 << 23


def cut_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, name: str) -> DataFrame:
    """`cut` of `df.mapInArrow(tidy(f), schema)`; in a local folder the Python tasks write their files themselves.

    Hadoop's local file system starts a process for the permissions of each file, which for a moment
    seems to count the whole memory of the executor's JVM a second time. Other stores are left to Spark's writer. A file gets
    its name when it is whole, the same one in each attempt of a task.
    """
    spark = df.sparkSession
    made = df.mapInArrow(tidy(f), schema)
    at = shared_path(spark, name)
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    if not (at if ":" in at.split("/")[0] else default).startswith("file:"):
        return cut(made, name)
    to, kind = at, to_arrow_schema(made.schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(to)
        own, writer, held, size, rows = f"{folder}/_{uuid.uuid4().hex}", None, [], 0, 0
        try:
            for batch in f(batches):
                if not len(batch):
                    continue
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    writer = pq.ParquetWriter(own, kind, filesystem=fs, compression="snappy")
                held.append(pa.RecordBatch.from_arrays([batch.column(x.name).cast(x.type) for x in kind], schema=kind))
                size, rows = size + batch.nbytes, rows + len(batch)
                if size >= GROUP_BYTES:
                    writer.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
            if held:
                writer.write_table(pa.Table.from_batches(held))
        finally:
            if writer is not None:
                writer.close()
        if writer is not None:
            publish(fs, own, f"{folder}/part-{TaskContext.get().partitionId():05d}.parquet")
            yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    if not df.mapInArrow(tidy(write), "rows long").toArrow().num_rows:
        return spark.createDataFrame([], made.schema)
    out = spark.read.schema(made.schema).parquet(at)
    out._tidemark_at = at  # type: ignore[attr-defined]
    return out


def publish(fs, own: str, final: str) -> None:
    """Gives a finished file its name; a file that an earlier attempt of the task left there goes."""
    if fs.get_file_info(final).is_file:
        fs.delete_file(final)
    fs.move(own, final)
