"""Token counts by a separator scan over flat token files without an index."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, chunks, cut, lean, list_array, one_array, open_fs, publish, shared_path, tidy

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text into pieces that are encoded one by one; a fixed value of the tokenizer's format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = 50256
BLOCK_TOKENS = 1 << 21

_encodings: dict[str, object] = {}


def encoding(path: str):
    """The byte-level BPE of a rank file, kept once for each process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def write_tokens(docs: DataFrame, folder: str, *, tokenizer: str = TOKENIZER, separator: int = SEPARATOR) -> DataFrame:
    """(file, ordinal, doc_id): every text's ids and the separator, end to end in one flat file a task.

    Files hold little-endian uint16, or uint32 where the separator needs it. A task writes under a name of
    its own and renames at the end, so a task that is run again replaces its file. Null texts are empty.
    """
    lean(docs.sparkSession)
    kind = np.dtype("<u2" if separator < 1 << 16 else "<u4")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.tok"
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        own, n = f"{path}/_{name}.{context.taskAttemptId()}", 0
        enc, end = encoding(tokenizer), np.array([separator], kind)
        with fs.open_output_stream(own) as out:
            for batch in batches:
                text = one_array(batch.column(1))
                for i, j in chunks(text):
                    ids = [x for t in text.slice(i, j - i).to_pylist() for x in (enc.encode_to_numpy(t, allowed_special=set(), disallowed_special=()).astype(kind), end)]
                    out.write(np.concatenate(ids).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(batch), pa.string()), pa.array(np.arange(n, n + len(batch))), batch.column(0)], names=["file", "ordinal", "doc_id"])
                n += len(batch)
        if n:
            publish(fs, own, f"{path}/{name}")
        else:
            fs.delete_file(own)

    return cut(rows.mapInArrow(tidy(run), "file string, ordinal long, doc_id long"), "written")


#: Tables of up to so many documents (some 15 MB) are broadcast to the counts, larger ones shuffled.
BROADCAST_ROWS = 100_000


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, size) of the token files in a folder."""
    from pyarrow import fs as afs

    fs, path = open_fs(folder)
    found = fs.get_file_info(afs.FileSelector(path, allow_not_found=True))
    return spark.createDataFrame([(x.base_name, x.size) for x in found if x.base_name.endswith(".tok")], "file string, size long")


def scan(spark: SparkSession, folder: str, *, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed): the documents of the flat token files in `folder`.

    Blocks are cut without regard to documents, each is searched for the separator as one array, and the
    documents' numbers and borders across blocks follow from a running sum and a running maximum over the
    blocks of a file. Ids after a file's last separator are a document that is not closed; an empty file
    has none. Bytes after the last whole id are not read.
    """
    kind = np.dtype("<u2" if separator < 1 << 16 else "<u4")
    files = token_files(spark, folder).withColumn("n", F.floor(F.col("size") / kind.itemsize))
    blocks = files.where("n > 0").select("file", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block_tokens).cast("long"))).alias("begin"))
    blocks = blocks.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("file", "begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        for batch in batches:
            for file, n, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stop = min(n, begin + block_tokens)
                with fs.open_input_file(f"{path}/{file}") as f:
                    ids = np.frombuffer(f.read_at((stop - begin) * kind.itemsize, begin * kind.itemsize), kind)
                at = np.flatnonzero(ids == separator) + begin
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n]), pa.array([begin]), list_array(at, np.array([len(at)]), pa.int64())], names=["file", "n", "begin", "ends"])

    found = blocks.mapInArrow(tidy(run), "file string, n long, begin long, ends array<long>")
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("first", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0))).withColumn("open", F.coalesce(F.max(F.array_max("ends")).over(before) + 1, F.lit(0)))
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("begin"))) == 1
    tail = F.coalesce(F.array_max("ends") + 1, F.col("open"))
    found = found.withColumn("all", F.when(last & (tail < F.col("n")), F.concat("ends", F.array("n"))).otherwise(F.col("ends")))
    each = found.select("file", "n", "first", "open", "ends", F.posexplode("all").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.expr("ends[k - 1]") + 1)
    return each.select("file", (F.col("first") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), (F.col("end") < F.col("n")).alias("closed"))


def token_counts(docs: DataFrame, *, tokenizer: str = TOKENIZER, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens), a row for each row of `docs`: its text is written to token files and counted there.

    Null and empty texts have no tokens. Rows without doc_id and repeated rows are counted each for itself,
    as files and places in them, not ids, tell the rows apart. An empty table gives an empty one; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    written = write_tokens(docs, folder, tokenizer=tokenizer, separator=separator)
    found = scan(spark, folder, separator=separator, block_tokens=block_tokens)
    return found.join(broadcast_if_small(written, written.count(), BROADCAST_ROWS), ["file", "ordinal"]).select("doc_id", "n_tokens")
