"""WARC archives: writing with deduplicated payloads, and reading by verified boundary chains."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, one_array, open_fs, publish, shared_path, tidy

MAGIC = b"WARC/1."
GZIP_MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
BLOCK_BYTES = 4 << 20
#: So many bytes after a block are read with it; a header that goes on is read to its end.
HEADER_BYTES = 1 << 16
MIN_BYTES = 0
#: Tables of up to so many repeated payloads (under 30 MB) are broadcast, larger ones shuffled.
BROADCAST_ROWS = 200_000
SALTS = 64
FIELDS = "record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; with `refers_to` a revisit, whose block holds the HTTP header alone."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]+", " ", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int, dict[bytes, bytes], int] | None:
    """Header end, fields and block length of a record that begins the data; None if none does."""
    if not data.startswith(MAGIC):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    return (end + 4, fields, int(length)) if length.isdigit() else None


def described(fields: dict[bytes, bytes], block: bytes) -> tuple:
    """The columns of FIELDS for a record; the payload is what follows the HTTP header of the block."""
    number = lambda name: x if re.fullmatch(rb"-?\d{1,19}", fields.get(name, b"")) and -(1 << 63) <= (x := int(fields[name])) < 1 << 63 else None
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    url = fields[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in fields else None
    if kind == "revisit":
        return kind, number(b"x-page-id"), url, number(b"x-payload-length"), fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:"), number(b"x-refers-to-page")
    at = block.find(b"\r\n\r\n")
    payload = block[at + 4 :] if block.startswith(b"HTTP/") and at >= 0 else block
    return kind, number(b"x-page-id"), url, len(payload), digest(payload), None


def write_archives(pages: DataFrame, folder: str, *, min_bytes: int = MIN_BYTES, compress: bool = True) -> DataFrame:
    """(file, records, bytes) of the archives written, one file a task.

    Of pages with equal payloads of `min_bytes` or more, that with the largest page_id is a response
    record, the others are revisits of it; rows that repeat the largest page_id are all responses, and so
    are pages without page_id where no page of the payload has one. A task writes under a name of its own
    and renames at the end.
    """
    lean(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    key = F.sha1(F.col("html").cast("binary"))
    seen = rows.where(F.octet_length("html") >= min_bytes).groupBy(key.alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last"))
    twice = cut(seen.where("n > 1").select("sha", "last"), "payloads")
    n_twice = twice.count()
    rows = rows.withColumn("sha", key)
    if n_twice <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(twice), "sha", "left")
    else:  # a payload of very many pages, such as an empty one, is dealt over SALTS tasks
        salted = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"], "left")
    last = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last"))
    joined = joined.select("page_id", "url", "html", last.alias("refers_to"))
    suffix = ".warc.gz" if compress else ".warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name, n, size = f"part-{context.partitionId():06d}{suffix}", 0, 0
        fs, path = open_fs(folder)
        fs.create_dir(path, recursive=True)
        own = f"{path}/_{name}.{context.taskAttemptId()}"
        with fs.open_output_stream(own) as out:
            for batch in batches:
                html = one_array(batch.column(2)).cast(pa.binary())
                for page, url, payload, refers in zip(batch.column(0), batch.column(1), html, batch.column(3), strict=True):
                    data = record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py())
                    if compress:
                        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                        data = packer.compress(data) + packer.flush()
                    out.write(data)
                    n, size = n + 1, size + len(data)
        if n:
            publish(fs, own, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], names=["file", "records", "bytes"])
        else:
            fs.delete_file(own)

    return cut(joined.mapInArrow(tidy(run), "file string, records long, bytes long"), "archives")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(file, size) of the archives in a folder."""
    from pyarrow import fs as afs

    fs, path = open_fs(folder)
    found = fs.get_file_info(afs.FileSelector(path, allow_not_found=True))
    return spark.createDataFrame([(x.base_name, x.size) for x in found if x.base_name.endswith((".warc", ".warc.gz"))], "file string, size long")


class _Bytes:
    """A block of a file, and what follows it as far as it is asked for."""

    def __init__(self, f, size: int, begin: int, stop: int):
        self.f, self.size, self.begin = f, size, begin
        self.data = f.read_at(min(stop + HEADER_BYTES, size) - begin, begin)
        self.searched = (0, -1)

    def upto(self, end: int) -> bytes:
        if end - self.begin > len(self.data) and self.begin + len(self.data) < self.size:
            at = self.begin + len(self.data)
            self.data += self.f.read_at(min(max(end - at, 1 << 20, len(self.data)), self.size - at), at)  # twice as much each time
        return self.data

    def blank_line(self, place: int) -> int:
        """Where the first blank line from there on begins, -1 if there is none; each stretch is searched once."""
        start, end = self.searched
        if not start <= place <= end:
            seek = place
            while (end := self.data.find(b"\r\n\r\n", seek)) < 0:
                have = len(self.data)
                if len(self.upto(self.begin + have + 1)) == have:
                    end = self.size + 1
                    break
                seek = max(place, have - 3)
            self.searched = (place, end)
        return end if end <= self.size else -1

    def plain(self, at: int) -> tuple[int, tuple] | None:
        end = self.blank_line(at - self.begin)
        found = parse(self.data[at - self.begin : end + 4]) if end >= 0 else None
        if not found or at + found[0] + found[2] + 4 > self.size:
            return None
        a, b = at + found[0] - self.begin, at + found[0] + found[2] - self.begin
        data = self.upto(self.begin + b + 4)
        if data[b : b + 4] != b"\r\n\r\n":
            return None
        return self.begin + b + 4, described(found[1], data[a:b])

    def packed(self, at: int) -> tuple[int, tuple] | None:
        unpack, out, place = zlib.decompressobj(31), [], at - self.begin
        try:
            while not unpack.eof:
                data = self.upto(self.begin + place + (1 << 16))
                piece = data[place : place + (1 << 16)]
                if not piece:
                    return None
                out.append(unpack.decompress(piece))
                place += len(piece)
        except zlib.error:
            return None
        place -= len(unpack.unused_data)
        data = b"".join(out)
        found = parse(data)
        return (self.begin + place, described(found[1], data[found[0] : found[0] + found[2]])) if found else None


def candidates(spark: SparkSession, folder: str, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, offset, next, exit, ...): whatever looks like a record, with its successor's offset.

    `exit` is where the chain from the record leaves its block: -1 if at a place that holds no candidate.
    """
    files = archives(spark, folder).where("size > 0")
    blocks = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_bytes).cast("long"))).alias("begin"))
    blocks = blocks.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("file", "begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_fs(folder)
        for batch in batches:
            for file, size, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gz, stop = file.endswith(".gz"), min(size, begin + block_bytes)
                found: list[tuple] = []
                with fs.open_input_file(f"{path}/{file}") as f:
                    held = _Bytes(f, size, begin, stop)
                    magic = GZIP_MAGIC if gz else MAGIC
                    at = held.data.find(magic)
                    while 0 <= at < stop - begin:
                        got = (held.packed if gz else held.plain)(begin + at)
                        if got:
                            found.append((begin + at, *got))
                        at = held.data.find(magic, at + 1)
                leave: dict[int, int] = {}
                for offset, successor, _ in reversed(found):
                    leave[offset] = successor if successor >= stop else leave.get(successor, -1)
                if found:
                    cols = list(zip(*(x[2] for x in found), strict=True))
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(found)), pa.array([begin] * len(found)), pa.array([x[0] for x in found]), pa.array([x[1] for x in found]), pa.array([leave[x[0]] for x in found]), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                        names=["file", "block", "offset", "next", "exit", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to"],
                    )

    return cut(blocks.mapInArrow(tidy(run), f"file string, block long, offset long, next long, exit long, {FIELDS}"), "candidates")


def read_archives(spark: SparkSession, folder: str, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, offset, record_type, page_id, url, payload_bytes, payload_digest, refers_to) of all records.

    Blocks are searched at once for anything that looks like a record. Within a block each candidate's
    chain of successors is followed to where it leaves; over blocks pointer jumping from each file's start
    doubles the chain every round. Only records on the chain from the start are kept, so a record inside a
    payload is none, and nothing after a damaged record is. Payload size and digest of responses are those
    of the bytes read.
    """
    found = candidates(spark, folder, block_bytes=block_bytes)
    jump = found.select("file", F.col("offset").alias("at"), F.col("exit").alias("to")).where("to > at")
    reach = found.select("file").distinct().withColumn("at", F.lit(0).cast("long"))
    n = -1
    while (count := (reach := cut(reach, "reached")).count()) > n:
        n = count
        reach = reach.union(reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct()
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = cut(jump.join(far, ["file", "to"], "left").select("file", "at", F.coalesce("far", "to").alias("to")), "jumps")
    entries = reach.select("file", F.col("at").alias("entry")).join(found.select("file", "block", F.col("offset").alias("entry")), ["file", "entry"])

    def walk(table: pa.Table) -> pa.Table:  # not in pandas, where integers with nulls become floats
        table = table.sort_by("offset")
        place = {x: k for k, x in enumerate(table["offset"].to_pylist())}
        successors, keep, at = table["next"].to_numpy(), np.zeros(len(table), bool), place.get(table["entry"][0].as_py())
        while at is not None:
            keep[at] = True
            at = place.get(successors[at])
        return table.select(["file", "offset", *FIELD_NAMES]).filter(pa.array(keep))

    return found.join(entries, ["file", "block"]).groupBy("file", "block").applyInArrow(walk, f"file string, offset long, {FIELDS}")


FIELD_NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def archive_pages(pages: DataFrame, *, min_bytes: int = MIN_BYTES, compress: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`pages` written as archives in the shared folder and read back, a row for each record.

    Null html is an empty payload; a null url leaves its field out, control characters in one become a
    space; rows without page_id have records too. A url or payload may have any length, a page_id be any
    bigint, and repeated rows have a record each. Equal payloads are told by their SHA-1. An error is raised
    if not all records are read again. An empty table gives no archive and no rows. Other columns are not
    looked at.
    """
    folder = shared_path(pages.sparkSession, "warc")
    written = write_archives(pages, folder, min_bytes=min_bytes, compress=compress).agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    got = cut(read_archives(pages.sparkSession, folder, block_bytes=block_bytes), "records")
    if (n := got.count()) != written:
        raise ValueError(f"{n} records read of {written} written")
    return got




#: The same in DuckDB, for min_bytes 0 and distinct page ids: 32 groups of five bits from the 40 hex digits.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '0' AS h FROM {pages}),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((((instr('0123456789abcdef', substr(h, 1 + 5 * i // 4, 1)) - 1) * 16
        + instr('0123456789abcdef', substr(h, 2 + 5 * i // 4, 1)) - 1) >> (3 - i % 4)::INT) & 31))::INT, 1)), '') AS payload_digest
FROM q
"""
