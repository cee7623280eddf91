"""Sorted record files: codec, Spark data source, and whole-file scan.

A file is the version as a varint, then for each record a varint of twice the key's length, plus one for a
tombstone, the key, and for other records a varint of the value's length and the value.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.varint import VERSION, decode, encode
from .location import open_fs

Row = tuple[str, bytes | None, bool]
#: Bytes that a task holds before it writes them.
WRITE_BYTES = 4 << 20
PERMISSIVE, FAILFAST = "PERMISSIVE", "FAILFAST"


class CorruptFile(ValueError):
    """Bytes that are no complete record file."""


def encoded(records: Iterable[Row]) -> Iterator[bytes]:
    """The file's bytes, piece by piece; records stay as they come, repeated keys too."""
    yield encode(VERSION)
    for key, value, tombstone in records:
        name = key.encode()
        out = [encode(len(name) << 1 | bool(tombstone)), name]
        if not tombstone:
            body = value or b""
            out += [encode(len(body)), body]
        yield b"".join(out)


def encode_records(records: Iterable[Row]) -> bytes:
    return b"".join(encoded(records))


def decode_records(data: bytes, mode: str = PERMISSIVE) -> Iterator[Row]:
    """The records, one after the other. Where bytes are missing, a key is no UTF-8 or the version is unknown,
    PERMISSIVE ends with the records so far and FAILFAST raises CorruptFile."""

    def stop(why: str) -> None:
        if mode == FAILFAST:
            raise CorruptFile(why)

    head = decode(data, 0)
    if head is None:
        return stop("no version")
    version, at = head
    if version != VERSION:
        return stop(f"version {version}")
    while at < len(data):
        got = decode(data, at)
        if got is None:
            return stop("key length")
        size, at = got
        size, tombstone = size >> 1, bool(size & 1)
        if at + size > len(data):
            return stop("key")
        try:
            key, at = data[at : at + size].decode(), at + size
        except UnicodeDecodeError:
            return stop("key is no UTF-8")
        value = None
        if not tombstone:
            got = decode(data, at)
            if got is None:
                return stop("value length")
            size, at = got
            if at + size > len(data):
                return stop("value")
            value, at = bytes(data[at : at + size]), at + size
        yield key, value, tombstone


SCHEMA = "key string, value binary, tombstone boolean, pos long, path string"
_ARROW = pa.schema([("key", pa.string()), ("value", pa.binary()), ("tombstone", pa.bool_()), ("pos", pa.int64()), ("path", pa.string())])


def _batches(path: str, data: bytes, mode: str, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for pos, r in enumerate(decode_records(data, mode)):
        held.append((*r, pos, path))
        if len(held) == rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
            held.clear()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)


def read_files(spark: SparkSession, paths: str | list[str], mode: str = PERMISSIVE) -> DataFrame:
    """Records of all files under the paths, on any file system that Spark reads; a file is one task's."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from _batches(path.as_py(), content.as_py(), mode)

    return files.mapInArrow(run, SCHEMA)


class SSTableSource(DataSource):
    """spark.read.format("sstable").load(folder), and df.write.format("sstable").save(folder).

    Options: path, a folder or file on any file system that pyarrow opens; mode, PERMISSIVE or FAILFAST.
    Each task of a write makes one file, which appears when the whole write has succeeded.
    """

    @classmethod
    def name(cls) -> str:
        return "sstable"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SSTableReader:
        return SSTableReader(self.options)

    def writer(self, schema, overwrite: bool) -> SSTableWriter:
        return SSTableWriter(self.options, schema.fieldNames(), overwrite)


class SSTableReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.mode = options["path"], options.get("mode", PERMISSIVE).upper()

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector

        fs, path = open_fs(self.path)
        if fs.get_file_info(path).is_file:
            return [InputPartition(path)]
        return [InputPartition(x.path) for x in sorted(fs.get_file_info(FileSelector(path)), key=lambda x: x.path) if x.path.endswith(".sstable")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, _ = open_fs(self.path)
        with fs.open_input_file(partition.value) as f:
            yield from _batches(partition.value, f.read(), self.mode)


class SSTableWriter(DataSourceWriter):
    def __init__(self, options, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = options["path"], names, overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, path = open_fs(self.path)
        fs.create_dir(path, recursive=True)
        k, v, t = (self.names.index(c) for c in ("key", "value", "tombstone"))
        own = f"{path}/_{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(own) as f:
            held: list[bytes] = []
            size = 0
            for piece in encoded((r[k], None if r[v] is None else bytes(r[v]), r[t]) for r in rows):
                held.append(piece)
                size += len(piece)
                if size >= WRITE_BYTES:
                    f.write(b"".join(held))
                    held, size = [], 0
            f.write(b"".join(held))
        message = WriterCommitMessage()
        message.file = own  # type: ignore[attr-defined]
        return message

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileSelector

        fs, path = open_fs(self.path)
        old = [x.path for x in fs.get_file_info(FileSelector(path)) if x.path.endswith(".sstable")] if self.overwrite else []
        for m in messages:  # the new files first: a failure leaves old and new ones, never neither
            if m is not None:
                fs.move(m.file, f"{path}/{m.file.rsplit('/', 1)[1].removeprefix('_').removesuffix('.tmp')}.sstable")
        for x in old:
            fs.delete_file(x)

    def abort(self, messages: list) -> None:
        fs, _ = open_fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.file)
