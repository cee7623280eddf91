"""Flush windows: when a batcher closes a batch, over stored rows and over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from ..sources.store import Store

MAX_BYTES = 4 << 20
MAX_AGE_US = 500_000


def flush_batches(requests: DataFrame, *, max_bytes: int = MAX_BYTES, max_age_us: int | None = MAX_AGE_US) -> DataFrame:
    """(instance, ordinal, batch): the batch, from 1, that each request of a batcher instance falls in.

    `requests` has instance, ordinal, ts_us and bytes. A batch closes when a request brings it to
    `max_bytes` (requests are not split), or `max_age_us` after its first request: one that comes at that
    time or later opens the next. Instances run side by side; each is a sorted stream of rows through one
    task, which holds a batch of rows and three numbers.
    """
    kind = requests.schema["instance"].dataType.simpleString()
    rows = requests.select("instance", F.col("ordinal").cast("long").alias("ordinal"), F.col("ts_us").cast("long").alias("ts_us"), F.col("bytes").cast("long").alias("bytes"))
    rows = rows.repartition("instance").sortWithinPartitions("instance", "ordinal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        instance, batch, size, opened = object(), 0, 0, None
        for rows in batches:
            out = []
            for who, ts, n in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                if who != instance:
                    instance, batch, opened = who, 0, None
                if opened is None or max_age_us is not None and ts >= opened + max_age_us:
                    batch, size, opened = batch + 1, 0, ts
                size += n
                out.append(batch)
                if size >= max_bytes:
                    opened = None
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.int64())], names=["instance", "ordinal", "batch"])

    return rows.mapInArrow(run, f"instance {kind}, ordinal long, batch long")


def bounded(reader: DataStreamReader, *, files: int | None = None, max_bytes: int | None = MAX_BYTES) -> DataStreamReader:
    """A file stream whose micro-batches are bounded: what comes faster than it is written waits in the source."""
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    elif max_bytes is not None:  # Spark takes one of the two
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader


def stream_to_store(mutations: DataFrame, store: Store, checkpoint: str, *, trigger: dict | None = None, compact_at: int | None = None) -> StreamingQuery:
    """Writes each micro-batch of a stream of (key, put, delete, ordinal) as one log.

    The trigger's interval is the age limit, the source's rate options (such as maxFilesPerTrigger) bound
    the size. An empty micro-batch writes nothing. The manifest notes the last batch of each stream, known by
    its checkpoint, in the commit that lists the log: one that is delivered again after a failure is left
    out. `compact_at` compacts when so many logs are new. Many streams may write into one store.
    """

    def flush(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            store.write(batch, once=(checkpoint, number))
            if compact_at:
                store.maybe_compact(compact_at)

    return mutations.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()
