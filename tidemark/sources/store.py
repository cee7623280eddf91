"""A store of versioned keys: durable batches, newest-wins reads, compaction."""

from __future__ import annotations

import time
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup, merge, routing
from ..schema import NEW, RECORD, invalid_writes, records
from .location import resolve
from .manifest import File, Manifest, Refused, State

MIN_WALS = 16
#: A record's place among all records of its key.
ORDER = ["seq", "pos"]
#: Up to so many requested keys are named in the scan, where row groups and Bloom filters can skip them.
NAMED_KEYS = 1000
#: Bytes of records that a file of a run holds, about.
RUN_FILE_BYTES = 256 << 20
#: Seconds after which a compaction that has not finished counts as dead.
LEASE_S = 3600.0
#: Seconds for which data that nothing refers to stays, as a writer may be about to list it.
UNLISTED_S = 24 * 3600.0
DATA = "key string, value binary, tombstone boolean, seq long, pos long"


class InvalidWrite(ValueError):
    """The request is refused as a whole."""


class InvalidLookup(ValueError):
    """The request names no file or no keys."""


class View:
    """The records of one version, kept by Spark; `close` gives them up."""

    def __init__(self, records: DataFrame):
        self.records = records

    def live(self) -> DataFrame:
        return merge.live(self.records, ORDER).select("key", "value")

    def batch_get(self, keys: DataFrame) -> DataFrame:
        return lookup.batch_get(self.records, keys, ORDER)

    def close(self) -> None:
        self.records.unpersist()


class Store:
    """Data files are Parquet, sorted by key: key, value, tombstone, seq and pos. `seq` is null in a fresh
    file, whose number is given at its commit, and kept for each record in compacted ones, so that a merge
    never depends on the order in which compactions finish. A log is one folder, whose name is a partition
    value of the scan; the files of a run have key ranges that don't overlap."""

    def __init__(self, spark: SparkSession, url: str):
        self.spark = spark
        self.root, settings = resolve(url)
        for k, v in settings.items():
            spark.sparkContext._jsc.hadoopConfiguration().set(k, v)
        # Lists of keys reach the scan as they are, not as their least and greatest.
        if int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold")) < NAMED_KEYS:
            spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(NAMED_KEYS))
        self.manifest = Manifest(spark, f"{self.root}/_manifest")

    # Writing.
    def _save(self, rows: DataFrame, kind: str) -> tuple[str, dict]:
        """Writes one immutable file set; its key range and size come back from the written rows."""
        path = f"{self.root}/data/{kind}/id=f{uuid.uuid4().hex}"
        rows.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)
        stats = merge.batch_stats(self.spark.read.schema(DATA).parquet(path).withColumn("all", F.lit(1)), ["all"]).first()
        return path, {} if stats is None else {"min_key": stats["min_key"], "max_key": stats["max_key"], "size_bytes": stats["size_bytes"]}

    def write(self, mutations: DataFrame, *, once: tuple[str, int] | None = None) -> int | None:
        """Makes a batch of (key, put, delete, ordinal) durable and visible; returns its sequence number.

        The last change of a key by ordinal counts. Data first, then the manifest: a failure in between
        leaves data that nothing refers to. `once` names a stream and its batch: a batch that is not above
        the stream's last one has been written already and is left out, and None returned.
        """
        if once and self.manifest.state().done.get(once[0], -1) >= once[1]:
            return None
        if invalid_writes(mutations).limit(1).count():
            raise InvalidWrite("a key is empty")
        rows = merge.newest_wins(records(mutations, "ordinal"), ["ordinal"]).select("key", "value", "tombstone", F.lit(None).cast("long").alias("seq"), F.lit(0).cast("long").alias("pos"))
        path, stats = self._save(rows, "wal")
        if not stats:
            raise InvalidWrite("no writes")

        def listed(s: State) -> State:
            if once and s.done.get(once[0], -1) >= once[1]:
                return s
            new = s.added("wal", path, **stats)
            return new.noted(*once) if once else new

        done = self.manifest.commit(listed)
        return next((f.seq_no for f in reversed(done.tier("wal")) if f.path == path), None)

    # Reading.
    def _scan(self, files: list[File]) -> DataFrame:
        """Records of the files with their sequence numbers: one scan of the logs, one of compacted files."""
        logs, rest = [f for f in files if f.tier == "wal"], [f for f in files if f.tier != "wal"]
        out = []
        if rest:
            out.append(self.spark.read.schema(DATA).parquet(*(f.path for f in rest)))
        if logs:
            rows = self.spark.read.schema(f"{DATA}, id string").option("basePath", f"{self.root}/data/wal").parquet(*(f.path for f in logs))
            numbers = self.spark.createDataFrame([(f.path.rsplit("=", 1)[1], f.source_seq) for f in logs], "id string, file_seq long")
            # A row of some 50 bytes for each log; the manifest on the driver holds more for each.
            rows = rows.join(F.broadcast(numbers), "id")
            out.append(rows.select("key", "value", "tombstone", F.coalesce("seq", "file_seq").alias("seq"), "pos"))
        if not out:
            return self.spark.createDataFrame([], RECORD).withColumns({"seq": F.lit(0).cast("long"), "pos": F.lit(0).cast("long")})
        return merge.concat(out)

    def all_records(self, version: int | None = None) -> DataFrame:
        return self._scan(list(self.manifest.state(version).files.values()))

    def live(self, version: int | None = None) -> DataFrame:
        """(key, value) of every visible key, as of a manifest version."""
        return merge.live(self.all_records(version), ORDER).select("key", "value")

    def requested(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The records that a lookup of these keys has to look at.

        Only files whose range holds one of the keys are read. Few keys are taken to the driver, and the scan
        names them; of many, the least and greatest choose row groups.
        """
        wanted = lookup.key_set(keys)
        some = sorted((r["key"] for r in wanted.limit(NAMED_KEYS + 1).collect()), key=str.encode)
        files = list(self.manifest.state(version).files.values())
        if len(some) <= NAMED_KEYS:
            coded = [k.encode() for k in some]

            def holds(f: File) -> bool:
                at = bisect_left(coded, (f.min_key or "").encode())
                return at < len(coded) and (f.max_key is None or coded[at] <= f.max_key.encode())

            return self._scan([f for f in files if holds(f)]).where(F.col("key").isin(some) if some else F.lit(False))
        low, high = wanted.agg(F.min("key"), F.max("key")).first()
        held = self._hit(wanted, [(f.min_key, f.max_key) for f in files])
        return self._scan([files[k] for k in held]).where((F.col("key") >= low) & (F.col("key") <= high))

    def _hit(self, keys: DataFrame, spans: list[tuple[str | None, str | None]]) -> list[int]:
        """The places of the key ranges that hold one of the keys; each task bisects its own sorted keys."""
        sent = self.spark.sparkContext.broadcast([(a and a.encode(), b and b.encode()) for a, b in spans])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            left = dict(enumerate(sent.value))
            for batch in batches:
                coded = sorted(k.encode() for k in batch.column(0).to_pylist())
                found = []
                for k, (low, high) in left.items():
                    at = bisect_left(coded, low or b"")
                    if at < len(coded) and (high is None or coded[at] <= high):
                        found.append(k)
                for k in found:
                    del left[k]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["k"])

        return sorted(r["k"] for r in keys.mapInArrow(run, "k long").distinct().collect())

    def batch_get(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """(key, value) of the requested keys that are visible."""
        return lookup.batch_get(self.requested(keys, version), keys, ORDER)

    def view(self, version: int | None = None, *, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> View:
        """One version, read through Spark's cache: its files are read once, and later reads are served even
        if they are gone meanwhile."""
        return View(self.all_records(version).persist(level))

    def file_lookup(self, path: str, keys: DataFrame) -> DataFrame:
        """(key, outcome, value) of the keys in one listed or unlisted file set; an empty path or key set is refused."""
        if not path:
            raise InvalidLookup("object path is empty")
        if not lookup.key_set(keys).limit(1).count():
            raise InvalidLookup("no keys")
        return lookup.file_lookup(self.spark.read.schema(DATA).parquet(path), keys, ["pos"])

    def list_wals(self) -> DataFrame:
        """(seq_no, attributes) of all logs in order."""
        return self.manifest.files().where("tier = 'wal'").select("seq_no", "path", "created_at", "size_bytes", "min_key", "max_key").orderBy("seq_no")

    # Compaction.
    def recover(self, lease_s: float = LEASE_S) -> list[int]:
        """Logs that a compaction reserved longer ago than the lease are new again, for another to take."""
        freed: list[int] = []

        def free(s: State) -> State:
            freed[:] = s.overdue(lease_s)
            return s.released(freed) if freed else s

        self.manifest.commit(free)
        return freed

    def maybe_compact(self, min_wals: int = MIN_WALS, *, lease_s: float = LEASE_S) -> int | None:
        """Compacts all new logs if there are enough, those of dead compactions included; returns the run's number."""
        self.recover(lease_s)
        fresh = [f.seq_no for f in self.manifest.state().tier("wal") if f.state == NEW]
        return self.compact(fresh) if len(fresh) >= min_wals else None

    def _merged(self, files: list[File], drop_tombstones: bool) -> DataFrame:
        """The newest record of each key, dealt by ranges of the key: one exchange serves merge and order."""
        parts = max(1, -(-sum(f.size_bytes or 0 for f in files) // RUN_FILE_BYTES))
        merged = merge.newest_wins(self._scan(files).repartitionByRange(parts, "key"), ORDER)
        return merged.where("not tombstone") if drop_tombstones else merged

    def compact(self, ids: list[int], *, drop_tombstones: bool = False) -> int:
        """Merges logs into a run: reserve them, write the run, then list it and drop them in one commit.

        Tombstones stay, as older runs may hold their keys; `drop_tombstones` is for a merge of everything.
        Reserving or dropping is refused, and nothing changes, unless all logs are in the right state. A
        failure in between leaves the logs reserved, and readable, until `recover` frees them.
        """
        reserved = self.manifest.commit(lambda s: s.marked(ids))
        files = reserved.named("wal", ids, "COMPACTING")
        path, stats = self._save(self._merged(files, drop_tombstones), "run")
        newest = max(f.source_seq for f in files)

        def finish(s: State) -> State:
            return s.removed("wal", ids, "COMPACTING").added("shared_run", path, source_seq=newest, **stats)

        return self.manifest.commit(finish).next_seq["shared_run"] - 1

    def to_partitions(self, ids: list[int] | None = None) -> list[int]:
        """Moves shared runs (all, if none are named) into the partition tier: they are merged once, routed by
        the start keys, and become one newer run of each partition that has any of their keys."""
        state = self.manifest.state()
        ids = [f.seq_no for f in state.tier("shared_run")] if ids is None else ids
        files = state.named("shared_run", ids, None)
        routed = routing.route(self._merged(files, False), self.spark.createDataFrame([(x,) for x in state.starts], "start_key string"), strict=True)
        at = f"{self.root}/data/partition/f{uuid.uuid4().hex}"
        place = {x: k for k, x in enumerate(state.starts)}
        names = self.spark.createDataFrame(list(place.items()), "start_key string, part int")
        # Starts are on the driver already, in the manifest.
        parted = routed.join(F.broadcast(names), "start_key").drop("start_key")
        parted.sortWithinPartitions("part", "key").write.partitionBy("part").option("parquet.bloom.filter.enabled#key", "true").parquet(at)
        stats = {r["part"]: r for r in merge.batch_stats(self.spark.read.schema(f"{DATA}, part int").parquet(at), ["part"]).collect()}
        newest = max(f.source_seq for f in files)

        def listed(s: State) -> State:
            if s.starts != state.starts:
                raise Refused("partitions have changed meanwhile")
            new = s.removed("shared_run", ids, None)
            for start, k in place.items():
                if k in stats:
                    r, pos = stats[k], sum(f.start_key == start for f in s.tier("partition"))
                    new = new.added("partition", f"{at}/part={k}", source_seq=newest, start_key=start, run_pos=pos, min_key=r["min_key"], max_key=r["max_key"], size_bytes=r["size_bytes"])
            return new

        before = state.next_seq.get("partition", 1)
        return [f.seq_no for f in self.manifest.commit(listed).tier("partition") if f.seq_no >= before]

    def partitions(self, version: int | None = None) -> DataFrame:
        """(start_key, runs) of all partitions; runs by place, a later one is newer."""
        state = self.manifest.state(version)
        own = {x: [] for x in state.starts}
        for f in sorted(state.tier("partition"), key=lambda f: f.run_pos or 0):
            own.setdefault(f.start_key, []).append(f.path)
        return self.spark.createDataFrame(list(own.items()), "start_key string, runs array<string>")

    def delete_runs(self, ids: list[int]) -> None:
        """Drops runs from the list, if all of them are there; data files stay until `vacuum`."""
        self.manifest.commit(lambda s: s.removed("shared_run", ids, None))

    def vacuum(self, *, keep_versions: int = 100, unlisted_s: float = UNLISTED_S) -> list[str]:
        """Deletes old versions of the manifest, and data that no version refers to and that is older than
        `unlisted_s`; returns the paths deleted. A read of a version that is gone fails."""
        names = lambda p: "/".join(p.split("/data/", 1)[1].split("/")[:2])
        kept = {names(f.path) for s in self.manifest.expire(keep_versions) for f in s.files.values()}
        fs, path, gone = self.manifest.fs, self.manifest.jvm.org.apache.hadoop.fs.Path, []
        now = self.manifest.jvm.java.lang.System.currentTimeMillis()
        for kind in ("wal", "run", "partition"):
            top = path(f"{self.root}/data/{kind}")
            for x in fs.listStatus(top) if fs.exists(top) else ():
                at = f"{kind}/{x.getPath().getName()}"
                if at not in kept and now - x.getModificationTime() >= unlisted_s * 1000:
                    fs.delete(x.getPath(), True)
                    gone.append(f"{self.root}/data/{at}")
        return gone

    def wait(self, version: int, *, timeout_s: float = 60.0, poll_s: float = 0.1) -> int:
        """Waits until there is a version after this one, at most so long; returns the newest."""
        end = time.monotonic() + timeout_s
        while (now := self.manifest.state().version) <= version and time.monotonic() < end:
            time.sleep(poll_s)
        return now

    def changes_since(self, version: int) -> list[int]:
        """The versions after this one: a reader that polls it sees every change once."""
        return [v for v in self.manifest._versions() if v > version]
