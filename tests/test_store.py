"""Stores, manifests and guarded changes."""

import os
import random
import re
import shutil
import subprocess
import sys
import threading
import time
from dataclasses import replace
from pathlib import Path

import pytest
import tidemark
from pyspark.sql import functions as F
from tidemark.sources import store as store_module
from tidemark.sources.manifest import Conflict, Manifest, Refused
from tidemark.sources.store import InvalidLookup, InvalidWrite, Store
from tidemark.streaming.changes import ManifestChanges
from tidemark.sources.location import resolve
from tidemark.streaming.flush import bounded, flush_batches, stream_to_store


def writes(spark, rows):
    """Rows of (key, value) with None for a delete."""
    data = [(k, None if v is None else v.encode(), v is None, n) for n, (k, v) in enumerate(rows)]
    return spark.createDataFrame(data, "key string, put binary, delete boolean, ordinal long")


def seen(df):
    return {r["key"]: bytes(r["value"]).decode() for r in df.collect()}


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_states_of_logs(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    assert m.state().version == 0 and m.state().starts == ("",)
    m.commit(lambda s: s.added("wal", "a").added("wal", "b"))
    with pytest.raises(Refused):
        m.commit(lambda s: s.marked([1, 2, 3]))
    m.commit(lambda s: s.marked([1]))
    for ids in ([1, 2], [], [1, 1]):
        with pytest.raises(Refused):
            m.commit(lambda s, ids=ids: s.removed("wal", ids, "COMPACTING"))
    m.commit(lambda s: s.removed("wal", [1], "COMPACTING"))
    assert [(f.seq_no, f.state) for f in m.state().tier("wal")] == [(2, "NEW")]
    assert m.state(1).version == 1 and len(m.state(1).files) == 2
    assert m.files().count() == 1


@pytest.mark.parametrize("writers", [4, 16])
def test_many_versions_and_writers(spark, tmp_path, writers):
    """Writers that share a manifest, and writers with one each."""
    shared = Manifest(spark, f"file://{tmp_path}/m")
    own = [shared if k % 2 else Manifest(spark, f"file://{tmp_path}/m") for k in range(writers)]
    threads = [threading.Thread(target=lambda m=m: [m.commit(lambda s: s.added("wal", "x")) for _ in range(6)]) for m in own]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for m in (*own, Manifest(spark, f"file://{tmp_path}/m")):
        s = m.state()
        assert s.version == 6 * writers and [f.seq_no for f in s.tier("wal")] == list(range(1, 6 * writers + 1))


WRITER = """
import sys
from pyspark.sql import SparkSession
from tidemark.sources.manifest import Manifest
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
m = Manifest(spark, sys.argv[1])
for _ in range(10):
    m.commit(lambda s: s.added("wal", "x"))
"""


def test_writers_of_two_processes(spark, tmp_path):
    """No turns are taken between processes: the file system alone decides."""
    (tmp_path / "w.py").write_text(WRITER)
    m = Manifest(spark, f"file://{tmp_path}/m")
    other = subprocess.Popen([sys.executable, str(tmp_path / "w.py"), m.folder], env={**os.environ, "PYTHONPATH": str(Path(tidemark.__file__).parents[1])}, stderr=subprocess.DEVNULL)
    while m.state().version == 0 and other.poll() is None:
        time.sleep(0.01)
    mine = 40
    for _ in range(mine):
        m.commit(lambda s: s.added("wal", "x"))
    assert other.wait(60) == 0
    s = m.state()
    assert s.version == mine + 10 and [f.seq_no for f in s.tier("wal")] == list(range(1, mine + 11))


def test_a_version_is_put_in_place_once(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/with space/m")
    m._put(1, {"put": [], "gone": [], "starts": [""], "next_seq": {}})
    with pytest.raises(Conflict):
        m._put(1, {})
    with pytest.raises(Conflict):
        m.commit(lambda s: replace(s, version=0).added("wal", "x") if m._put(m.state().version + 1, {"put": [], "gone": [], "starts": [""], "next_seq": {}}) is None else s, deadline_s=0)
    with pytest.raises(ValueError, match="empty"):
        m.commit(lambda s: s.added("wal", ""))


def test_lookups_read_only_what_they_need(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    for name in "abc":
        store.write(writes(spark, [(f"{name}{k:03d}", name) for k in range(0, 300, 2)]))
    got = store.batch_get(keys(spark, "a000", "c298", "b001"))
    assert seen(got) == {"a000": "a", "c298": "c"}
    assert {f.rsplit("/", 2)[1] for f in store.requested(keys(spark, "a000", "c298")).inputFiles()} == {f.path.rsplit("/", 1)[1] for f in store.manifest.state().tier("wal") if f.min_key[0] in "ac"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: [^\n]*In\(key, \[a000,b001,c298\]\)", plan)
    many = keys(spark, *(f"b{k:04d}" for k in range(2000)))
    assert store.batch_get(many).count() == 0 and seen(store.batch_get(many.union(keys(spark, "b298")))) == {"b298": "b"}
    logs = {f.min_key[0]: f.path.rsplit("/", 1)[1] for f in store.manifest.state().tier("wal")}
    assert {f.rsplit("/", 2)[1] for f in store.requested(keys(spark, *(f"{x}{k:04d}" for x in "ac" for k in range(1000)), "zz")).inputFiles()} == {logs["a"], logs["c"]}
    with pytest.raises(InvalidLookup):
        store.file_lookup("", keys(spark, "a"))
    with pytest.raises(InvalidLookup):
        store.file_lookup(store.manifest.state().tier("wal")[0].path, keys(spark))
    found = store.file_lookup(store.manifest.state().tier("wal")[0].path, keys(spark, "a000", "b000"))
    assert {(r.key, r.outcome) for r in found.collect()} == {("a000", "found"), ("b000", "missing")}


def test_files_of_a_run_have_own_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "RUN_FILE_BYTES", 2000)
    store = Store(spark, f"file://{tmp_path}/s")
    for k in range(3):
        store.write(writes(spark, [(f"k{i:04d}", f"v{k}") for i in range(k, 600, 3)]))
    store.compact([1, 2, 3])
    path = store.manifest.state().tier("shared_run")[0].path
    spans = sorted((r[1], r[2]) for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("key"), F.max("key")).collect())
    assert len(spans) > 2 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert store.live().count() == 600


def test_a_compaction_that_dies(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    for v in "123":
        store.write(writes(spark, [("k", v), (f"only{v}", v)]))

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(store, "_save", dies)
        with pytest.raises(KeyboardInterrupt):
            store.maybe_compact(3)
    want = {"k": "3", "only1": "1", "only2": "2", "only3": "3"}
    assert [f.state for f in store.manifest.state().tier("wal")] == ["COMPACTING"] * 3 and seen(store.live()) == want
    assert store.maybe_compact(3) is None and store.recover(3600) == []
    assert store.maybe_compact(3, lease_s=0) == 1 and store.manifest.state().tier("wal") == []
    assert seen(store.live()) == want


def test_partition_tier_and_vacuum(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.manifest.commit(lambda s: s.split(["h", "p"]))
    rng, want = random.Random(3), {}
    for step in range(6):
        rows = [(rng.choice("abcdefghijklmnopqrstuvwxyz"), rng.choice([None, f"v{step}"])) for _ in range(12)]
        store.write(writes(spark, rows))
        want.update(rows)
        if step in (2, 4):
            store.maybe_compact(1)
            assert store.to_partitions()
        assert seen(store.live()) == {k: v for k, v in want.items() if v is not None}
        assert seen(store.batch_get(keys(spark, *"abchpqz"))) == {k: v for k, v in want.items() if v is not None and k in "abchpqz"}
    parts = {r.start_key: r.runs for r in store.partitions().collect()}
    assert sorted(parts) == ["", "h", "p"] and max(map(len, parts.values())) == 2
    for f in store.manifest.state().tier("partition"):
        assert f.min_key >= f.start_key and all(f.max_key < x for x in ("h", "p") if x > f.start_key)
    before = sum(len(x) for _, _, x in os.walk(tmp_path))
    for _ in range(45):
        store.manifest.commit(lambda s: replace(s, starts=s.starts))
    gone = store.vacuum(keep_versions=10, unlisted_s=0)
    assert gone and sum(len(x) for _, _, x in os.walk(tmp_path)) < before + 45
    assert seen(store.live()) == {k: v for k, v in want.items() if v is not None} and store.vacuum(unlisted_s=0) == []
    with pytest.raises(Exception):
        store.live(1).collect()


def test_streams_write_each_batch_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.write(writes(spark, [("a", "1")]), once=("q", 0)) == 1
    assert store.write(writes(spark, [("a", "2")])) == 2
    assert store.write(writes(spark, [("a", "1")]), once=("q", 0)) is None
    assert store.write(writes(spark, [("b", "1")]), once=("r", 0)) == 3
    assert seen(store.live()) == {"a": "2", "b": "1"}


def test_views_outlive_their_files(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.write(writes(spark, [("a", "1"), ("b", "2")]))
    view = store.view()
    assert seen(view.live()) == {"a": "1", "b": "2"}
    shutil.rmtree(tmp_path / "s" / "data")
    assert seen(view.batch_get(keys(spark, "a", "c"))) == {"a": "1"}
    view.close()


def test_change_feed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    spark.dataSource.register(ManifestChanges)

    def follow():
        stream = spark.readStream.format("tidemark_changes").load(store.manifest.folder)
        stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return {(r.version, r.change, r.tier, r.seq_no, r.state) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()}

    store.write(writes(spark, [("a", "1")]))
    want = {(1, "put", "wal", 1, "NEW")}
    assert follow() == want
    store.compact([1])
    want |= {(2, "put", "wal", 1, "COMPACTING"), (3, "gone", "wal", 1, None), (3, "put", "shared_run", 1, None)}
    assert follow() == want


def test_waiting_for_a_change(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.wait(0, timeout_s=0.2) == 0
    other = threading.Timer(0.3, lambda: Manifest(spark, store.manifest.folder).commit(lambda s: s.added("wal", "x")))
    other.start()
    assert store.wait(0, timeout_s=30) == 1
    other.join()


def test_bounded_streams(spark, tmp_path):
    source, store = str(tmp_path / "in"), Store(spark, f"file://{tmp_path}/s")
    for k in range(4):
        writes(spark, [(f"{k}", "v")]).coalesce(1).write.mode("append").parquet(source)
    reader = spark.readStream.schema("key string, put binary, delete boolean, ordinal long")
    stream_to_store(bounded(reader, max_bytes=10).parquet(source), store, str(tmp_path / "c"), trigger={"availableNow": True}).awaitTermination()
    assert store.live().count() == 4 and len(store.manifest.state().tier("wal")) == 4
    again = bounded(spark.readStream.schema("key string, put binary, delete boolean, ordinal long"), files=2).parquet(source)
    stream_to_store(again, store, str(tmp_path / "c2"), trigger={"availableNow": True}).awaitTermination()
    assert len(store.manifest.state().tier("wal")) == 6


def test_streams_side_by_side(spark, tmp_path):
    store, running = Store(spark, f"file://{tmp_path}/s"), []
    for n in range(4):
        source = str(tmp_path / f"in{n}")
        for k in range(3):
            writes(spark, [(f"{n}-{k}", "v")]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, put binary, delete boolean, ordinal long").option("maxFilesPerTrigger", 1).parquet(source)
        running.append(stream_to_store(stream, store, str(tmp_path / f"c{n}"), trigger={"availableNow": True}))
    for q in running:
        q.awaitTermination()
    assert store.live().count() == 12 and len(store.manifest.state().tier("wal")) == 12


def test_write_read_delete(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.live().count() == 0
    for bad in ([("", "x"), ("a", "b")], []):
        with pytest.raises(InvalidWrite):
            store.write(writes(spark, bad))
    assert store.write(writes(spark, [("key1", "old"), ("key3", "value3-from-batch1"), ("key1", "older"), ("empty", "")])) == 1
    assert store.write(writes(spark, [("key2", "value2-from-batch2"), ("key1", "newer")])) == 2
    assert seen(store.batch_get(keys(spark, "key1"))) == {"key1": "newer"}
    assert store.write(writes(spark, [("key1", None)])) == 3
    assert seen(store.batch_get(keys(spark, "key1", "key2", "key3", "no", "empty"))) == {"key2": "value2-from-batch2", "key3": "value3-from-batch1", "empty": ""}
    assert store.batch_get(keys(spark).limit(0)).count() == 0 and store.batch_get(keys(spark, "zzz")).count() == 0
    assert seen(store.live(version=2))["key1"] == "newer"
    assert [r["seq_no"] for r in store.list_wals().collect()] == [1, 2, 3]
    assert store.changes_since(1) == [2, 3]


def test_compaction_keeps_the_view(spark, tmp_path):
    rng, want = random.Random(1), {}
    store = Store(spark, f"file://{tmp_path}/s")
    for step in range(8):
        rows = [(f"k{rng.randrange(12)}", rng.choice([None, "", f"v{step}"])) for _ in range(rng.randint(1, 8))]
        store.write(writes(spark, rows))
        for k, v in rows:
            want[k] = v
        if step in (2, 6):
            store.compact([f.seq_no for f in store.manifest.state().tier("wal")])
        assert seen(store.live()) == {k: v for k, v in want.items() if v is not None}
    run = store.manifest.state().tier("shared_run")[0]
    assert spark.read.parquet(run.path).columns == ["key", "value", "tombstone", "seq", "pos"]
    assert store.maybe_compact(16) is None and store.maybe_compact(1) == 3
    store.delete_runs([1])
    with pytest.raises(Refused):
        store.delete_runs([1, 2])


def test_compactions_that_finish_out_of_order(spark, tmp_path):
    """The records' own numbers decide, not which run was listed last."""
    store = Store(spark, f"file://{tmp_path}/s")
    for v in ("1", "2", "3", "4"):
        store.write(writes(spark, [("k", v), (f"only{v}", v)]))
    store.compact([2, 4])
    store.compact([1, 3])
    assert seen(store.batch_get(keys(spark, "k", "only1"))) == {"k": "4", "only1": "1"}
    tomb = store.write(writes(spark, [("k", None)]))
    store.compact([tomb])
    assert "k" not in seen(store.live())


def test_stream(spark, tmp_path):
    source, store = str(tmp_path / "in"), Store(spark, f"file://{tmp_path}/s")
    writes(spark, [("a", "1"), ("b", "2")]).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("key string, put binary, delete boolean, ordinal long").option("maxFilesPerTrigger", 1).parquet(source)
    stream_to_store(stream, store, str(tmp_path / "c"), trigger={"availableNow": True}).awaitTermination()
    writes(spark, [("a", None), ("c", "3")]).coalesce(1).write.mode("append").parquet(source)
    stream_to_store(stream, store, str(tmp_path / "c"), trigger={"availableNow": True}, compact_at=2).awaitTermination()
    assert seen(store.live()) == {"b": "2", "c": "3"} and store.manifest.state().tier("wal") == []


def fold(rows, max_bytes, max_age):
    out, batch, size, opened = [], 0, 0, None
    for o, ts, n in rows:
        if opened is None or ts >= opened + max_age:
            batch, size, opened = batch + 1, 0, ts
        size += n
        out.append((o, batch))
        if size >= max_bytes:
            opened = None
    return out


def test_flush_windows(spark):
    rng = random.Random(2)
    rows, want = [], set()
    for who in ("a", "b", None):
        ts, own = 0, []
        for o in range(300):
            ts += rng.choice([0, 1, 5, 40])
            own.append((o, ts, rng.choice([0, 3, 12, 50])))
        rows += [(who, *x) for x in own]
        want |= {(who, *x) for x in fold(own, 60, 45)}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "instance string, ordinal long, ts_us long, bytes long")
    assert {tuple(r) for r in flush_batches(df, max_bytes=60, max_age_us=45).collect()} == want
    assert flush_batches(df.limit(0)).count() == 0
    one = flush_batches(df.where("instance = 'a'"), max_bytes=1 << 60, max_age_us=None)
    assert one.agg(F.max("batch")).first()[0] == 1


def test_locations(monkeypatch):
    monkeypatch.delenv("AWS_REGION", raising=False)
    monkeypatch.delenv("AWS_DEFAULT_REGION", raising=False)
    path, conf = resolve("http://host:9000/bucket/a/b/")
    assert path == "s3a://bucket/a/b" and conf["fs.s3a.endpoint"] == "host:9000"
    assert conf["fs.s3a.connection.ssl.enabled"] == "false" and conf["fs.s3a.endpoint.region"] == "us-east-1"
    assert resolve("https://host/bucket")[0] == "s3a://bucket" and resolve("hdfs://n/x/") == ("hdfs://n/x", {})
    with pytest.raises(ValueError):
        resolve("https://host/")
