"""Record files, sizes, lookups, routing and generators."""

import bisect
import random

import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidemark.functions import attrs, load
from tidemark.functions.varint import decode, encode, record_size
from tidemark.operators import guards, lookup, merge, metrics, placement, routing
from tidemark.schema import invalid_writes, records
from tidemark.sources.sstable import FAILFAST, CorruptFile, SSTableSource, decode_records, encode_records, read_files

ROWS = st.lists(st.tuples(st.text(max_size=80), st.one_of(st.none(), st.binary(max_size=200))).map(lambda x: (x[0].encode("utf-8", "replace").decode(), x[1], x[1] is None)), max_size=12)


def test_known_bytes():
    assert encode_records([]) == b"\x01"
    assert encode_records([("key1", b"abc", False), ("key2", None, True)]) == b"\x01\x08key1\x03abc\x09key2"
    same = [("key1", b"a", False)] * 3
    assert list(decode_records(encode_records(same))) == same


@settings(deadline=None, max_examples=60)
@given(ROWS)
def test_round_trip_and_truncation(rows):
    data = encode_records(rows)
    assert list(decode_records(data, FAILFAST)) == rows
    borders = {len(encode_records(rows[:k])): k for k in range(len(rows) + 1)}
    for cut in range(len(data)):
        got = list(decode_records(data[:cut]))
        assert got == rows[: len(got)]
        if cut not in borders:
            with pytest.raises(CorruptFile):
                list(decode_records(data[:cut], FAILFAST))


def test_other_versions_and_long_numbers():
    assert list(decode_records(b"")) == [] and list(decode_records(b"\x02\x08key1\x01a")) == []
    with pytest.raises(CorruptFile):
        list(decode_records(b"\x02", FAILFAST))
    assert decode(b"\xff" * 10, 0) is None and decode(encode((1 << 64) - 1), 0) == ((1 << 64) - 1, 10)


def test_sizes(spark):
    rows = [("k", b"v", False), ("k" * 63, b"v" * 127, False), ("k" * 64, b"v" * 128, False), ("é" * 8200, b"", False), ("gone", None, True), ("", b"x" * 70000, False)]
    df = spark.createDataFrame(rows, "key string, value binary, tombstone boolean")
    got = df.withColumn("n", record_size(F.col("key"), F.col("value"), F.col("tombstone"))).collect()
    assert [r["n"] for r in got] == [len(encode_records([x])) - 1 for x in rows]
    assert merge.batch_stats(df.withColumn("f", F.lit(1)), ["f"]).first()["size_bytes"] == len(encode_records(rows))


def test_data_source(spark, tmp_path):
    spark.dataSource.register(SSTableSource)
    rows = [("b", b"2", False), ("a", b"", False), ("c", None, True), ("a", b"9", False)]
    df = spark.createDataFrame(rows, "key string, value binary, tombstone boolean").coalesce(1)
    at = str(tmp_path / "t")
    for mode in ("append", "overwrite"):
        df.write.format("sstable").mode(mode).save(at)
        for got in (spark.read.format("sstable").load(at), read_files(spark, at)):
            assert [(r["key"], None if r["value"] is None else bytes(r["value"]), r["tombstone"]) for r in got.orderBy("pos").collect()] == rows
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.sstable").write_bytes(encode_records(rows)[:-1])
    assert spark.read.format("sstable").load(str(tmp_path / "bad")).count() == 3
    with pytest.raises(Exception, match="value"):
        spark.read.format("sstable").option("mode", "failfast").load(str(tmp_path / "bad")).count()


def test_mutations(spark):
    df = spark.createDataFrame([("a", b"1", None), ("b", None, True), ("c", None, None), ("d", None, False), ("", b"x", False)], "key string, put binary, delete boolean")
    got = {r["key"]: (r["value"], r["tombstone"]) for r in records(df).collect()}
    assert got["a"][0] == b"1" and got["b"] == (None, True) and got["c"] == (b"", False) and got["d"] == (b"", False)
    assert invalid_writes(df).count() == 1


def test_file_lookup(spark):
    rows = spark.createDataFrame([("key1", "value1", False, 0), ("key2", "old", False, 1), ("key2", "value2", False, 2), ("deleted-key", None, True, 3)], "key string, value string, tombstone boolean, pos long")
    keys = spark.createDataFrame([("key1",), ("key2",), ("deleted-key",), ("none",), ("key1",), (None,)], "key string")
    assert {tuple(r) for r in lookup.file_lookup(rows, keys, ["pos"]).collect()} == {("key1", "found", "value1"), ("key2", "found", "value2"), ("deleted-key", "deleted", None), ("none", "missing", None)}
    assert lookup.file_lookup(rows, keys.limit(0), ["pos"]).count() == 0


def test_probe_sets_shrink(spark):
    rows = spark.createDataFrame([("key1", None, True, 3), ("key2", "b2", False, 2), ("key3", "b1", False, 1), ("key1", "b1", False, 1)], "key string, value string, tombstone boolean, seq long")
    keys = spark.createDataFrame([("key1",), ("key2",), ("key3",)], "key string")
    assert {(r["key"], r["value"]) for r in lookup.batch_get(rows, keys, ["seq"]).collect()} == {("key2", "b2"), ("key3", "b1")}
    got = lookup.remaining_by_file(rows.withColumn("rank", -F.col("seq")), keys, "rank").collect()
    assert {-r["rank"]: r["remaining"] for r in got} == {3: 3, 2: 2, 1: 1}
    assert lookup.as_map(lookup.batch_get(rows, keys, ["seq"])).first()["values"] == {"key2": "b2", "key3": "b1"}


WAYS = {"array": {}, "sent": {"array_starts": 0}, "sorted": {"array_starts": 0, "sent_starts": 0}}


@pytest.mark.parametrize("way", WAYS)
def test_routing(spark, way):
    starts = spark.createDataFrame([("b",), ("d",), ("dd",), ("x",), ("d",), (None,)], "start_key string")
    names = ["a", "b", "bz", "c", "d", "da", "dd", "de", "w", "x", "zz", "a", None, "\u00e4", "\U0001f600"]
    keys = spark.createDataFrame([(n, k, "clash") for k, n in enumerate(names)], "key string, extra int, start_key string")
    got = {r["extra"]: r["start_key"] for r in routing.route(keys, starts, **WAYS[way]).collect()}
    assert got == {k: max((s for s in ("b", "d", "dd", "x") if n and s <= n), default=None) for k, n in enumerate(names)}
    with pytest.raises(Exception, match="no partition"):
        routing.route(keys, starts, strict=True, **WAYS[way]).collect()
    assert routing.route(keys.where("key > 'c'"), starts, strict=True, **WAYS[way]).count() == 9
    assert routing.route(keys, starts.limit(0), **WAYS[way]).where("start_key is not null").count() == 0


@pytest.mark.parametrize("way", ["sent", "sorted"])
def test_routing_to_many_partitions(spark, way):
    """Over 512 starts, 100,000 rows with other columns, a key with a third of them, 64 partitions; by bisection."""
    rng = random.Random(6)
    starts = sorted({str(rng.randrange(10**6)) for _ in range(600)})
    names = [str(rng.randrange(10**6)) if rng.random() < 0.66 else "5" for _ in range(100_000)]
    keys = spark.createDataFrame(pd.DataFrame({"key": names, "n": range(len(names)), "other": [x[::-1] for x in names]}))
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = routing.route(keys.repartition(16), spark.createDataFrame([(x,) for x in starts], "start_key string"), **WAYS[way]).toPandas().sort_values("n")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    places = [bisect.bisect_right(starts, x) for x in names]
    assert len(got) == len(names) and got.start_key.where(got.start_key.notna(), None).tolist() == [starts[p - 1] if p else None for p in places]


def test_placement(spark):
    paths = [f"wal/{k}" for k in range(50)]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    first = {p: xxhash.xxh64_intdigest(p.encode(), seed=42) for p in paths}
    first = {p: (h - (1 << 64) if h >> 63 else h) % 5 for p, h in first.items()}
    assert {r.path: r.node for r in placement.place(df, 5).collect()} == first
    up = {p: next((k for k in (n, (n + 1) % 5) if k not in (1, 2)), None) for p, n in first.items()}
    assert {r.path: r.node for r in placement.place(df, 5, [1, 2]).collect()} == up


def test_partition_runs_hide_by_tombstones(spark):
    parts = spark.createDataFrame([("", ["p0", "p1"]), ("m", ["p2"])], "start_key string, runs array<string>")
    rows = spark.createDataFrame([("p0", "a", "old", False), ("p1", "a", None, True), ("p0", "b", "1", False), ("p1", "b", "2", False), ("p2", "a", "elsewhere", False), ("p2", "n", "3", False)], "path string, key string, value string, tombstone boolean")
    keys = spark.createDataFrame([("a",), ("b",), ("n",), ("q",)], "key string")
    assert {(r["key"], r["value"]) for r in routing.partition_lookup(keys, parts, rows).collect()} == {("b", "2"), ("n", "3")}


def test_guards(spark):
    files = spark.createDataFrame([(1, "NEW"), (2, "NEW"), (3, "COMPACTING")], "seq_no long, state string")
    for ids, state, ok in (([1, 2], "NEW", True), ([1, 3], "NEW", False), ([], "NEW", False), ([1, 1], "NEW", False), ([3], "COMPACTING", True), ([1, 3], None, True), ([9], None, False)):
        assert guards.qualifies(files, ids, state).first()["ok"] is ok
    assert guards.delete(files, [1, 9], None).count() == 3 and guards.delete(files, [1, 3], None).count() == 1


def test_attributes(spark):
    row = spark.sql("select 'p' path, timestamp'2024-01-02 03:04:05' t, 5000000000L n, 'a' lo, '' hi")
    made = row.select(attrs.to_attrs(F.col("path"), F.col("t"), F.col("n"), F.col("lo"), F.col("hi")).alias("j"))
    assert made.first()["j"] == '{"path":"p","createdAt":"2024-01-02T03:04:05Z","sizeBytes":"5000000000","minKey":"a"}'
    for text, want in (("05.5", "05.500Z"), ("05.000007", "05.000007Z"), ("05.123456", "05.123456Z"), ("05", "05Z")):
        assert spark.sql(f"select timestamp'1969-01-02 03:04:{text}' t").select(attrs.time_text(F.col("t"))).first()[0] == f"1969-01-02T03:04:{want}"
    back = made.select(attrs.from_attrs(F.col("j")).alias("x")).first()["x"]
    assert (back["path"], back["size_bytes"], back["min_key"], back["max_key"]) == ("p", 5000000000, "a", "")


def test_load_generator(spark):
    rows = load.load_keys(spark, 12, 16).collect()
    assert len(rows) == 36 and all(len(r["key"]) == 16 for r in rows) and rows[0]["key"].startswith("W0000_abc")
    assert spark.range(1).select(load.filler(F.lit(100)).alias("v")).first()["v"] == (load.ALPHABET * 2)[:100]
    kinds = [r[0] for m in ("written", "notwritten", "deleted") for r in spark.range(1).select(load.chosen_class(m, F.col("id"))).collect()]
    assert kinds == ["W", "U", "D"]


def test_latencies(spark):
    df = spark.createDataFrame([("s", 10.0, True), ("s", 30.0, True), ("s", 99.0, False), ("t", 5.0, False)], "service string, latency_ms double, ok boolean")
    got = {r["service"]: r for r in metrics.latency_summary(df, 2.0).collect()}
    assert (got["s"]["total"], got["s"]["failed"], got["s"]["min_ms"], got["s"]["max_ms"]) == (3, 1, 10.0, 30.0)
    assert got["s"]["avg_ms"] == pytest.approx(40 / 3) and got["s"]["per_second"] == 1.5 and got["t"]["avg_ms"] == 0 and got["t"]["min_ms"] is None
    assert metrics.latency_quantiles(df).where("service = 's'").first()["p50_ms"] == 10.0


def test_plans(spark, tmp_path):
    spark.range(1000).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value"), F.lit(False).alias("tombstone"), F.col("id").alias("seq"), F.lit(0).alias("unused")).write.parquet(str(tmp_path / "f"))
    rows = spark.read.parquet(str(tmp_path / "f"))
    explain = lambda df: df._jdf.queryExecution().executedPlan().toString()
    merged = explain(merge.newest_wins(rows.select("key", "value", "tombstone", "seq"), ["seq"]))
    assert merged.count("Exchange") == 1 and "partial_max_by" in merged and "unused" not in merged
    some = spark.createDataFrame([("5",)], "key string")
    assert "LeftSemi" in explain(lookup.of_keys(rows, some))
    assert "PushedFilters: [IsNotNull(key), GreaterThanOrEqual(key,5)" in explain(rows.where("key >= '5' and key <= '6'").select("key"))
