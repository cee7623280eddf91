"""Queries over the sample tables, each with the same in DuckDB SQL.

Two mutation logs are made of them. Events: key user_id, value event_id, deleted by 'error' events, dealt
into 16 or more logs by event_id. Line items: key order and line, logs by ship year, deleted by flag R.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attrs, load
from ..functions.varint import VERSION
from ..operators import guards, lookup, merge, metrics, placement, routing
from ..schema import records
from ..scratch import shared_path
from ..sources.store import Store
from ..streaming.changes import ManifestChanges
from ..streaming.flush import flush_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The event log.
EV = """WITH ev AS (SELECT user_id::VARCHAR AS key, event_id::VARCHAR AS value, event_id AS seq,
    event_type = 'error' AS tombstone, event_id // ((SELECT count(*) FROM events) // 16) AS wal FROM events) """
WIN = "row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    width = max(1, rows.count() // 16)
    return rows.select(
        F.col("user_id").cast("string").alias("key"),
        F.col("event_id").cast("string").alias("value"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") == "error").alias("tombstone"),
        F.floor(F.col("event_id") / width).alias("wal"),
    )


# The line item log.
LI = """WITH li AS (SELECT l_orderkey || '-' || l_linenumber AS key, l_quantity::INT::VARCHAR AS value, l_shipdate AS d, l_partkey AS p,
    l_suppkey AS s, l_extendedprice AS e, l_returnflag = 'R' AS tombstone, year(l_shipdate)::INT AS wal FROM lineitem) """
LI_ORDER = ["d", "p", "s", "e"]
LI_WIN = "row_number() OVER (PARTITION BY key ORDER BY d DESC, p DESC, s DESC, e DESC) = 1"


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"),
        F.col("l_quantity").cast("int").cast("string").alias("value"),
        F.col("l_shipdate").alias("d"),
        F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("s"),
        F.col("l_extendedprice").alias("e"),
        (F.col("l_returnflag") == "R").alias("tombstone"),
        F.year("l_shipdate").alias("wal"),
    )


@query(EV + f"SELECT key, value FROM (SELECT * FROM ev QUALIFY {WIN}) WHERE NOT tombstone")
def live_events(spark, sf_dir):
    return merge.live(events(spark, sf_dir), ["seq"]).select("key", "value")


@query(LI + f"SELECT key, value FROM (SELECT * FROM li QUALIFY {LI_WIN}) WHERE NOT tombstone")
def live_lineitem(spark, sf_dir):
    return merge.live(lineitems(spark, sf_dir), LI_ORDER).select("key", "value")


@query(EV + f"SELECT wal, key, value, tombstone FROM ev QUALIFY {WIN.replace('BY key', 'BY wal, key')}")
def batch_dedup(spark, sf_dir):
    return merge.newest_wins(events(spark, sf_dir), ["seq"], ["wal", "key"]).select("wal", "key", "value", "tombstone")


_VARINT = "(CASE WHEN {n} < 128 THEN 1 WHEN {n} < 16384 THEN 2 WHEN {n} < 2097152 THEN 3 ELSE 4 END)"
_SIZE = f"{_VARINT.format(n='(2 * strlen(key))')} + strlen(key) + CASE WHEN tombstone THEN 0 ELSE {_VARINT.format(n='strlen(value)')} + strlen(value) END"
_STATS = f"min(key) AS min_key, max(key) AS max_key, count(*) AS n_records, sum(strlen(key) + strlen(value))::BIGINT AS raw_bytes, (sum({_SIZE}) + {VERSION})::BIGINT AS size_bytes"


@query(EV + f"SELECT wal, {_STATS} FROM ev GROUP BY wal")
def wal_stats(spark, sf_dir):
    return merge.batch_stats(events(spark, sf_dir), ["wal"])


@query(LI + f"SELECT wal, {_STATS} FROM li GROUP BY wal")
def wal_stats_lineitem(spark, sf_dir):
    return merge.batch_stats(lineitems(spark, sf_dir), ["wal"])


@query(EV + f"SELECT key, value, tombstone, seq FROM ev QUALIFY {WIN}")
def compact_wals(spark, sf_dir):
    return merge.newest_wins(events(spark, sf_dir), ["seq"]).select("key", "value", "tombstone", "seq")


@query(EV + f"SELECT key, value FROM (SELECT * FROM ev QUALIFY {WIN}) WHERE NOT tombstone")
def compaction_invariance(spark, sf_dir):
    """The live view after the older half of the logs has been compacted."""
    rows = events(spark, sf_dir)
    run = merge.newest_wins(rows.where("wal < 8"), ["seq"])
    return merge.live(merge.concat([rows.where("wal >= 8"), run]), ["seq"]).select("key", "value")


# Requested keys: all customers, most of whom have no events.
KEYS = ", want AS (SELECT DISTINCT c_custkey::VARCHAR AS key FROM customer) "
FILE = ", best AS (SELECT * FROM ev WHERE wal = 3 AND key IN (SELECT key FROM want) QUALIFY " + WIN + ") "


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"))


def _file_lookup(spark, sf_dir):
    return lookup.file_lookup(events(spark, sf_dir).where("wal = 3"), wanted(spark, sf_dir), ["seq"])


@query(EV + KEYS + FILE + "SELECT key, value FROM best WHERE NOT tombstone")
def file_lookup_found(spark, sf_dir):
    return _file_lookup(spark, sf_dir).where("outcome = 'found'").select("key", "value")


@query(EV + KEYS + FILE + "SELECT key FROM best WHERE tombstone")
def file_lookup_deleted(spark, sf_dir):
    return _file_lookup(spark, sf_dir).where("outcome = 'deleted'").select("key")


@query(EV + KEYS + FILE + "SELECT key FROM want WHERE key NOT IN (SELECT key FROM best)")
def file_lookup_missing(spark, sf_dir):
    return _file_lookup(spark, sf_dir).where("outcome = 'missing'").select("key")


@query(EV + KEYS + f"SELECT key, value FROM (SELECT * FROM ev WHERE key IN (SELECT key FROM want) QUALIFY {WIN}) WHERE NOT tombstone")
def batch_get(spark, sf_dir):
    return lookup.batch_get(events(spark, sf_dir), wanted(spark, sf_dir), ["seq"])


# Tiers: the four oldest logs are in partitions, the next four in runs; newer ones are logs.
TIER = "CASE WHEN wal < 4 THEN 0 WHEN wal < 8 THEN 1 ELSE 2 END"


@query(EV + KEYS + f"SELECT key, {TIER} AS tier, wal, tombstone FROM ev WHERE key IN (SELECT key FROM want) QUALIFY {WIN}")
def batch_get_tiers(spark, sf_dir):
    """Which tier and file decides each requested key."""
    tier = F.when(F.col("wal") < 4, 0).when(F.col("wal") < 8, 1).otherwise(2)
    rows = events(spark, sf_dir).withColumn("tier", tier)
    return lookup.deciding(rows, wanted(spark, sf_dir), ["tier", "seq"]).select("key", "tier", "wal", "tombstone")


@query(
    EV
    + KEYS
    + """, f AS (SELECT key, max(wal) AS w FROM ev WHERE key IN (SELECT key FROM want) GROUP BY key), r AS (SELECT DISTINCT wal FROM ev)
    SELECT wal, (SELECT count(*) FROM want) - (SELECT count(*) FROM f WHERE f.w > r.wal) AS remaining FROM r
    WHERE (SELECT count(*) FROM want) > (SELECT count(*) FROM f WHERE f.w > r.wal)"""
)
def remaining_keys_by_file(spark, sf_dir):
    """Keys still to be found when each log, newest first, is probed."""
    rows = events(spark, sf_dir).withColumn("rank", -F.col("wal"))
    got = lookup.remaining_by_file(rows, wanted(spark, sf_dir), "rank")
    return got.select((-F.col("rank")).alias("wal"), "remaining")


@query(EV + KEYS + f"SELECT count(*) AS n_found, max(value) AS last_value FROM (SELECT * FROM ev WHERE key IN (SELECT key FROM want) QUALIFY {WIN}) WHERE NOT tombstone")
def batch_get_map(spark, sf_dir):
    """The response as one map, seen from outside."""
    got = lookup.as_map(batch_get(spark, sf_dir))
    return got.select(F.size("values").cast("long").alias("n_found"), F.array_max(F.map_values("values")).alias("last_value"))


# Partitions that begin at the empty key and at every supplier's key, as text.
STARTS = "WITH st AS (SELECT '' AS start_key UNION SELECT s_suppkey::VARCHAR FROM supplier), ok AS (SELECT o_orderkey::VARCHAR AS key, o_custkey FROM orders) "
ROUTED = ", rt AS (SELECT key, (SELECT max(start_key) FROM st WHERE start_key <= ok.key) AS start_key FROM ok) "


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("start_key"))
    return found.union(spark.createDataFrame([("",)], "start_key string")).distinct()


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"))


@query(STARTS + ROUTED.rstrip() + " SELECT key, start_key FROM rt")
def route_partitions(spark, sf_dir):
    return routing.route(order_keys(spark, sf_dir), starts(spark, sf_dir), strict=True)


@query(STARTS.replace("s_suppkey::VARCHAR FROM supplier", "c_custkey::VARCHAR FROM customer") + ROUTED.rstrip() + " SELECT key, start_key FROM rt")
def route_partitions_many(spark, sf_dir):
    """As many partitions as customers: more than an array literal takes."""
    many = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("start_key"))
    return routing.route(order_keys(spark, sf_dir), many.union(spark.createDataFrame([("",)], "start_key string")), strict=True)


@query(STARTS + ROUTED + "SELECT start_key, count(DISTINCT key) AS n_keys, min(key) AS first_key, max(key) AS last_key FROM rt GROUP BY start_key")
def partition_groups(spark, sf_dir):
    return routing.groups(route_partitions(spark, sf_dir))


@query(
    """WITH p(start_key, path, pos) AS (VALUES ('', 'w0', 0), ('', 'w1', 1), ('5', 'w2', 0), ('5', 'w1', 1), ('5', 'w5', 2)),
    ev AS (SELECT user_id::VARCHAR AS key, event_id::VARCHAR AS value, event_id AS seq, event_type = 'error' AS tombstone, 'w' || (event_id // ((SELECT count(*) FROM events) // 16)) AS path FROM events),
    one AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY path, key ORDER BY seq DESC) = 1),
    rt AS (SELECT DISTINCT key, CASE WHEN key >= '5' THEN '5' ELSE '' END AS start_key FROM ev)
    SELECT key, value FROM (SELECT o.* FROM rt JOIN p USING (start_key) JOIN one o USING (path, key) QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1) WHERE NOT tombstone"""
)
def partition_runs_lookup(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("path", F.concat(F.lit("w"), F.col("wal").cast("string")))
    files = merge.newest_wins(rows, ["seq"], ["path", "key"]).select("path", "key", "value", "tombstone")
    partitions = spark.createDataFrame([("", ["w0", "w1"]), ("5", ["w2", "w1", "w5"])], "start_key string, runs array<string>")
    return routing.partition_lookup(rows.select("key"), partitions, files)


# The file list of the event logs: every fifth is being compacted.
LIST = EV + ", files AS (SELECT wal AS seq_no, CASE WHEN wal % 5 = 4 THEN 'COMPACTING' ELSE 'NEW' END AS state, 'wal' AS tier, min(key) AS min_key, max(key) AS max_key FROM ev GROUP BY wal) "


def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy("wal").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    state = F.when(F.col("wal") % 5 == 4, "COMPACTING").otherwise("NEW")
    return rows.select(F.col("wal").alias("seq_no"), state.alias("state"), F.lit("wal").alias("tier"), "min_key", "max_key")


@query(LIST + "SELECT seq_no, min_key, max_key FROM files ORDER BY seq_no")
def list_wals(spark, sf_dir):
    return file_list(spark, sf_dir).select("seq_no", "min_key", "max_key").orderBy("seq_no")


@query(LIST + "SELECT seq_no FROM files WHERE state = 'NEW'")
def wals_to_compact(spark, sf_dir):
    return file_list(spark, sf_dir).where("state = 'NEW'").select("seq_no")


@query(LIST + "SELECT count(*) FILTER (state = 'NEW') AS n_new, count(*) FILTER (state = 'NEW') >= 16 AS due FROM files")
def compaction_due(spark, sf_dir):
    return guards.compaction_due(file_list(spark, sf_dir))


def _guard(ids: str, state: str) -> str:
    return f", ok AS (SELECT count(*) FILTER (seq_no IN ({ids}) AND state = '{state}') = len([{ids}]) AS ok FROM files) "


@query(LIST + _guard("1, 2, 3", "NEW") + "SELECT seq_no, CASE WHEN ok AND seq_no IN (1, 2, 3) THEN 'COMPACTING' ELSE state END AS state, ok FROM files, ok")
def guard_mark_ok(spark, sf_dir):
    return guards.mark(file_list(spark, sf_dir), [1, 2, 3], "NEW", "COMPACTING").select("seq_no", "state", "ok")


@query(LIST + _guard("1, 4, 900", "NEW") + "SELECT seq_no, CASE WHEN ok AND seq_no IN (1, 4, 900) THEN 'COMPACTING' ELSE state END AS state, ok FROM files, ok")
def guard_mark_fail(spark, sf_dir):
    return guards.mark(file_list(spark, sf_dir), [1, 4, 900], "NEW", "COMPACTING").select("seq_no", "state", "ok")


@query(LIST + _guard("4, 9", "COMPACTING") + "SELECT seq_no, state, ok FROM files, ok WHERE NOT (ok AND seq_no IN (4, 9))")
def guard_delete_ok(spark, sf_dir):
    return guards.delete(file_list(spark, sf_dir), [4, 9], "COMPACTING").select("seq_no", "state", "ok")


@query(LIST + _guard("4, 5", "COMPACTING") + "SELECT seq_no, state, ok FROM files, ok WHERE NOT (ok AND seq_no IN (4, 5))")
def guard_delete_fail(spark, sf_dir):
    return guards.delete(file_list(spark, sf_dir), [4, 5], "COMPACTING").select("seq_no", "state", "ok")


@query(LIST + "SELECT seq_no, false AS ok FROM files")
def guard_delete_twice(spark, sf_dir):
    """One id twice never qualifies."""
    return guards.delete(file_list(spark, sf_dir), [4, 4], "COMPACTING").select("seq_no", "ok")


@query(LIST + "SELECT seq_no FROM files WHERE min_key <= '3' AND max_key >= '101'")
def prune_files(spark, sf_dir):
    return guards.overlapping(file_list(spark, sf_dir), "101", "3").select("seq_no")


_SLOT = "('0x' || substr(md5(seq_no::VARCHAR), 1, 8))::BIGINT"


def _md5_slot():
    return F.conv(F.substring(F.md5(F.col("seq_no").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


@query(LIST + f"SELECT {_SLOT} % 4 AS node, count(*) AS n_files FROM files GROUP BY node")
def file_placement(spark, sf_dir):
    """Files by node, from a hash that SQL has too."""
    placed = placement.place(file_list(spark, sf_dir).withColumn("path", F.col("seq_no").cast("string")), 4, hashed=_md5_slot())
    return placed.groupBy("node").agg(F.count(F.lit(1)).alias("n_files"))


@query(LIST + f"SELECT seq_no, CASE WHEN {_SLOT} % 4 IN (1, 2) THEN CASE WHEN ({_SLOT} + 1) % 4 IN (1, 2) THEN NULL ELSE ({_SLOT} + 1) % 4 END ELSE {_SLOT} % 4 END AS node FROM files")
def file_placement_fallback(spark, sf_dir):
    """The next node on the ring takes a file whose node is down; with both down, none does."""
    return placement.place(file_list(spark, sf_dir).withColumn("path", F.col("seq_no").cast("string")), 4, [1, 2], hashed=_md5_slot()).select("seq_no", "node")


@query(None)
def file_placement_xxhash(spark, sf_dir):
    """Placement by xxhash64, which DuckDB lacks; tests compare it with the hash's own library."""
    return placement.place(file_list(spark, sf_dir).withColumn("path", F.concat(F.lit("wal/"), F.col("seq_no").cast("string"))), 4).select("seq_no", "node")


@query(
    """WITH r AS (SELECT event_id, CASE WHEN user_id % 10 = 0 THEN '' ELSE event_type END AS path, CASE WHEN event_type = 'error' THEN [] ELSE [user_id::VARCHAR] END AS keys FROM events)
    SELECT event_id, CASE WHEN path = '' THEN 'object path is empty' WHEN len(keys) = 0 THEN 'no keys' END AS error FROM r"""
)
def file_request_errors(spark, sf_dir):
    """Requests for keys of a file, some without a path and some without keys."""
    path = F.when(F.col("user_id") % 10 == 0, "").otherwise(F.col("event_type"))
    keys = F.when(F.col("event_type") == "error", F.array().cast("array<string>")).otherwise(F.array(F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", lookup.request_error(path, keys).alias("error"))


def _flush_sql(max_bytes: int, max_age_us: int) -> str:
    return f"""WITH RECURSIVE r AS (SELECT event_type AS instance, event_id AS ordinal, epoch_us(ts) AS t, (strlen(user_id::VARCHAR) + strlen(props))::BIGINT AS b, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
    f(instance, ordinal, k, batch, size, opened) AS (
        SELECT instance, ordinal, k, 1::BIGINT, b, t FROM r WHERE k = 1
        UNION ALL
        SELECT r.instance, r.ordinal, r.k, CASE WHEN x THEN f.batch + 1 ELSE f.batch END, CASE WHEN x THEN r.b ELSE f.size + r.b END, CASE WHEN x THEN r.t ELSE f.opened END
        FROM f JOIN r ON r.instance = f.instance AND r.k = f.k + 1, LATERAL (SELECT f.size >= {max_bytes} OR r.t >= f.opened + {max_age_us} AS x))
    SELECT instance, ordinal, batch FROM f"""


def _requests(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    size = F.octet_length(F.col("user_id").cast("string")) + F.octet_length("props")
    return rows.select(F.col("event_type").alias("instance"), F.col("event_id").alias("ordinal"), F.expr("unix_micros(cast(ts as timestamp))").alias("ts_us"), size.alias("bytes"))


@query(_flush_sql(1000, 10**18))
def flush_batches_size(spark, sf_dir):
    return flush_batches(_requests(spark, sf_dir), max_bytes=1000, max_age_us=10**18)


@query(_flush_sql(2000, 3_600_000_000))
def flush_batches_age(spark, sf_dir):
    return flush_batches(_requests(spark, sf_dir), max_bytes=2000, max_age_us=3_600_000_000)


def _served(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("service"), F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("ok"))


@query(
    """WITH q AS (SELECT user_id::VARCHAR AS service, value AS ms, event_type <> 'error' AS ok FROM events)
    SELECT service, count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok) * 100.0::DOUBLE / count(*) AS success_percent,
    count(*) / 10.0::DOUBLE AS per_second, min(ms) FILTER (ok) AS min_ms, max(ms) FILTER (ok) AS max_ms, round(coalesce(sum(ms) FILTER (ok), 0) / count(*), 6) AS avg_ms FROM q GROUP BY service"""
)
def latency_summary(spark, sf_dir):
    return metrics.latency_summary(_served(spark, sf_dir), 10.0).withColumn("avg_ms", F.round("avg_ms", 6))


@query(
    """SELECT user_id::VARCHAR AS service, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.9), 6) AS p90_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms
    FROM events WHERE event_type <> 'error' GROUP BY service"""
)
def latency_quantiles(spark, sf_dir):
    got = metrics.latency_quantiles(_served(spark, sf_dir).where("ok"), exact=True)
    return got.select("service", *(F.round(c, 6).alias(c) for c in ("p50_ms", "p90_ms", "p99_ms")))


@query(
    """SELECT user_id::VARCHAR AS service, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.9) AS p90_ms, quantile_disc(value, 0.99) AS p99_ms
    FROM events WHERE event_type <> 'error' GROUP BY service"""
)
def latency_quantiles_sketch(spark, sf_dir):
    """The bounded sketch, which is exact to a ten-thousandth of the rank."""
    return metrics.latency_quantiles(_served(spark, sf_dir).where("ok"))


_FILL = f"repeat('{load.ALPHABET}', 2)"
LOAD = f"WITH k AS (SELECT kind, i AS index, kind || lpad(i::VARCHAR, 4, '0') || '_' || substr({_FILL}, 1, 10) AS key FROM unnest(['W', 'U', 'D']) x(kind), range(30) y(i)) "


@query(LOAD + "SELECT kind, index, key FROM k")
def stress_keys(spark, sf_dir):
    return load.load_keys(spark)


@query(f"SELECT n, substr(repeat('{load.ALPHABET}', 5), 1, n::INT) AS value FROM range(200) t(n)")
def stress_values(spark, sf_dir):
    return spark.range(200).select(F.col("id").alias("n"), load.filler(F.col("id").cast("int")).alias("value"))


@query("SELECT i AS read, CASE i % 3 WHEN 0 THEN 'W' WHEN 1 THEN 'U' ELSE 'D' END AS kind FROM range(90) t(i)")
def read_mode_mixed(spark, sf_dir):
    return spark.range(90).select(F.col("id").alias("read"), load.chosen_class("mixed", F.col("id")).alias("kind"))


@query(LOAD + "SELECT kind, count(*) AS reads, count(*) FILTER (CASE kind WHEN 'W' THEN index % 7 = 0 WHEN 'D' THEN index % 11 = 0 ELSE false END) AS incorrect FROM k GROUP BY kind")
def verify_reads(spark, sf_dir):
    """Every seventh written key is lost and every eleventh deleted one is there."""
    keys = load.load_keys(spark)
    there = keys.where("kind = 'W' and index % 7 <> 0 or kind = 'D' and index % 11 = 0").withColumn("value", load.filler(F.lit(100)))
    return metrics.verify_reads(keys, there)


MUTATIONS = """WITH m AS (SELECT CASE WHEN event_id % 50 = 0 THEN '' ELSE user_id::VARCHAR END AS key, CASE WHEN event_id % 7 <> 0 THEN event_type END AS put,
    CASE WHEN event_id % 7 = 0 THEN event_type = 'error' END AS del, event_id AS ordinal FROM events) """


def _mutations(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.when(e % 50 == 0, "").otherwise(F.col("user_id").cast("string")).alias("key"),
        F.when(e % 7 != 0, F.col("event_type").cast("binary")).alias("put"),
        F.when(e % 7 == 0, F.col("event_type") == "error").alias("delete"),
        e.alias("ordinal"),
    )


@query(MUTATIONS + "SELECT key, ordinal FROM m WHERE key = ''")
def validate_writes(spark, sf_dir):
    from ..schema import invalid_writes

    return invalid_writes(_mutations(spark, sf_dir)).select("key", "ordinal")


@query(MUTATIONS + "SELECT key, ordinal, CASE WHEN coalesce(del, false) THEN NULL ELSE coalesce(put, '') END AS value, coalesce(del, false) AS tombstone FROM m")
def mutation_projection(spark, sf_dir):
    got = records(_mutations(spark, sf_dir), "ordinal")
    return got.select("key", "ordinal", F.col("value").cast("string").alias("value"), "tombstone")


@query(
    EV
    + f""", s AS (SELECT wal, {_STATS} FROM ev GROUP BY wal)
    SELECT 'wal/' || wal AS path, size_bytes, min_key, max_key, '{{"path":"wal/' || wal || '","sizeBytes":"' || size_bytes || '","minKey":"' || min_key || '","maxKey":"' || max_key || '"}}' AS attrs FROM s"""
)
def attrs_json(spark, sf_dir):
    stats = merge.batch_stats(events(spark, sf_dir), ["wal"])
    made = attrs.to_attrs(F.concat(F.lit("wal/"), F.col("wal").cast("string")), F.lit(None).cast("timestamp"), F.col("size_bytes"), F.col("min_key"), F.col("max_key"))
    got = stats.select(made.alias("attrs")).withColumn("x", attrs.from_attrs(F.col("attrs")))
    return got.select("x.path", "x.size_bytes", "x.min_key", "x.max_key", "attrs")


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' WHEN epoch_us(ts) % 1000 = 0 THEN '.' || lpad((epoch_us(ts) % 1000000 // 1000)::VARCHAR, 3, '0')
    ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END || 'Z' AS stamp FROM (SELECT event_id, ts + to_microseconds(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 7000 ELSE 7 END) AS ts FROM events)"""
)
def attrs_times(spark, sf_dir):
    """Times as attributes write them, with as many digits as they need."""
    extra = F.when(F.col("event_id") % 3 == 0, 0).when(F.col("event_id") % 3 == 1, 7000).otherwise(7)
    utc = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", attrs.time_text(F.timestamp_micros(F.unix_micros(utc) + extra)).alias("stamp"))


@query(EV + "SELECT key, CASE WHEN NOT tombstone THEN value END AS value, tombstone FROM ev")
def sstable_roundtrip(spark, sf_dir):
    """The events written as record files and read again."""
    from ..sources.sstable import SSTableSource, read_files

    spark.dataSource.register(SSTableSource)
    at = shared_path(spark, "records")
    rows = events(spark, sf_dir).select("key", F.col("value").cast("binary").alias("value"), "tombstone")
    rows.write.format("sstable").mode("append").save(at)
    return read_files(spark, at).select("key", F.col("value").cast("string").alias("value"), "tombstone")


def _filled(spark: SparkSession, sf_dir: str) -> Store:
    """A store with the events in four batches, the first three compacted."""
    store = Store(spark, shared_path(spark, "store"))
    rows = events(spark, sf_dir)
    for k in range(4):
        part = rows.where((F.col("wal") >= 4 * k) & ((F.col("wal") < 4 * k + 4) | F.lit(k == 3)))
        store.write(part.select("key", F.when(~F.col("tombstone"), F.col("value").cast("binary")).alias("put"), F.col("tombstone").alias("delete"), F.col("seq").alias("ordinal")))
        if k == 2:
            store.maybe_compact(3)
    return store


@query(EV + f"SELECT key, value FROM (SELECT * FROM ev QUALIFY {WIN}) WHERE NOT tombstone")
def store_live(spark, sf_dir):
    return _filled(spark, sf_dir).live().select("key", F.col("value").cast("string").alias("value"))


@query(EV + KEYS + f"SELECT key, value FROM (SELECT * FROM ev WHERE key IN (SELECT key FROM want) QUALIFY {WIN}) WHERE NOT tombstone")
def store_batch_get(spark, sf_dir):
    return _filled(spark, sf_dir).batch_get(wanted(spark, sf_dir)).select("key", F.col("value").cast("string").alias("value"))


PARTED = "WITH st AS (SELECT unnest(['', '120', '3', '75']) AS start_key), " + EV.removeprefix("WITH ")


@query(PARTED + f", top AS (SELECT * FROM ev QUALIFY {WIN}) SELECT key, value, (SELECT max(start_key) FROM st WHERE start_key <= top.key) AS start_key FROM top WHERE NOT tombstone")
def store_partitions(spark, sf_dir):
    """All logs and runs moved into partitions; each visible key with the start of its partition's run."""
    store = _filled(spark, sf_dir)
    store.manifest.commit(lambda s: s.split(["120", "3", "75"]))
    store.maybe_compact(1)
    store.to_partitions()
    files = store.manifest.files().where("tier = 'partition'").select("start_key", "min_key", "max_key")
    live = store.live()
    # Runs of different partitions have ranges that don't overlap, four of them here.
    return live.join(F.broadcast(files), F.col("key").between(F.col("min_key"), F.col("max_key"))).select("key", F.col("value").cast("string").alias("value"), "start_key")


@query("SELECT * FROM (VALUES (1, 'wal', 'NEW'), (2, 'wal', 'NEW'), (3, 'wal', 'NEW'), (4, 'wal', 'COMPACTING'), (5, 'shared_run', NULL), (6, 'wal', 'NEW')) x(version, tier, state)")
def store_changes(spark, sf_dir):
    """The last file that each version of the list puts in place, as the change feed tells it."""
    store = _filled(spark, sf_dir)
    spark.dataSource.register(ManifestChanges)
    stream = spark.readStream.format("tidemark_changes").load(store.manifest.folder)
    at = shared_path(spark, "changes")
    stream.writeStream.option("checkpointLocation", shared_path(spark, "checkpoint")).trigger(availableNow=True).start(at).awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(at).where("change = 'put'")
    return rows.groupBy("version").agg(F.max_by(F.struct("tier", "state"), "seq_no").alias("x")).select(F.col("version").cast("int"), "x.tier", "x.state")
