"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
#: Rows of a shard, about, and shards of a group: quotas go from sources to groups to shards.
SHARD_DOCS, GROUP_SHARDS = 1024, 1024
#: Words of a block. With larger ones, sources of less than half a block get nothing.
BLOCK = 1
#: Tables of sources or shards of up to so many rows (under 8 MB) are broadcast, larger ones shuffled.
BROADCAST_ROWS = 100_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds target to (source, source_size): weights repeat in code point order of the sources, null last.

    Targets share the sum of all sizes by weight. One above cap times its source's size stays there and
    the excess goes to the others by weight until none is above: with sources ordered by cap / weight,
    those that stop form a prefix, and the level of the others is the largest of the prefixes' levels.
    """
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("__fill", "__rank").rowsBetween(Window.unboundedPreceding, -1)
    got = sources.withColumn("__rank", F.row_number().over(by_name))
    got = got.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), F.col("__rank") % len(weights) + F.when(F.col("__rank") % len(weights) == 0, len(weights)).otherwise(0)).cast("long"))
    got = got.withColumn("__cap", F.col("source_size") * cap).withColumn("__fill", F.col("__cap").cast("double") / F.col("__w"))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0))).cast("double") / (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0)))
    got = got.withColumn("__level", level).withColumn("__level", F.max("__level").over(whole))
    return got.withColumn("target", F.least(F.col("__cap").cast("double"), F.col("__w") * F.col("__level"))).drop("__w", "__cap", "__fill", "__level")


def apportion(parties: DataFrame, by: list[str], votes: str, seats: str, order: list[str], out: str, room: str | None = None) -> DataFrame:
    """Sainte-Lague: in each group `by`, its `seats` go to the highest quotients votes / (2 s + 1).

    A divisor that gives too many seats and one that gives too few bracket every party's seats; only the
    quotients between them, about two for each party, are ranked. Ties go by `order`. With `room`, no party
    gets more seats than that: the votes of those that are full count as far as their room goes, and what
    they can't take goes to the others by their quotients; seats beyond all rooms are not given.
    """
    group = Window.partitionBy(*by)
    got = parties.withColumn("__v", F.col(votes).cast("double")).withColumn("__seats", F.col(seats).cast("long"))
    if room is not None:
        got = got.withColumn("__room", F.when(F.col("__v") > 0, F.col(room)).otherwise(0))
        got = got.withColumn("__seats", F.least("__seats", F.sum("__room").over(group)))
        filled = Window.partitionBy(*by).orderBy(F.when(F.col("__v") > 0, F.col("__room") / F.col("__v")).asc_nulls_first(), *order)
        before = filled.rowsBetween(Window.unboundedPreceding, -1)
        rest = F.sum("__v").over(group) - F.coalesce(F.sum("__v").over(before), F.lit(0.0))
        level = F.when((F.col("__v") > 0) & (rest > 0), (F.col("__seats") - F.coalesce(F.sum("__room").over(before), F.lit(0))) / rest)
        got = got.withColumn("__level", level).withColumn("__level", F.max("__level").over(group))
        # Votes stay as they are, to the last bit, where no party is full.
        even = F.col("__seats") / F.sum("__v").over(group)
        got = got.withColumn("__v", F.when(F.col("__level") <= even * (1 + 1e-9), F.col("__v")).otherwise(F.least(F.col("__room").cast("double"), F.col("__v") * F.col("__level"))))
    total, n = F.sum("__v").over(group), F.count(F.lit(1)).over(group)
    few = F.when(F.col("__seats") > n / 2 + 1, F.floor(F.col("__v") * (F.col("__seats") - n / 2 - 1) / total + 0.5)).otherwise(0)
    many = F.floor(F.col("__v") * (F.col("__seats") + n / 2 + 1) / total + 0.5)
    bound = (lambda c: F.least(c.cast("long"), F.col("__room"))) if room is not None else (lambda c: c.cast("long"))
    got = got.withColumn("__lo", bound(F.when(total > 0, few).otherwise(0))).withColumn("__hi", bound(F.when(total > 0, many).otherwise(0)))
    got = got.withColumn("__left", F.col("__seats") - F.sum("__lo").over(group))
    got = got.withColumn("__s", F.explode(F.concat(F.array(F.lit(-1).cast("long")), F.when(F.col("__hi") > F.col("__lo"), F.sequence(F.col("__lo"), F.col("__hi") - 1)).otherwise(F.array().cast("array<long>")))))
    quotient = F.when(F.col("__s") >= 0, F.col("__v") / (2 * F.col("__s") + 1))
    best = Window.partitionBy(*by).orderBy(quotient.desc_nulls_last(), *order, "__s")
    got = got.withColumn("__won", (F.col("__s") >= 0) & (F.row_number().over(best) <= F.col("__left")))
    keys = [c for c in parties.columns]
    return got.groupBy(*keys, "__lo").agg(F.count_if("__won").alias("__won")).withColumn(out, F.col("__lo") + F.col("__won")).select(*keys, out)


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, shard_docs: int = SHARD_DOCS, group_shards: int = GROUP_SHARDS, seed: str = SEED) -> DataFrame:
    """`docs` with size, source_size, target and taken: the words that the mix takes of each row.

    Blocks of `block` words go to the sources by highest quotients, then to each source's groups of shards,
    and to the shards of about `shard_docs` rows, so that a source with most rows is spread over many tasks
    and no task ranks all shards. Nobody gets more blocks than `cap` times its words hold; others of the
    source take these. A shard lays its rows out in a seeded order as one stream and gives its blocks from
    the head of it; a quota above the stream's length starts again from the head, up to `cap` times. Streams
    are cut on a table without texts; a text only learns on which side of its shard's cut it is.

    Null or empty text: size 0, nothing taken. Null source: a source of its own, the last. Null doc_id:
    a row like any other, placed by its text. Rows alike in all of doc_id, source and size are
    interchangeable. A very long text is a row like any other. An empty table gives an empty one. Columns of
    `docs` named like the results or beginning with "__" are replaced.
    """
    made = ("size", "source_size", "target", "taken")
    rows = docs.drop(*[c for c in docs.columns if c in made or c.startswith("__")])
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit("-"))
    key = F.md5(F.concat_ws("|", F.lit(seed), name).cast("binary"))
    rows = rows.withColumn("size", word_count(F.col("text"))).withColumn("__key", key)
    small = cut(rows.select("source", "size", "__key"), "sizes")

    found = targets(small.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__docs")), weights, cap)
    sources = cut(found.withColumn("__shards", F.ceil(F.col("__docs") / shard_docs)), "sources")
    n_sources = sources.count()

    def with_shard(df: DataFrame, sources: DataFrame) -> DataFrame:
        right = sources.withColumnRenamed("source", "__source")
        got = df.join(broadcast_if_small(right, n_sources, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
        return got.withColumn("__shard", F.pmod(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long"), F.col("__shards")))

    shards = with_shard(small, sources.select("source", "__rank", "__shards")).groupBy("__rank", "__shard").agg(F.sum("size").alias("__stream"))
    shards = cut(shards.withColumn("__room", F.floor(F.col("__stream") * cap / block)).withColumn("__group", F.floor(F.col("__shard") / group_shards)), "streams")
    groups = shards.groupBy("__rank", "__group").agg(F.sum("__stream").alias("__votes"), F.sum("__room").alias("__hold"))
    rooms = groups.groupBy("__rank").agg(F.sum("__hold").alias("__most"))
    total = F.sum("source_size").over(Window.partitionBy())
    seats = apportion(sources.join(rooms, "__rank").withColumn("__all", F.round(total / block).cast("long")), [], "target", "__all", ["__rank"], "__seats", "__most").select("__rank", "__seats")
    groups = apportion(groups.join(seats, "__rank"), ["__rank"], "__votes", "__seats", ["__group"], "__blocks", "__hold").select("__rank", "__group", "__blocks")
    quotas = apportion(shards.join(groups, ["__rank", "__group"]), ["__rank", "__group"], "__stream", "__blocks", ["__shard"], "__quota", "__room")
    words = F.col("__quota") * block
    passes = F.when(F.col("__stream") > 0, F.floor(words / F.col("__stream"))).otherwise(0).cast("long")
    quotas = cut(quotas.select(F.col("__rank").alias("__r"), F.col("__shard").alias("__h"), passes.alias("__passes"), (words - passes * F.col("__stream")).alias("__rest")), "quotas")
    n_shards = quotas.count()
    quotas = broadcast_if_small(quotas, n_shards, BROADCAST_ROWS)

    # The rows in which streams are cut: what is before them is taken, what follows is not.
    got = with_shard(small, sources.select("source", "__rank", "__shards")).join(quotas, (F.col("__rank") == F.col("__r")) & (F.col("__shard") == F.col("__h"))).drop("__rank", "__shard")
    alike = got.where("size > 0 and __rest > 0").groupBy("__r", "__h", "__key", "size").agg(F.count(F.lit(1)).alias("__n"), F.first("__rest").alias("__rest"))
    stream = Window.partitionBy("__r", "__h").orderBy("__key", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("size") * F.col("__n")).over(stream), F.lit(0))
    cuts = alike.withColumn("__part", F.col("__rest") - before).where("__part > 0 and __part <= size * __n")
    cuts = cut(cuts.select(F.col("__r").alias("__cr"), F.col("__h").alias("__ch"), F.col("__key").alias("__ck"), F.col("size").alias("__cs"), "__n", "__part"), "cuts")
    n_twice = cuts.where("__n > 1").count()

    out = with_shard(rows, sources.select("source", "source_size", "target", "__rank", "__shards"))
    out = out.join(quotas, (F.col("__rank") == F.col("__r")) & (F.col("__shard") == F.col("__h")))
    out = out.join(broadcast_if_small(cuts, n_shards, BROADCAST_ROWS), (F.col("__rank") == F.col("__cr")) & (F.col("__shard") == F.col("__ch")), "left")
    whole = F.col("__passes") * F.col("size")
    here = (F.col("__key") == F.col("__ck")) & (F.col("size") == F.col("__cs"))
    ahead = (F.col("__key") < F.col("__ck")) | ((F.col("__key") == F.col("__ck")) & (F.col("size") < F.col("__cs")))
    head = F.when(F.coalesce(here, F.lit(False)), F.col("__part")).when(F.coalesce(ahead, F.lit(False)), F.col("size")).otherwise(0)
    columns = [c for c in rows.columns if c not in ("size", "__key")]
    if not n_twice:
        return out.withColumn("taken", (whole + head).cast("long")).select(*columns, *made)
    # Of rows that are alike where the stream is cut, the first ones are taken whole: only these rows are numbered.
    several = F.coalesce(here & (F.col("__n") > 1), F.lit(False))
    one = out.where(~several).withColumn("taken", (whole + head).cast("long"))
    number = F.row_number().over(Window.partitionBy("__r", "__h", "__key", "size").orderBy(F.lit(0))) - 1
    many = out.where(several).withColumn("__k", number).withColumn("taken", (whole + F.greatest(F.lit(0), F.least(F.col("size"), F.col("__part") - F.col("__k") * F.col("size")))).cast("long"))
    return one.select(*columns, *made).unionByName(many.select(*columns, *made))


#: The same in DuckDB, for default parameters.
SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('{SEED}|' || coalesce(doc_id::VARCHAR, md5(text), '-')) AS k FROM {{documents}}),
f AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][((r - 1) % {len(WEIGHTS)} + 1)::INT]::BIGINT AS w, source_size * {CAP} AS cap FROM f),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv FROM w WINDOW b AS (ORDER BY cap::DOUBLE / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT source, source_size, docs, r, cap, least(cap::DOUBLE, w * max(lv) OVER ()) AS target, (sum(source_size) OVER ())::BIGINT AS seats, count(*) OVER () AS np FROM v),
q AS (SELECT r, target / (2 * s + 1) AS quot, s, seats FROM a, unnest(range(0, least(cap, (CASE WHEN seats > 0 THEN floor(target * (seats + np + 2) / seats) ELSE 0 END + 2)::BIGINT))) u(s)),
g AS (SELECT r, count(*) AS n FROM (SELECT r FROM q WHERE quot > 0 QUALIFY row_number() OVER (ORDER BY quot DESC, r, s) <= seats) GROUP BY r),
s AS (SELECT a.*, coalesce(g.n, 0) AS quota, ceil(docs / {SHARD_DOCS})::BIGINT AS shards FROM a LEFT JOIN g USING (r)),
e AS (SELECT d.*, s.r, s.source_size, s.target, s.quota, (('0x' || substr(k, 1, 8))::BIGINT) % s.shards AS shard FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
h AS (SELECT r, shard, quota, sum(size)::BIGINT AS stream, shard // {GROUP_SHARDS} AS grp FROM e GROUP BY ALL),
ga AS (SELECT r, grp, quota, sum(stream)::BIGINT AS stream FROM h GROUP BY ALL),
gs AS (SELECT *, count(*) OVER (PARTITION BY r) AS np, sum(stream) OVER (PARTITION BY r) AS tot FROM ga),
gq AS (SELECT r, grp, stream / (2 * s + 1) AS quot, s, quota FROM gs, unnest(range(0, CASE WHEN tot > 0 THEN least(stream * {CAP}, floor(stream * (quota + np + 2) / tot) + 2)::BIGINT ELSE 0 END)) u(s)),
gg AS (SELECT r, grp, count(*) AS n FROM (SELECT r, grp FROM gq WHERE quot > 0 QUALIFY row_number() OVER (PARTITION BY r ORDER BY quot DESC, grp, s) <= quota) GROUP BY ALL),
hs AS (SELECT h.r, h.shard, h.grp, h.stream, coalesce(gg.n, 0) AS blocks, count(*) OVER (PARTITION BY h.r, h.grp) AS np, sum(stream) OVER (PARTITION BY h.r, h.grp) AS tot FROM h LEFT JOIN gg ON gg.r = h.r AND gg.grp = h.grp),
hq AS (SELECT r, shard, grp, stream / (2 * s + 1) AS quot, s, blocks FROM hs, unnest(range(0, CASE WHEN tot > 0 THEN least(stream * {CAP}, floor(stream * (blocks + np + 2) / tot) + 2)::BIGINT ELSE 0 END)) u(s)),
hg AS (SELECT r, shard, count(*) AS n FROM (SELECT r, shard FROM hq WHERE quot > 0 QUALIFY row_number() OVER (PARTITION BY r, grp ORDER BY quot DESC, shard, s) <= blocks) GROUP BY ALL),
p AS (SELECT h.r, h.shard, h.stream, coalesce(hg.n, 0) AS words, CASE WHEN stream > 0 THEN coalesce(hg.n, 0) // stream ELSE 0 END AS passes FROM h LEFT JOIN hg USING (r, shard)),
o AS (SELECT e.*, p.passes, p.words - p.passes * p.stream AS rest, sum(size) OVER (PARTITION BY r, shard ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM e JOIN p USING (r, shard))
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM o
"""
