import random

import pyarrow as pa
import pytest
from tidemark import scratch
from tidemark.llm import common
from tidemark.llm import line_dedup as module
from tidemark.llm.line_dedup import line_dedup


def brute(docs, least):
    """Every run of lines of `least` words that stands earlier, by comparing all runs."""
    seen, out = {}, []
    rows = [(d, [tuple(x.split()) for x in t.split("\n")]) for d, t in docs]
    runs = []
    for d, lines in rows:
        full = [k for k, x in enumerate(lines) if x]
        for a in range(len(full)):
            words = 0
            for b in range(a, len(full)):
                words += len(lines[full[b]])
                if words >= least:
                    run = tuple(lines[k] for k in full[a : b + 1])
                    runs.append((run, d, a, full[a], full[b]))
                    seen[run] = min(seen.get(run, (d, a)), (d, a))
    gone = {}
    for run, d, a, first, last in runs:
        if (d, a) > seen[run]:
            gone.setdefault(d, set()).update(k for k in range(first, last + 1) if dict(rows)[d][k])
    for d, lines in rows:
        full = [k for k, x in enumerate(lines) if x]
        for a, b in zip(full, full[1:]):
            if a in gone.get(d, ()) and b in gone[d]:
                gone[d].update(range(a, b))
    for d, t in docs:
        out.append((d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ()))))
    return out


@pytest.mark.parametrize("limit", [200_000, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    for name in ("BROADCAST_KEYS", "BROADCAST_RUNS"):
        monkeypatch.setattr(module, name, limit)
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 5, 9]))) for _ in range(25)] + [""]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 25)))) for k in range(120)]
    docs += [(200 + k, docs[k][1]) for k in range(10)]
    for least, gram in ((10, 5), (6, 6), (12, 3)):
        got = line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_words=least, gram_words=gram)
        assert sorted(map(tuple, got.collect())) == sorted(brute(docs, least))


def test_edges(spark):
    long_line = " ".join(f"w{k}" for k in range(60))
    docs = [(None, long_line, "x", 1), (1, long_line, "y", 2), (2, None, None, 3), (3, "", "z", 4), (3, "", "z", 4), (4, f"a\n{long_line}\nb", None, 5), (5, "b\n" + "c d\n" * 50000, "q", 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, hash string, __runs int")
    rows = line_dedup(df, count="gone").collect()
    got = {(r.doc_id, r.hash): (r.text, r.gone) for r in rows}
    assert len(rows) == len(docs)
    assert got[None, "x"] == (long_line, 0) and got[1, "y"] == ("", 1) and got[2, None] == (None, 0) and got[3, "z"] == ("", 0)
    assert got[4, None] == ("a\nb", 1)
    assert len(got[5, "q"][0].split("\n")) < 60
    assert {r.doc_id for r in line_dedup(df, drop_emptied=True).collect()} == {None, 2, 3, 4, 5}
    assert line_dedup(df.limit(0)).count() == 0


def test_tasks_write_large_tables_themselves(spark, monkeypatch):
    """Line tables and segments go to local folders without Hadoop, which starts a process for each file."""
    written = []
    for place in (module, common):
        monkeypatch.setattr(place, "cut", lambda df, name, rows=None: written.append(name) or scratch.cut(df, name, rows))
    run = "\n".join(f"w{k} x{k} y{k}" for k in range(30))
    df = spark.createDataFrame([(1, run), (2, f"z\n{run}"), (3, None)], "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in line_dedup(df).collect()} == {1: run, 2: "z", 3: None}
    assert written and not {"lines", "segments"} & set(written)


def test_cut_arrow(spark, monkeypatch):
    """Same rows as by Spark's writer, in several row groups; nothing of a failed attempt is read."""
    monkeypatch.setattr(common, "GROUP_BYTES", 1000)
    df = spark.range(0, 3000, 1, 5)

    def lists(batches):
        for b in batches:
            n = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), common.list_array(n.repeat(n % 3), n % 3, pa.int64()), pa.array([None if k % 7 == 0 else str(k) for k in n])], names=["id", "many", "t"])

    schema = "id long, many array<long>, t string"
    got = common.cut_arrow(df, lists, schema, "x")
    common.open_fs(got._tidemark_at)[0].copy_file(*(common.open_fs(got._tidemark_at)[1] + "/" + x for x in ("part-00001.parquet", "_left")))
    assert sorted(map(str, got.collect())) == sorted(map(str, df.mapInArrow(lists, schema).collect()))
    assert sorted(map(str, spark.read.parquet(got._tidemark_at).collect())) == sorted(map(str, got.collect()))
    assert common.cut_arrow(df.limit(0), lists, schema, "x").count() == 0
