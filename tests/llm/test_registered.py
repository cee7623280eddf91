"""The registered queries themselves, on the smallest tables: contracts, and SQL where there is some."""

import zlib

import duckdb
import numpy as np
import pytest
from tidemark.llm import queries

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(con, sql):
    return con.execute(sql).fetchall()


def remainder(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, con, name):
    got = queries.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    cursor = con.execute(queries.ORACLES[name])
    at = {c[0]: k for k, c in enumerate(cursor.description)}
    text = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    assert sorted(at) == names
    assert sorted(tuple(text(r[c]) for c in names) for r in got.collect()) == sorted(tuple(text(r[at[c]]) for c in names) for r in cursor.fetchall())


def test_language(spark, con):
    docs = {d: lang for d, lang in rows(con, "SELECT doc_id, lang FROM documents")}
    got = queries.op1_language_id(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs) and all(r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    known = [r for r in got if r.held_out and docs[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id] for r in known) >= 0.95 * len(known) > 0


def test_contamination_names_rows(spark, con):
    got = queries.op2_decontaminate(spark, DATA).collect()
    assert {r.item_id for r in got} <= {x for (x,) in rows(con, "SELECT item_id FROM benchmark")} and all(r.overlap >= 13 for r in got)


def test_toxicity(spark, con):
    docs = [d for (d,) in rows(con, "SELECT doc_id FROM documents")]
    got = queries.op3_toxicity(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (remainder(r.doc_id, 3) == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_line_dedup(spark, con):
    docs = dict(rows(con, "SELECT doc_id, text FROM documents"))
    got = queries.op4_line_dedup(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all((r.text == docs[r.doc_id]) == (r.lines_removed == 0) or r.text is None for r in got)


def test_token_counts(spark, con):
    assert sorted(r.doc_id for r in queries.op6_token_counts(spark, DATA).collect()) == sorted(d for (d,) in rows(con, "SELECT doc_id FROM documents"))


def test_neighbours(spark, con):
    v = {i: np.array(x) for i, x in rows(con, "SELECT vec_id, embedding FROM embeddings") if x is not None and all(c is not None and np.isfinite(c) for c in x) and any(x)}
    got = {}
    for r in queries.op7_permutation_index(spark, DATA).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in v if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        assert [r for r, *_ in sorted(found)] == list(range(1, 21)) and all(s == pytest.approx(v[q] @ v[i], abs=1e-9) for _, i, s in found)
        best = sorted(v, key=lambda i: (-(v[q] @ v[i]), i))
        hits += len({i for _, i, _ in found} & set([i for i in best if i != q][:20]))
    assert hits >= 0.9 * 20 * len(got)


def test_language_model(spark, con):
    docs = [d for (d,) in rows(con, "SELECT doc_id FROM documents")]
    got = queries.op9_maxent_lm(spark, DATA).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs) and all(r.held_out == (remainder(r.doc_id, 10) == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert all(0 <= r.n_known <= r.n_tokens for r in got) and sum(r.score for r in held) > sum(r.base_score for r in held)
