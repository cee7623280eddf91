"""Every query against its SQL on the same tables, as rows without order."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    text = lambda x: "null" if x is None else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(text(r[k]) for k in order) for r in rows), [names[k] for k in order]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, DATA)
    rows, names = canonical([tuple(r) for r in got.collect()], got.columns)
    assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        cursor = con.execute(ORACLES[name])
        want = cursor.fetchall()
        assert (rows, names) == canonical(want, [c[0] for c in cursor.description])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
