import random

import pytest
from tidemark.llm import warc


def expected(rows, least=0):
    best = {}
    for p, _, h in rows:
        if p is not None:
            best[h or ""] = max(p, best.get(h or "", p))
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        top = best.get(h or "")
        revisit = len(body) >= least and top is not None and (p is None or p < top)
        out.append((p, len(body), warc.digest(body), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


FAKE = warc.record(99, "http://fake", b"inner", None).decode()
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("block", [200, 5000, 1 << 22])
def test_round_trip(spark, compress, block):
    rng = random.Random(1)
    bodies = ["", "x", "é\r\n\r\nWARC/1.1\r\n", FAKE, FAKE * 3 + "tail", "a" + FAKE, "WARC/1.0\r\nContent-Length: 5\r\n\r\n", "long " * 3000]
    rows = [(k, f"http://h/{k}", rng.choice(bodies) + (str(k) if rng.random() < 0.4 else "")) for k in range(60)]
    rows += [(None, None, "x"), (None, "u\r\nX-Page-ID: 5", "only"), (70, "http://h", None), (70, "http://h", None)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, offset string").repartition(3)
    got = warc.archive_pages(df, compress=compress, block_bytes=block).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_least_size_and_empty(spark):
    rows = [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive_pages(df, min_bytes=5).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows, 5)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_damage_ends_the_chain(spark, tmp_path):
    good = [warc.record(k, "u", b"p" * k, None) for k in range(5)]
    (tmp_path / "a.warc").write_bytes(good[0] + good[1] + b"junk" + good[2] + good[3])
    (tmp_path / "b.warc").write_bytes(b"".join(good)[:-3])
    got = warc.read_archives(spark, f"file://{tmp_path}", block_bytes=64).collect()
    assert sorted((r.file, r.page_id) for r in got) == [("a.warc", 0), ("a.warc", 1), *(("b.warc", k) for k in range(4))]


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("block", [5000, 1 << 22])
def test_long_urls(spark, compress, block):
    rows = [(k, f"http://h/{k}" + "x" * (300_000 if k in (2, 5) else 0), f"WARC/1.1 body {k}") for k in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    got = warc.archive_pages(df, compress=compress, block_bytes=block)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=str) == expected(rows)
    assert {r.page_id: r.url for r in got.collect()} == {p: u for p, u, _ in rows}


def test_hot_payloads_by_shuffle(spark, monkeypatch):
    """The way for more repeated payloads than are broadcast; a third of all pages is empty, one url has 5 MB."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(k, "u" * (5 << 20) if k == 7 else f"http://h/{k}", ["", "same", f"own {k}"][k % 3]) for k in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.archive_pages(df, block_bytes=100_000).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_all_of_bigint(spark):
    ids = [2**63 - 1, -(2**63), 10**18, -(10**18), 10**18 - 1, 0]
    rows = [(p, "u", "same" if k < 2 else f"body {k}") for k, p in enumerate(ids)] + [(-(2**63) + 1, "u", "low"), (-(2**63), "u", "low"), (None, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, warc.archive_pages(df).select(COLUMNS).collect()), key=str) == expected(rows)
    assert warc.described({b"x-page-id": b"9223372036854775808"}, b"")[1] is None
