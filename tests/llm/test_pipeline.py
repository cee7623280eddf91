"""The pipeline against its stages by brute force, one after the other."""

import random

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F
from tests.llm.test_decontaminate import brute as overlaps
from tests.llm.test_line_dedup import brute as lines_left
from tests.llm.test_ngram_join import brute as groups
from tidemark.llm import language_id, mixing
from tidemark.llm.line_dedup import MIN_WORDS

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0):
    rng = random.Random(seed)
    words = {"en": "the and with thing other wording house river stone".split(), "de": "der und nicht schön über haus fluss stein".split()}
    passages = [" ".join(rng.choice(words["en"]) + str(rng.randrange(9)) for _ in range(60)) for _ in range(3)]
    items = [(k, " ".join(f"item{k}x{j}" for j in range(16))) for k in range(6)]
    docs = []
    for k in range(160):
        lang = rng.choice(["en", "en", "de"])
        lines = [" ".join(f"{rng.choice(words[lang])}{rng.choice(['', '', 'en', 'er'])}" for _ in range(rng.randint(4, 25))) for _ in range(rng.randint(1, 8))]
        text = "\n".join(lines)
        kind = rng.randrange(10)
        if kind == 0 and docs:
            text = rng.choice(docs)[1]
        elif kind == 1 and docs:
            x = rng.choice(docs)[1].split(" ")
            x[rng.randrange(len(x))] = "changed"
            text = " ".join(x)
        elif kind == 2:
            text = f"{text}\n{rng.choice(passages)}\n{text.split()[0]} tail"
        elif kind == 3:
            text = f"{text} {rng.choice(items)[1].upper()} {lines[0]}"
        elif kind == 4:
            text = rng.choice(["", "12 34 !!", "zqxj kvwq" * 60])
        docs.append((k, text, lang, f"s{rng.choice([0, 0, 0, 1, 2])}", len(text)))
    return docs, items


def test_against_brute_force(spark, tmp_path):
    docs, items = corpus()
    df = spark.createDataFrame(docs, COLUMNS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    model = language_id.train(df)
    _, _, rejected = model.predict([d[1] for d in docs])
    left = [d for d, no in zip(docs, rejected, strict=True) if not no]
    assert 0 < len(docs) - len(left) < 30
    texts = dict(lines_left([(d[0], d[1]) for d in left], MIN_WORDS))
    shorter = sum(texts[d[0]] != d[1] for d in left)
    left = [(d[0], texts[d[0]], *d[2:]) for d in left if texts[d[0]].split() or not d[1].split()]
    first = {d: c for d, _, c in groups([(d[0], d[1]) for d in left])}
    near = sum(first[d[0]] != d[0] for d in left)
    left = [d for d in left if first[d[0]] == d[0]]
    bad = {d for d, _ in overlaps([(d[0], d[1]) for d in left], items)}
    left = [d for d in left if d[0] not in bad]
    assert shorter and near and bad
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(d[0], d[1], d[3]) for d in left])
    want = {r[0]: r[1:] for r in con.execute(mixing.SQL.format(documents="documents")).fetchall() if r[4]}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {d[0]: d for d in left}
    assert {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in got} == want and len(got) == len(want)
    assert all(r.text == kept[r.doc_id][1] and r.source == kept[r.doc_id][3] and r.n_chars == len(r.text) for r in got)


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "a", 0, "x"), (1, "", "en", "a", 0, "x"), (2, "the and " * 30000, "en", None, 9, "x"), (3, "the and with", "en", "a", 12, None)]
    df = spark.createDataFrame(rows, COLUMNS + ", comp string")
    spark.createDataFrame([(1, "q w e r t y u i o p a s d f g"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for given in (df, df.limit(0)):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == df.columns
        assert docs.where(F.col("taken") > 0).count() == docs.count() == (2 if given is df else 0)


def test_mix_keeps_small_sources_of_large_tables(spark):
    docs = [(k, "w " * 400, "en", "big", 800) for k in range(30)] + [(100, "w " * 90, "en", "small", 180)]
    got = corpus_pipeline.mix(spark, spark.createDataFrame(docs, COLUMNS), "").collect()
    (small,) = (r for r in got if r.source == "small")
    assert small.target == 270 and abs(small.taken - small.target) <= 1
    assert sum(r.taken for r in got) == 30 * 400 + 90
