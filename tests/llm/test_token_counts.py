import os
import random

import numpy as np
import pytest
from tidemark.llm import token_counts as tc

needs_files = pytest.mark.skipif(not os.path.exists(tc.TOKENIZER), reason="needs the public tokenizer files")


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("separator", [9, 70000])
def test_scan_against_a_loop(spark, tmp_path, block, separator):
    rng, want = random.Random(block), set()
    for f in range(4):
        docs = [[rng.randrange(5) for _ in range(rng.choice([0, 0, 1, 4, 20]))] for _ in range(rng.choice([0, 1, 6]))]
        ids = [x for d in docs for x in (*d, separator)]
        at = 0
        for k, d in enumerate(docs):
            want.add((f"{f}.tok", k, at, len(d), True))
            at += len(d) + 1
        if f == 2:
            ids += [1, 2, 3]
            want.add(("2.tok", len(docs), at, 3, False))
        (tmp_path / f"{f}.tok").write_bytes(np.array(ids, "<u2" if separator < 1 << 16 else "<u4").tobytes() + b"x" * (f == 3))
    got = tc.scan(spark, f"file://{tmp_path}", separator=separator, block_tokens=block).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_no_files(spark, tmp_path):
    assert tc.scan(spark, str(tmp_path / "none")).count() == 0


@needs_files
def test_counts_match_the_encoder(spark):
    docs = [(1, "The end. <|endoftext|> été 你好 \U0001f600"), (2, None), (3, ""), (None, "a  b"), (3, "x " * 50000), (3, "x " * 50000)]
    df = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, file string").repartition(3)
    enc = tc.encoding(tc.TOKENIZER)
    got = tc.token_counts(df, block_tokens=5000).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((d, len(enc.encode_ordinary(t or ""))) for d, t in docs), key=str)
    assert tc.token_counts(df.limit(0)).count() == 0
