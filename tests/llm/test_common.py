import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm.common import Words, chunks, gram_hashes, shingle_sets, text_bytes, word_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é\t\n\x0b\x0d\x1c 你.", max_size=40)), max_size=8)


def low(word):
    return re.sub("[A-Z]", lambda m: m[0].lower(), word)


@settings(deadline=None, max_examples=80)
@given(TEXTS, st.integers(1, 60))
def test_words_of_texts(texts, limit):
    column = pa.array(["pad", *texts], pa.string()).slice(1)
    got = []
    for i, j in chunks(column, limit):
        raw, borders = text_bytes(column.slice(i, j - i))
        w = Words(raw, borders)
        for a, b in zip(w.first[:-1], w.first[1:]):
            got.append([(bytes(raw[s:e]).decode(), int(h)) for s, e, h in zip(w.start[a:b], w.end[a:b], w.hash[a:b])])
    assert got == [[(x, word_hash(low(x))) for x in WORD.findall(t or "")] for t in texts]


def test_shingles():
    texts = ["a b c d e f", "A b C d e F", "a b c", "", None, "a b c d e a b c d e"]
    raw, borders = text_bytes(pa.array(texts))
    sets = [set(u.tolist()) for u in shingle_sets(Words(raw, borders))]
    assert [len(x) for x in sets] == [2, 2, 1, 0, 0, 5] and sets[0] == sets[1] and len(sets[0] & sets[5]) == 1
    h = np.arange(7, dtype=np.uint64)
    assert len(gram_hashes(h, 8)) == 0 and len(set(gram_hashes(h, 3).tolist())) == 5
