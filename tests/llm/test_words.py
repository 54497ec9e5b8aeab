"""The word scanner against Python's own splitting."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.words import chunks, ngrams

TEXT = st.text(alphabet=st.sampled_from(list("aAbB \n\t\x0b.é你\U0001f600")), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.sampled_from([1, 8, 1 << 20]))
def test_words_are_those_of_split(texts, size):
    seen, by_hash = [], {}
    for c in chunks(pa.array(texts, pa.string()), fold=True, chunk_bytes=size):
        ends = c.ends()
        assert len(ends) == len(c.starts)
        for i in range(c.last - c.first):
            words = [c.raw[s:e].tobytes().lower() for s, e in zip(c.starts[c.doc_at[i] : c.doc_at[i + 1]], ends[c.doc_at[i] : c.doc_at[i + 1]])]
            seen.append(words)
            for w, h in zip(words, c.row(i).tolist()):
                assert by_hash.setdefault(w, h) == h
    assert seen == [(t or "").encode().lower().split() for t in texts]
    assert len(set(by_hash.values())) == len(by_hash)


def test_slices_of_a_column():
    column = pa.array(["x", "a b", None, "c"]).slice(1, 2)
    assert [len(c.row(i)) for c in chunks(column) for i in range(c.last - c.first)] == [2, 0]


def test_order_matters_in_ngrams():
    h = np.arange(1, 7, dtype=np.uint64)
    assert len(set(ngrams(h, 3).tolist()) | set(ngrams(h[::-1].copy(), 3).tolist())) == 8
    assert len(ngrams(h, 7)) == 0
