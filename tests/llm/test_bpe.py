import hashlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import bpe

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODER = bpe.Coder(bpe.load(PATH))
ALPHABET = list("aabcdeeiinorsttthhe  .,!?<|>_12\n\tÀéßΣσñİŁ—你好한яЖ") + ["́", "‍", "\x1c", "\x85", "\U0001f600", "ﬁ", "½", "²", "ª", "<|endoftext|>", "<|startoftext|>", "'ll", "'S"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join), min_size=1, max_size=4))
def test_same_as_the_library(texts):
    ids, decoded = CODER.encode(texts)
    for t, i, d in zip(texts, ids, decoded):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(i, "<u4").tolist() == want
        assert d == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=12))
def test_any_unicode(text):
    ids, _ = CODER.encode([text])
    assert np.frombuffer(ids[0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_pair_test_agrees_with_merging():
    m = CODER.merges
    rng = np.random.default_rng(3)
    plain = np.array([i for t, i in m.vocab.items() if not t.endswith("</w>")])
    a, b = rng.choice(plain, 3000), rng.choice(len(m.rank), 3000)
    got = m.compatible(a, b)
    names = {i: t for t, i in m.vocab.items()}
    for x, y, ok in zip(a, b, got):
        word, ends = names[x] + names[y].removesuffix("</w>"), names[y].endswith("</w>")
        assert ok == (m.exact(word, ends) == [x, y])


def test_long_words_use_the_heap(monkeypatch):
    word = "abcab" * 60
    slow = CODER.merges.exact(word)
    monkeypatch.setattr(bpe, "SHORT", 10_000)
    assert CODER.merges.exact(word) == slow


def test_odd_rows_and_forgetting(odd, none, monkeypatch):
    got = {(r["doc_id"], r["text"]): r for r in bpe.encode(odd, "text", PATH).select("*", F.sha2("ids", 256).alias("sha")).collect()}
    for (_, t), r in got.items():
        want = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert r["sha"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded"] == LIBRARY.decode(want, skip_special_tokens=False)
    assert bpe.encode(none, "text", PATH).count() == 0
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    coder = bpe.Coder(bpe.load(PATH))
    for _ in range(3):
        assert coder.encode(["one two three four five six", "seven"])[0] == CODER.encode(["one two three four five six", "seven"])[0]


def test_clashing_names(odd):
    got = bpe.encode(odd.withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded"), "text", PATH)
    assert got.columns == ["doc_id", "text", "n_chars", "ids", "decoded"] and got.count() == 14
