import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, least=3, most=200):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = TERM.findall(low(text))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    share = lambda c, whole: 1 + 10**9 * (c + 1) // whole
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: c for (g, s), c in counts.items() if g == lang}
        whole = {s: sum(c[t] for t in kept) + len(kept) for s, c in own.items()}
        total = Counter({t: sum(c[t] for c in own.values()) for t in kept})
        all_ = sum(total.values()) + len(kept)
        for a in own:
            pairs = [(b, sum((share(own[a][t], whole[a]) - share(own[b][t], whole[b])) ** 2 // share(own[b][t], whole[b]) for t in kept)) for b in own if b != a]
            over = [(t, share(own[a][t], whole[a]), share(total[t], all_)) for t in kept if own[a][t]]
            words = [(t, (p - q) ** 2 // q) for t, p, q in over if p > q]
            for part, found, end in (("pair", pairs, None), ("term", words, most)):
                for r, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:end]):
                    out.append((lang, a, part, item, value, r + 1))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_odd_rows(odd, odd_rows):
    assert got(divergence.audit(odd, least_docs=2)) == brute([(r[1], r[2], r[3]) for r in odd_rows], least=2)


def test_groups_without_terms(spark):
    rows = [(None, None, None), ("", "", "b"), ("1 2 3", "", ""), ("a a a", "xx", "s"), (None, "xx", "t")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    want = brute(rows)
    assert got(divergence.audit(df)) == want and {r[4] for r in want} == {0}


@pytest.mark.parametrize(("finish", "most"), [(4096, 7), (2, 7), (1, 1), (3, 200)])
def test_ranks_with_many_ties(spark, monkeypatch, finish, most):
    """Small buckets force every round: bits of the values, then bytes of the items."""
    monkeypatch.setattr(divergence, "FINISH", finish)
    rng = np.random.default_rng(5)
    words = ["w" + "ab"[i % 2] * (i % 9) + str(i) for i in range(80)] + ["é" * 9, "ü", "z" * 40, "z" * 41]
    rows = [(g, int(v), w) for g in range(4) for w, v in zip(words, rng.choice([0, 5, 5, 5, 1 << 40, (1 << 62) + 3], len(words)))] + [(9, 7, "only")]
    df = spark.createDataFrame(rows, "g long, v long, w string").repartition(3)
    want = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:most]
        want += [(*r, k + 1) for k, r in enumerate(own)]
    assert got(divergence.top_by_radix(df, "g", "v", "w", most)) == sorted(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**14), st.integers(1, 10**14)), min_size=1, max_size=20))
def test_shares_do_not_overflow(pairs):
    pairs = [(min(a, b), max(a, b) + 1) for a, b in pairs]
    count, whole = (np.array(x, dtype=np.int64) for x in zip(*pairs))
    assert divergence.shares(count, whole).tolist() == [1 + 10**9 * (c + 1) // w for c, w in pairs]


def test_column_shares(spark):
    pairs = [(0, 1), (7, 9), (10**14, 10**15 + 7), (123456789, 10**12 + 1)]
    df = spark.createDataFrame(pairs, "c long, w long").select("c", "w", divergence.share(F.col("c"), F.col("w")).alias("p"))
    assert {tuple(r) for r in df.collect()} == {(c, w, 1 + 10**9 * (c + 1) // w) for c, w in pairs}


def test_flushed_counts_and_many_pairs(spark, odd, odd_rows, monkeypatch):
    rows = [(" ".join(f"t{'x' * (k % 7)}{chr(97 + (i * k) % 26)}" for k in range(40)), "en", f"s{i % 12}") for i in range(60)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(2)
    monkeypatch.setattr(divergence, "PAIRS", 50)
    monkeypatch.setattr(divergence, "HELD", 40)
    assert got(divergence.audit(df)) == brute(rows)


def test_empty_and_clashing_columns(odd, odd_rows, none):
    assert divergence.audit(none).count() == 0
    clash = odd.toDF("value", "term", "n", "docs", "total")
    assert got(divergence.audit(clash, "term", "n", "docs", least_docs=2)) == brute([(r[1], r[2], r[3]) for r in odd_rows], least=2)
