import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import langid, queries


def test_held_out_accuracy(spark, sf):
    got = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) and (held.lang == held.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_odd_rows(spark, odd, sf):
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"), "text", "lang", "doc_id", F.lit(True))
    got = langid.identify(odd, "text", model).toPandas()
    assert len(got) == 14
    assert set(got[got.doc_id.isin([3, 4, 5, 10])].lang_pred) == {"und"}
    assert set(got[got.doc_id.isin([1, 2, 6])].lang_pred) == {"en"}


def test_empty_table_and_no_labels(odd, none):
    model = langid.fit(none, "text", "lang", "doc_id", F.lit(True))
    assert langid.identify(none, "text", model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, "text", model).collect()} == {"und"}


@pytest.mark.parametrize("languages", [3, 70])
def test_lookup_returns_all_languages(languages):
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**62, 300, dtype=np.uint64) for _ in range(languages)]
    model = langid.BitSlicedBloom.build([f"l{i:02d}" for i in range(languages)], [1] * languages, sets)
    for i in (0, languages - 1):
        mask = model.containing(sets[i])
        assert ((mask[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    fresh = model.containing(rng.integers(0, 2**62, 5000, dtype=np.uint64))
    rate = np.mean((fresh[0] & np.uint64(1)) > 0)
    assert rate <= 4 * max(model.false_rate[0], 1e-3)


def test_decision_against_brute_force():
    """The same filters asked one n-gram and one language at a time, false positives taken off as the definition says."""
    rng = np.random.default_rng(5)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "efghij"}
    text = lambda c, n: " ".join("".join(rng.choice(list(c), rng.integers(2, 6))) for _ in range(n))
    learned = {k: {g for _ in range(40) for h, _ in langid.grams([text(c, 12)], langid.ORDERS)[0] for g in h.tolist()} for k, c in letters.items()}
    model = langid.BitSlicedBloom.build(list(letters), [5, 9, 7], [np.array(sorted(v), np.uint64) for v in learned.values()])
    texts = [text("".join(rng.choice(list(letters.values()), 2)), 6) for _ in range(60)] + ["", None, "123 !", "zzz xxx"]
    names, scores = model.decide(texts, langid.ORDERS)
    slots, size = model.slots, model.slots.shape[1]
    for t, name, score in zip(texts, names, scores):
        hits = dict.fromkeys(letters, 0.0)
        for h, _ in langid.grams([t], langid.ORDERS)[0]:
            for i, k in enumerate(letters):
                held = 0
                for g in h.tolist():
                    places = [(g + p * ((g >> 32) | 1)) % 2**64 % size for p in range(model.probes)]
                    held += all(int(slots[0, x]) >> i & 1 for x in places)
                rate = model.false_rate[i]
                hits[k] += max(0.0, held - len(h) * rate) / (1 - rate)
        best = max(sorted(letters, key=lambda k: (-[5, 9, 7][list(letters).index(k)], k)), key=lambda k: hits[k])
        lettered = any(ch.isalpha() for ch in t or "")
        assert name == (best if lettered else "und")
        assert abs(score - (hits[best] / sum(hits.values()) if lettered and sum(hits.values()) else 0.0)) < 1e-9
    for i, k in enumerate(letters):
        outside = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
        share = np.mean(model.containing(outside)[0] >> np.uint64(i) & np.uint64(1))
        assert abs(share - model.false_rate[i]) < 0.01


def test_clashing_names(spark, odd, sf):
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"), "text", "lang", "doc_id", F.lit(True))
    got = langid.identify(odd.withColumnRenamed("lang", "score").withColumnRenamed("source", "lang_pred"), "text", model)
    assert got.columns == ["doc_id", "text", "n_chars", "lang_pred", "score"] and got.count() == 14


def test_marks_alone_are_no_letters():
    assert langid.grams(["\u0301 \u0300", "e\u0301", "1 \u0903", None], (2,))[1].tolist() == [False, True, False, False]
