import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import gated_lm as G


@pytest.mark.parametrize("head", [3, 1 << 16])
def test_unigram_score_is_exact(spark, odd, monkeypatch, head):
    monkeypatch.setattr(G, "HEAD", head)
    rows = odd.select("doc_id", "text").collect()
    held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    words = [(r["text"] or "").encode().lower().split() for r in rows]
    count, ends = Counter(), 0
    for h, w in zip(held, words):
        if not h:
            count.update(w)
            ends += 1
    total, distinct = sum(count.values()) + ends, len(count) + 1
    whole = math.log10(total + distinct + 1)
    want = sorted(
        (-1 if r["doc_id"] is None else r["doc_id"], h, len(w) + 1, sum(count[x] > 0 for x in w) + 1, total, round(sum(math.log10(count[x] + 1) for x in w) + math.log10(ends + 1) - (len(w) + 1) * whole, 4))
        for r, h, w in zip(rows, held, words)
    )
    got = G.score(odd).toPandas()
    assert (got.score < 0).all()
    assert sorted((-1 if r.doc_id != r.doc_id else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got.itertuples()) == want


def test_empty_table(none):
    assert G.score(none).count() == 0


def test_network_is_a_distribution():
    net = G.Network.fresh(100)
    h = np.random.default_rng(1).standard_normal((3, G.HIDDEN)).astype(np.float32)
    total = sum(np.exp(net.log_prob(h, np.full(3, t))) for t in range(G.CLASSES * G.PER_CLASS))
    assert np.allclose(total, 1, atol=1e-3)


def test_state_is_carried_across_windows(monkeypatch):
    net = G.Network.fresh(50)
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(2, 50, n), 0) for n in (0, 1, 7, 100, 23, 24, 25)]
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    a = net.score(np.concatenate(docs), at, 0)
    monkeypatch.setattr(G, "WINDOW", 5)
    monkeypatch.setattr(G, "STREAMS", 2)
    assert np.allclose(a, net.score(np.concatenate(docs), at, 0), rtol=1e-5)
    alone = [net.score(d, np.array([0, len(d)]), 0)[0] for d in docs]
    assert np.allclose(a, alone, rtol=1e-5)


def test_training_lowers_the_loss():
    """Training lowers the loss of a repeating text far below that of a fresh network."""
    doc = np.append(np.tile([2, 3, 4, 5], 200), 0)
    at = np.array([0, len(doc)])
    net = G.Network.fresh(6)
    before = net.score(doc, at, 0)[0]
    net.train([doc] * 8, 0, epochs=6)
    assert net.score(doc, at, 0)[0] > 0.2 * before


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(4)
    net = G.Network.fresh(200)
    net.weights = {n: v.astype(np.float64) for n, v in net.weights.items()}
    x = rng.integers(0, 200, (7, 3))
    x[3, 1] = 0  # a document begins here
    y = rng.integers(0, 200, (7, 3))
    state = rng.standard_normal((3, G.HIDDEN))
    g, loss, _ = net.gradients(x, y, state, 0)
    used = {"emb": (int(x[0, 0]), 5), "wo": (int(y[1, 1]) // G.PER_CLASS, 4, int(y[1, 1]) % G.PER_CLASS), "bo": (int(y[2, 0]) // G.PER_CLASS, int(y[2, 0]) % G.PER_CLASS), "wc": (3, 1), "bc": (2,), "wx": (3, 70), "wh": (6, 40), "b": (9,)}
    for name, at in used.items():
        for place in (at, tuple(rng.integers(0, n) for n in net.weights[name].shape)):
            keep = net.weights[name][place]
            net.weights[name][place] = keep + 1e-5
            up = net.gradients(x, y, state, 0)[1]
            net.weights[name][place] = keep - 1e-5
            down = net.gradients(x, y, state, 0)[1]
            net.weights[name][place] = keep
            assert abs((up - down) / 2e-5 - g[name][place]) < 1e-6, (name, place)


def test_an_epoch_that_gains_nothing_is_undone():
    net = G.Network.fresh(6)
    start = net.flat().copy()
    net.train([np.array([2, 3, 0])] * 40, 0, epochs=3, good=lambda: -np.inf)
    assert (net.flat() == start).all()
    net.unflat(start * 2)
    assert np.allclose(net.flat(), start * 2)


def test_mixture_is_a_distribution_and_no_worse_than_its_parts():
    rng = np.random.default_rng(3)
    counts = np.sort(rng.integers(2, 90, 50))[::-1]
    model = G.vocabulary(rng.integers(1, 2**63, 50, dtype=np.uint64), counts, int(counts.sum()) + 30, 12)
    assert abs(model.usual.sum() - 1) < 1e-6
    docs = [np.append(rng.integers(2, 52, 40), 0) for _ in range(20)]
    mixed = model.balance(docs)
    token, p = model.network.each(docs, 0)
    assert mixed >= np.log(model.usual[token]).mean() - 0.02 and mixed >= np.log(p).mean() - 0.02
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    assert np.isclose(model.network.score(np.concatenate(docs), at, 0, model.usual, model.weight).sum() * G.LOG10 / at[-1], mixed)


def test_copies_are_averaged_by_tokens(spark, monkeypatch):
    texts = [f"a{i % 7} b{i % 5} c" * (1 + i % 4) for i in range(60)]
    model = G.vocabulary(np.arange(1, 9, dtype=np.uint64), np.full(8, 9), 100, 60)
    monkeypatch.setattr(G, "GROUP_DOCS", 20)
    start = model.network.flat().copy()
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    copies, sizes = [], []
    rows = [r["text"] for r in df.collect()]
    import pyarrow as pa

    for i in range(0, 60, 20):
        docs = model.documents(pa.array(rows[i : i + 20], pa.string()))
        net = G.Network(model.network.size, {n: v.copy() for n, v in model.network.weights.items()})
        net.train(docs, 0, epochs=1, rate=1e-3)
        copies.append(net.flat().astype(float))
        sizes.append(sum(map(len, docs)))
    G.refine(model, df, [])
    want = sum(c * n for c, n in zip(copies, sizes)) / sum(sizes)
    assert np.allclose(model.network.flat(), want, atol=1e-6) and not np.allclose(want, start)


def test_speller_is_a_distribution():
    s = G.Speller([b"abc", b"abd", b"\xc3\xa9"], [3, 1, 1])
    raw = np.arange(256, dtype=np.uint8)
    ones = s.score(raw, np.arange(256), np.arange(1, 257))
    pairs = np.array([[a, b] for a in range(256) for b in range(256)], np.uint8).ravel()
    twos = s.score(pairs, np.arange(0, len(pairs), 2), np.arange(2, len(pairs) + 1, 2))
    assert 0 < (10**ones).sum() + (10**twos).sum() <= 1.01
    assert s.score(raw[:0], np.array([0]), np.array([0]))[0] < 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_better_than_unigram_on_held_out_text(spark, sf):
    import os

    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    got = G.score(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert (held.score > held.base_score).mean() > 0.9
    assert got[~got.held_out].score.sum() > got[~got.held_out].base_score.sum()


def test_unseen_words_have_the_mean_of_their_spelling_and_of_one_count(spark):
    """One held-out document of one new word: of two spellings the likelier scores more, and neither falls below half of a count's share."""
    from quillon.llm.common import remainder

    ids = [r[0] for r in spark.range(400).filter(remainder(F.col("id"), 7) == 2).limit(2).collect()]
    texts = [(i, " ".join(f"ab{chr(97 + (i * k) % 20)}{chr(97 + k)}" for k in range(20))) for i in range(400) if i not in ids]
    df = spark.createDataFrame([*texts, (ids[0], "abcdx"), (ids[1], "\U0001f600" * 30)], "doc_id long, text string")
    got = {r.doc_id: r for r in G.score(df).filter("held_out").collect()}
    near, far = got[ids[0]], got[ids[1]]
    assert near.n_known == far.n_known == 1 and near.score > far.score > near.base_score - 12


def test_columns_of_any_name(spark, odd):
    clash = odd.withColumnRenamed("lang", "score").withColumnRenamed("source", "trains")
    assert G.score(clash).count() == odd.count()


def test_every_training_document_trains(spark, monkeypatch):
    rows = [(i, f"text {i} of a few words") for i in range(300)]
    seen, fit = [], G.fit
    monkeypatch.setattr(G, "fit", lambda model, docs: seen.extend(docs) or fit(model, docs))
    monkeypatch.setattr(G, "refine", lambda model, texts, held: seen.extend(r["text"] for r in texts.collect()))
    scored = G.score(spark.createDataFrame(rows, "doc_id long, text string"), sample_docs=40)
    assert len(seen) == scored.filter("not held_out").count()
