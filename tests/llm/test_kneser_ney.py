import numpy as np
import pytest

from quillon.llm import kneser_ney as K


@pytest.fixture(scope="module")
def model(spark):
    return K.train(spark.createDataFrame([("the cat sat on the mat then the cat ran",), ("a dog ran at the cat",), (None,), ("",)], "text string"))


def test_probabilities_sum_to_one(model):
    """Over all continuations of a context, the unseen symbols included."""
    symbols = [K.OTHER, K.END, *model.index.values()]
    for start in ("", "th", "cat", "q"):
        total = 0.0
        for s in symbols:
            code, word = K.codes_of([start], model.index)
            code = np.append(code[:-1], s)
            grams = K.windows(code, np.zeros(len(code), np.int64))
            p, done = 0.0, False
            for n in range(min(K.ORDER, len(code)), 0, -1):
                gram = grams[n - 1][1][-1:]
                found, v = K._look(model.grams[n - 1], model.logp[n - 1], gram)
                if found[0]:
                    p, done = p + v[0], True
                    break
                if n > 1:
                    known, w = K._look(model.contexts[n - 1], model.backoff[n - 1], gram >> K.BITS)
                    p += w[0] if known[0] else 0.0
            total += 10 ** (p if done else p + model.floor)
        assert abs(total - 1) < 1e-3


def test_known_words_are_likelier(model):
    p, n = model.score(["cat", "xqz", "the"])
    assert p[0] / n[0] > p[1] / n[1] and p[2] / n[2] > p[1] / n[1] and list(n) == [4, 4, 4]


def test_document_score_is_the_sum_of_its_words(spark, odd, model):
    for r in K.score(odd, "text", model).collect():
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        p, n = model.score(words) if words else (np.zeros(0), np.zeros(0))
        assert r["n_symbols"] == int(n.sum()) and abs(r["log10_prob"] - p.sum()) < 1e-6 * max(1, abs(p.sum()))


def test_odd_rows(spark, odd, none):
    trusted = spark.createDataFrame([(1,), (6,), (None,)], "doc_id long")
    got = K.judge(odd, trusted, least_docs=1).toPandas()
    assert len(got) == 14 and list(got.columns[:5]) == odd.columns
    assert not got[got.doc_id.isin([3, 4, 5])].kept.any() and got[got.doc_id.isin([1, 2, 6])].kept.all()
    assert K.judge(none, trusted).count() == 0
    assert K.judge(odd, trusted.limit(0), carry=["doc_id"]).filter("kept").count() == 11


def test_good_documents_stay_and_symbol_noise_goes(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = K.judge(docs, K.trusted_ids(labels), carry=["doc_id"]).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.95
    assert got[got.quality == 0].kept.mean() < 0.6


def test_toxic_documents_go_and_trusted_ones_stay(spark, sf):
    from quillon.llm.queries import op8_quality_classifier

    folder = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = op8_quality_classifier(spark, folder).join(labels, "doc_id").toPandas()
    good = got[got.quality == 1]
    assert good[good.toxic == 1].kept.mean() < 0.4
    assert good[good.toxic == 0].kept.mean() > 0.97


def test_an_insult_in_clean_prose_is_seen(spark):
    rows = [(i, f"plain words about river number {i % 7} and stone", "en") for i in range(400)]
    rows += [(i, f"plain words about river. Snark, number {i % 7} and stone", "en") for i in range(400, 520)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = K.judge(docs, docs.filter("doc_id < 400").select("doc_id"), toxic=docs.filter("doc_id between 400 and 479").select("doc_id")).toPandas()
    assert got[got.doc_id < 400].kept.all() and not got[got.doc_id >= 400].kept.any()
    few = K.judge(docs, docs.filter("doc_id < 400").select("doc_id"), toxic=docs.filter("doc_id between 400 and 409").select("doc_id"), least_docs=30)
    assert few.columns == list(got.columns) and few.filter("doc_id < 400 and kept").count() == 400


def brute(sequences, symbols, order):
    """A function of (context, symbol) to the interpolated modified Kneser-Ney probability, from the definition."""
    from collections import Counter, defaultdict

    raw = Counter(tuple(s[i : i + n]) for s in sequences for n in range(1, order + 1) for i in range(len(s) - n + 1))
    counts = []
    for n in range(1, order + 1):
        mine = {g: c for g, c in raw.items() if len(g) == n and g != (K.START,)}
        if n < order:
            left = defaultdict(set)
            for g in raw:
                if len(g) == n + 1:
                    left[g[1:]].add(g[0])
            mine = {g: c if g[0] == K.START else len(left[g]) or c for g, c in mine.items()}
        counts.append(mine)
    cuts = []
    for mine in counts:
        n1, n2, n3, n4 = (sum(c == i for c in mine.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        cuts.append([min(i - 0.01, max(0.01, i - (i + 1) * y * b / a)) if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))])

    def p(context, symbol):
        n = len(context) + 1
        base = 1 / symbols if n == 1 else p(context[1:], symbol)
        followers = {g: c for g, c in counts[n - 1].items() if g[:-1] == context}
        total = sum(followers.values())
        if not total:
            return base
        cut = lambda c: cuts[n - 1][min(c, 3) - 1]
        mine = followers.get((*context, symbol), 0)
        return (mine - (cut(mine) if mine else 0)) / total + sum(map(cut, followers.values())) / total * base

    return p


CORPUS = ["the cat sat on the mat then the cat ran", "a dog ran at the cat", None, "", "the dog sat on the cat then the mat ran", "on the mat the cat sat and the dog sat"]


def test_word_model_against_brute_force(spark):
    import pyarrow as pa

    from quillon.llm.words import chunks

    model = K.train_words(spark.createDataFrame([(t,) for t in CORPUS], "text string").repartition(2))
    column = pa.array([*CORPUS, "the zebra sat on a mat", "cat the the dog"], pa.string())
    texts = []
    for c in chunks(column):
        symbol, text = K.sequences(c, model.known, model.code)
        texts += [symbol[text == i].tolist() for i in range(c.last - c.first)]
        total, _ = model.score(c)
    p = brute([t for t in texts[: len(CORPUS)] if t], len(model.known) + 2, K.WORD_ORDER)
    for t, got in zip(texts, total):
        want = sum(np.log10(p(tuple(t[max(0, i - K.WORD_ORDER + 1) : i]), t[i])) for i in range(1, len(t)))
        assert abs(got - want) < 1e-4 * max(1, abs(want))


def test_letter_model_against_brute_force(spark):
    model = K.train(spark.createDataFrame([(t,) for t in CORPUS], "text string").repartition(3))
    coded = lambda w: [K.START, *(model.index.get(ch, K.OTHER) for ch in w), K.END]
    p = brute([coded(w) for t in CORPUS for w in (t or "").split()], len(model.index) + 2, K.ORDER)
    words = ["the", "cats", "zebra", "o", "mat"]
    got, _ = model.score(words)
    for w, g in zip(words, got):
        s = coded(w)
        assert abs(g - sum(np.log10(p(tuple(s[max(0, i - K.ORDER + 1) : i]), s[i])) for i in range(1, len(s)))) < 1e-4


def test_word_order_counts(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(40)]
    follow = {w: vocabulary[(i * 7 + 3) % 40] for i, w in enumerate(vocabulary)}

    def prose(n):
        out = [vocabulary[rng.integers(40)]]
        for _ in range(n):
            out.append(follow[out[-1]] if rng.random() < 0.8 else vocabulary[rng.integers(40)])
        return out

    rows = [(i, " ".join(prose(60)), "en") for i in range(200)]
    rows += [(1000 + i, " ".join(rng.permutation(prose(60))), "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = K.judge(docs, docs.filter("doc_id < 150").select("doc_id")).toPandas()
    assert got[got.doc_id < 200].kept.mean() > 0.95 and got[got.doc_id >= 1000].kept.mean() < 0.05


def test_clashing_names(spark, odd):
    clash = odd.withColumnRenamed("n_chars", "kept").withColumnRenamed("source", "evidence")
    got = K.judge(clash, spark.createDataFrame([(1,), (6,)], "doc_id long"), least_docs=1)
    assert got.columns == ["doc_id", "text", "lang", "evidence", "log10_prob", "n_symbols", "perplexity", "threshold", "kept"] and got.count() == 14


def test_ngrams_beyond_the_head_count_alike(spark, monkeypatch):
    """Scores are the same however few n-grams the tasks hold."""
    texts = [*CORPUS, "the zebra sat on a mat", "zebras zebras the cat the the dog", "on the mat the cat sat and ran"] * 6
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    trusted = docs.filter("doc_id < 36").select("doc_id")
    judged = lambda: {r["doc_id"]: r["log10_prob"] for r in K.judge(docs, trusted, least_docs=1).collect()}
    want = judged()
    for head in (0, 40, 150):
        monkeypatch.setattr(K, "HEAD", head)
        got = judged()
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-4 * max(1, abs(want[d])) for d in want)


def test_models_learn_from_all_trusted_documents(spark, monkeypatch):
    """Three quarters of them by a hash of the id, however many there are."""
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('word', id % 50, ' and then') as text", "'en' as lang")
    seen, train = [], K.train
    monkeypatch.setattr(K, "train", lambda texts, *a: seen.append(texts.count()) or train(texts, *a))
    K.judge(docs, docs.select("doc_id"))
    assert seen == [docs.filter("pmod(xxhash64(11, doc_id), 4) < 3").count()]


def test_the_filter_holds_all_keys_and_hardly_any_other(spark):
    keys = np.random.default_rng(2).integers(1, 1 << 61, 40_000)
    had = spark.createDataFrame([(int(k),) for k in keys[:20_000]], "key long").repartition(3)
    asked = K.Asked(K.key_filter(had, K.Scratch(spark)))
    may = asked.may(keys, 0)
    assert (may[:20_000] == np.arange(20_000)).all() and len(may) < 20_020


def test_only_the_features_stay_while_documents_are_scored(spark, monkeypatch):
    """Tables that training wrote on its way would take disk beside the scores."""
    import os

    texts = [*CORPUS, "the zebra sat on a mat"] * 6
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    folder = os.path.dirname(K.Scratch(spark).table(spark.range(1), "probe").inputFiles()[0]).removeprefix("file:").rpartition("/")[0]
    before, seen, score = set(os.listdir(folder)), [], K.score
    monkeypatch.setattr(K, "HEAD", 40)
    monkeypatch.setattr(K, "score", lambda *a: seen.extend(set(os.listdir(folder)) - before) or score(*a))
    K.judge(docs, docs.filter("doc_id < 30").select("doc_id"), least_docs=1, toxic=docs.filter("doc_id > 38").select("doc_id"))
    assert [n.split("-")[0] for n in seen] == ["features"] * 2


def test_spellings_are_remembered_alike(spark, model):
    """Words met before, new ones, and more than are kept."""
    import pyarrow as pa

    from quillon.llm.words import chunks

    before = K.Spellings(model, None)
    for most in (1 << 18, 3):
        K.SPELLINGS, kept = most, K.SPELLINGS
        for text in ("the cat sat", "the dog's café sat \U0001f600x", "cat ran a b c d e"):
            for c in chunks(pa.array([text], pa.string())):
                word, one = np.unique(c.hashes, return_index=True)
                p, n = before.score(c, word, one)
                want, size = model.score([text.split()[i] for i in one])
                assert np.allclose(p, want) and (n == size).all()
        K.SPELLINGS = kept
