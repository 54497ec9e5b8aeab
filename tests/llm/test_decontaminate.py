import random

from quillon.llm import decontaminate


def shingles(t, n=5):
    w = (t or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(n))))


def holds(text, item):
    """Whether a text has 80 per cent of an item's shingles; those of a short item are all its words."""
    n = min(5, len(item.split()))
    return n > 0 and len(shingles(text, n) & shingles(item, n)) * 100 >= 80 * len(shingles(item, n))


def planted(n_items=60, n_docs=300):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([4, 5, 9, 14, 30, 70, 150])))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        words = [word() for _ in range(rng.choice([20, 200, 3000]))]
        if d % 3 == 0:
            text = items[rng.randrange(n_items)][1].split()
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = [x.upper() if d % 2 else x for x in text]
        docs.append((d, " ".join(words)))
    return docs, items


def test_recall_and_exactness(spark):
    docs, items = planted()
    want = {(d, i) for d, t in docs for i, x in items if holds(t, x)}
    got = decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found <= want and len(found) >= 0.99 * len(want) and len(want) > 50


def test_blocks_of_items_add_up(spark, monkeypatch):
    docs, items = planted()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.search(d, i).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    assert sorted(map(tuple, decontaminate.search(d, i).collect())) == whole


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "lazy dog while seven wise owls watch from"), (2, None), (3, "too short"), (None, "quick brown fox jumps over the lazy"), (4, "lazy dog while seven wise owls watch from")], "item_id long, text string")
    got = decontaminate.clean(odd, items)
    assert got.columns == odd.columns and sorted(r["doc_id"] or -1 for r in got.collect()) == [-1, 3, 4, 5, 6, 7, 8, 10, 11, 12]
    assert sorted(r["item_id"] or -1 for r in decontaminate.search(odd, items).filter("doc_id = 1").collect()) == [-1, 1, 4]
    assert decontaminate.search(none, items).count() == 0
    assert decontaminate.clean(odd, items.limit(0)).count() == 14


def test_items_of_few_shingles_are_found(spark):
    """Items of five to eight words in long documents, each held once."""
    rng = random.Random(3)
    word = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    items, docs = [], []
    for i in range(400):
        item = word(5 + i % 4)
        items.append((i, " ".join(item)))
        docs.append((i, " ".join([*word(40 + i % 23), *item, *word(60)])))
    got = decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).toPandas()
    assert sorted(zip(got.doc_id, got.item_id)) == [(i, i) for i in range(400)]


def test_items_shorter_than_a_shingle_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a B c d", 5, 6), (2, "a b x c d e f", 5, 6), (3, None, 5, 6), (4, "c d", 5, 6)], "doc_id long, text string, hits long, found long")
    items = spark.createDataFrame([(7, "c d"), (8, "a b c"), (None, "A b"), (9, "d c"), (10, ""), (11, "f")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"] or -1, r["n_item"], r["n_found"]) for r in decontaminate.search(docs, items).collect()))
    assert got == [(1, -1, 1, 1), (1, 7, 1, 1), (1, 8, 1, 1), (2, -1, 1, 1), (2, 7, 1, 1), (2, 11, 1, 1), (4, 7, 1, 1)]
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [3]
    assert decontaminate.annotate(docs, items).columns == ["doc_id", "text", "found", "hits"]


def test_items_of_every_small_size_are_all_found(spark):
    """5000 items of one to eight shingles, each planted once."""
    rng = random.Random(4)
    word = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    items, docs = [], []
    for i in range(5000):
        item = word(5 + i % 8)
        items.append((i, " ".join(item)))
        docs.append((i, " ".join([*word(3 + i % 29), *item, *word(i % 31)])))
    got = decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).toPandas()
    assert sorted(zip(got.doc_id, got.item_id)) == [(i, i) for i in range(5000)]
