import random

import numpy as np
import pytest

from quillon.llm import components as components_module
from quillon.llm import jaccard
from quillon.llm.common import Scratch
from quillon.llm.components import components


def brute(rows, width, percent):
    sets = [jaccard._sets(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * 100 >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((-1 if d is None else d, len(sets[i]), -1 if d is None and root(i) not in least else least.get(root(i))) for i, (d, _) in enumerate(rows))


def family(seed, n, words):
    """Texts that differ from one another by a few words each."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(0, max(2, words // 12))):
            t[rng.randrange(words)] = f"x{rng.randrange(9999)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_components_are_exact(spark, odd_rows, width, percent):
    texts = [t for s, (n, w) in enumerate([(40, 60), (30, 200), (12, 25), (25, 800), (20, 12)]) for t in family(s, n, w)]
    rows = list(enumerate(texts, 100)) + [(r[0], r[1]) for r in odd_rows]
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=width, percent=percent).toPandas().fillna(-1)
    assert sorted(map(tuple, got[["doc_id", "n_shingles", "component_id"]].astype(int).values.tolist())) == brute(rows, width, percent)


def test_large_cells_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = list(enumerate(family(9, 50, 90)))
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(map(tuple, got[["doc_id", "n_shingles", "component_id"]].values.tolist())) == brute(rows, 3, 90)


def test_empty_table(none):
    assert jaccard.link(none).count() == 0


def test_tree_answers_are_those_of_the_bound():
    rng = np.random.default_rng(4)
    points = rng.poisson(6, (300, jaccard.DIMS))
    points[150:] = points[:150] + (rng.random((150, jaccard.DIMS)) < 0.05)
    tree = jaccard.RTree(points)
    for p in points[::17]:
        n, size = p.sum(), points.sum(axis=1)
        want = np.flatnonzero((np.minimum(points, p).sum(axis=1) * 190 >= 90 * (n + np.maximum(size, -(-90 * n // 100)))) & (size * 100 >= 90 * n) & (size * 90 <= 100 * n))
        assert sorted(tree.partners(p, 90)) == want.tolist()


def test_linked_sets_share_a_cell():
    rng = np.random.default_rng(5)
    ladder = jaccard.bands(1 << 12, 90)
    for n in (9, 10, 19, 31, 60, 200, 777):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            differ = int(rng.integers(1, max(2, n // 19 + 1)))
            b = np.unique(np.concatenate([a[differ // 2 :], rng.integers(0, 2**63, differ - differ // 2, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both * 100 >= 90 * (len(a) + len(b) - both) and len(a) != both:
                assert len(np.intersect1d(jaccard.cells(a, 90, ladder), jaccard.cells(b, 90, ladder)))


@pytest.mark.parametrize("one_task", [0, 500_000])
def test_components_of_paths_and_stars(spark, monkeypatch, one_task):
    monkeypatch.setattr(components_module, "ONE_TASK", one_task)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    scratch = Scratch(spark)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(6), scratch).collect()}
    scratch.clear()
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


def test_linked_sets_share_a_cell_without_their_hottest():
    rng = np.random.default_rng(6)
    for percent in (80, 90):
        ladder = jaccard.bands(1 << 12, percent)
        for n in (10, 19, 31, 60, 200, 777):
            for _ in range(20):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                differ = int(rng.integers(1, max(2, n * (100 - percent) * 2 // (100 + percent))))
                b = np.unique(np.concatenate([a[differ // 2 :], rng.integers(0, 2**64, differ - differ // 2, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if both * 100 < percent * (len(a) + len(b) - both) or len(a) == len(b) == both:
                    continue
                heat = {int(k): int(rng.integers(0, 9)) for s in (a, b) for k in jaccard.cells(s, percent, ladder)}
                kept = []
                for s in (a, b):
                    key, lot = jaccard.dealt_cells(s, percent, ladder)
                    own = set()
                    for x in np.unique(lot):
                        ranked = sorted(((-heat[int(k)], int(k)) for k in key[lot == x]))
                        own |= {k for _, k in ranked[x & ((1 << 20) - 1) :]}
                    kept.append(own)
                assert kept[0] & kept[1], (percent, len(a), len(b), both)


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (3, 70, 90, 300, 2000)]
    sets += [np.unique(np.concatenate([s[len(s) // 5 :], rng.integers(0, 2**64, len(s), dtype=np.uint64)])) for s in sets]
    points = jaccard.Points([jaccard.point(s) for s in sets])
    for i, s in enumerate(sets):
        bound = points.bound(i, np.arange(len(sets)))
        assert all(bound[j] >= len(np.intersect1d(s, t)) for j, t in enumerate(sets)) and bound[i] == len(s)


def test_repeated_and_missing_ids_keep_their_own_text(spark):
    base = [f"b{i}" for i in range(200)]
    text = lambda k: " ".join(base + [f"x{i}" for i in range(k)])
    rows = [(5, " ".join(f"z{i}" for i in range(200))), (5, text(0)), (9, text(1)), (7, text(2)), (None, text(3))]
    got = [tuple(r) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "n_shingles").collect()]
    assert sorted(got, key=str) == sorted([(5, 5, 198), (5, 5, 198), (9, 5, 199), (7, 5, 200), (None, 5, 201)], key=str)
    alone = [(None, text(0)), (9, text(1))]
    got = jaccard.link(spark.createDataFrame(alone, "doc_id long, text string")).select("component_id").collect()
    assert [r[0] for r in got] == [9, 9]
    unnamed = jaccard.link(spark.createDataFrame([(None, text(0)), (None, text(1)), (None, None)], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in unnamed} == {None} and len({r["component"] for r in unnamed if r["n_shingles"]}) == 1


def test_heavy_cells_and_failed_forests(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HEAVY", 2)
    monkeypatch.setattr(jaccard, "HEAVY_SAMPLE", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):  # pairs lie around the threshold
        t = list(base)
        for _ in range(3):
            t[rng.randrange(100)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(t)))
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=85).toPandas()
    assert sorted(map(tuple, got[["doc_id", "n_shingles", "component_id"]].values.tolist())) == brute(rows, 3, 85)


def test_scratch_tables_take_less_disk_than_the_default(spark, tmp_path):
    """Texts that an operator keeps on its way are packed more tightly than Spark's writer does by itself."""
    import os

    texts = spark.range(4000).selectExpr("concat_ws(' ', transform(sequence(1, 60), i -> concat('word', pmod(xxhash64(id, i), 3000)))) as text").repartition(1)
    size = lambda path: sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet"))
    texts.write.parquet(str(tmp_path / "plain"))
    scratch = Scratch(spark)
    scratch.table(texts, "texts")
    assert size(scratch.paths[0].removeprefix("file:")) < 0.8 * size(str(tmp_path / "plain"))
    scratch.clear()
