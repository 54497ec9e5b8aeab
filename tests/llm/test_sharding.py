import numpy as np
import pytest

from quillon.llm import sharding


def test_exact_shards(spark, odd):
    got = sharding.shard(odd, 4, cell_rows=3).toPandas()
    assert len(got) == 14
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 4
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_extra_columns_and_empty(spark, odd, none):
    assert sharding.shard(none, 8).count() == 0
    clash = odd.withColumnRenamed("lang", "count")
    assert sharding.shard(clash, 2).columns == [*clash.columns, "shard", "slot"]


def test_matrix_margins():
    sizes, cells = np.array([7, 0, 13, 5, 20]), np.array([11, 14, 20])
    rows = np.array([sharding.matrix_row(p, sizes, cells, 3) for p in range(5)])
    assert (rows.sum(axis=1) == sizes).all() and (rows.sum(axis=0) == cells).all() and (rows >= 0).all()


def test_same_plan_again(spark, odd):
    a, b = (sorted(map(tuple, sharding.shard(odd.select("doc_id"), 3).toPandas().fillna(-1).values)) for _ in range(2))
    assert a == b


def test_every_order_is_as_likely():
    rng = np.random.default_rng(0)
    seen = [sharding.matrix_row(0, np.array([2, 2]), np.array([2, 2]), int(s))[0] for s in rng.integers(0, 10**6, 6000)]
    share = np.bincount(seen, minlength=3) / len(seen)
    assert np.allclose(share, [1 / 6, 4 / 6, 1 / 6], atol=0.025)


@pytest.mark.parametrize("good, bad, draws", [(2 * 10**9, 10**9, 3 * 10**8), (10**9, 5, 4 * 10**8)])
def test_draws_beyond_a_billion(good, bad, draws):
    rng = np.random.default_rng(2)
    got = [sharding.hypergeometric(rng, good, bad, draws) for _ in range(400)]
    mean = draws * good / (good + bad)
    sd = max(1.0, (mean * (bad / (good + bad)) * ((good + bad - draws) / (good + bad - 1))) ** 0.5)
    assert all(max(0, draws - bad) <= g <= min(good, draws) for g in got)
    assert abs(np.mean(got) - mean) < 6 * sd / 20


def test_deal_against_brute_force(spark):
    """The plan of every partition worked out again row by row: draws from the tree, the deal, the order in each cell."""
    rows, parts, shards, seed, cell_rows = 137, 5, 3, 11, 10
    df = spark.range(rows, numPartitions=parts)
    layout = [[r["id"] for r in df.collect()][i * rows // parts : (i + 1) * rows // parts] for i in range(parts)]
    sizes = np.array([len(p) for p in layout])
    first, cells, owner = sharding.cell_bounds(rows, shards, cell_rows)
    inside = [[] for _ in cells]
    for p, ids in enumerate(layout):
        counts = sharding.matrix_row(p, sizes, cells, seed)
        rng = np.random.default_rng([seed, 1, p])
        cell = rng.permutation(np.repeat(np.arange(len(counts), dtype=np.int32), counts))
        order = rng.integers(0, 2**63, len(ids), dtype=np.int64)
        for k, i in enumerate(ids):
            inside[cell[k]].append((order[k], (p << 40) + k, i))
    want = {i: (int(owner[c]), int(first[c]) + n) for c, held in enumerate(inside) for n, (_, _, i) in enumerate(sorted(held))}
    got = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shard(df, shards, seed, cell_rows).collect()}
    assert got == want and [len(h) for h in inside] == cells.tolist()


def test_clashing_names(odd):
    clash = odd.withColumnRenamed("lang", "shard").withColumnRenamed("source", "_cell").withColumnRenamed("n_chars", "_rank")
    got = sharding.shard(clash, 2)
    assert got.columns == ["doc_id", "text", "_cell", "_rank", "shard", "slot"] and got.count() == 14


@pytest.mark.parametrize("parts", [6, 7, 12, 48])
def test_nodes_and_partitions_draw_from_streams_of_their_own(parts):
    nodes, stack = [], [(0, parts)]
    while stack:
        low, high = stack.pop()
        if high - low > 1:
            nodes.append((low, high))
            stack += [(low, (low + high) // 2), ((low + high) // 2, high)]
    seeds = [[11, sharding.TREE, *n] for n in nodes] + [[11, sharding.DEAL, p] for p in range(parts)]
    assert len({np.random.default_rng(s).integers(2**63) for s in seeds}) == len(seeds)
