"""Connected components of a graph given as an edge table.

Every partition first replaces its edges by a forest that connects the same
nodes, which takes out most edges of dense groups. If at most ``ONE_TASK`` edges
are left, a bound that fits any executor, one task finishes in the same way;
otherwise large-star and small-star steps follow until nothing changes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch

ROUNDS = 60
ONE_TASK = 500_000


def _forest(batches):
    """Edges from every node of a partition to the least node it is connected with there."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(up.setdefault(u, u)), root(up.setdefault(v, v))
            up[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in up if up[x] != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link the larger (or not larger) neighbours of a node to its least neighbour."""
    if large:
        ends = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        moved = ends.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = ends.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        moved = ends.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return moved.filter("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): every node of an edge with the least node it is connected with.

    ``edges`` has two columns of type long. Nodes without an edge to
    another node are not in the result. Every round is written to ``scratch``; a node's neighbours are only ever aggregated, never gathered.
    """
    now = scratch.table(edges.toDF("u", "v").filter("u != v").mapInArrow(_forest, "u long, v long"), "edges")
    if now.count() <= ONE_TASK:
        now = scratch.table(now.coalesce(1).mapInArrow(_forest, "u long, v long"), "edges")
        return _named(now)
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 30)))).first())
    was = None
    for _ in range(ROUNDS):
        now = scratch.table(_star(_star(now, True), False), "edges")
        seen = state(now)
        if seen == was:
            break
        was = seen
    else:
        raise RuntimeError("components did not settle")
    return _named(now)


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v"), F.col("v")).distinct())
