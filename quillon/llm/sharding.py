"""A uniform shuffle into shards of exact size, planned by a communication matrix.

Entry (p, c) of the matrix is the number of rows that input partition p sends
to cell c. For a uniform random permutation a row of the matrix follows the
multivariate hypergeometric law given what earlier partitions sent. The matrix
is never stored: each task draws its own row by walking down a binary tree of
the input partitions, where every node splits the cells' counts between its two
halves with a generator seeded by the node. The driver holds one count per
partition, a task one count per cell.

Each task then permutes its rows locally, the rows are exchanged by cell, and
each cell is permuted again. Cells are runs of consecutive output slots, so a
shard of any size is spread over many tasks and no task holds a shard. A cell
has ``CELL_ROWS`` rows; beyond ``MOST_CELLS`` cells they grow instead, so that a
task's part of the plan stays small.

The law is ``rows``: shard sizes differ by at most one. Rows may hold nulls,
repeat or be empty; every row gets a slot of its own; an empty table gives an
empty result. An input partition must
yield the same rows when it is read twice (a scan of files does); a task that
meets another number of rows than was counted fails rather than lose rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import positional, with_fields

CELL_ROWS = 4096
MOST_CELLS = 1 << 16
#: kinds of seeds, so that no node of the tree shares a stream with a partition
TREE, DEAL = 0, 1


def cell_bounds(n_rows: int, shards: int, cell_rows: int = CELL_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first slot of each cell in its shard, rows of each cell, shard of each cell)."""
    first, rows, owner = [], [], []
    cell_rows = max(cell_rows, -(-n_rows // MOST_CELLS))
    for s in range(shards):
        size = n_rows // shards + (s < n_rows % shards)
        k = max(1, -(-size // cell_rows))
        at = 0
        for c in range(k):
            here = size // k + (c < size % k)
            first.append(at)
            rows.append(here)
            owner.append(s)
            at += here
    return np.array(first), np.array(rows), np.array(owner)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One draw; beyond numpy's limit of 1e9 by ratio of uniforms on the log mass."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mean = draws * good / total
    spread = math.sqrt(max(1e-9, mean * (bad / total) * ((total - draws) / (total - 1))))
    lg = math.lgamma
    log_mass = lambda k: -(lg(k + 1) + lg(good - k + 1) + lg(draws - k + 1) + lg(bad - draws + k + 1))
    mode = min(high, max(low, int((draws + 1) * (good + 1) / (total + 2))))
    top = log_mass(mode)
    width = 2 * math.sqrt(2 / math.e) * (spread + 0.5) + 2
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_mass(k) - top:
            return k


def split(counts: np.ndarray, left: int, seed: list[int]) -> np.ndarray:
    """How many of each cell's rows come from the left half, which has ``left`` rows."""
    rng = np.random.default_rng(seed)
    rest, out = int(counts.sum()), np.zeros_like(counts)
    if rest < 10**9:
        return rng.multivariate_hypergeometric(counts, left, method="marginals")
    for c in range(len(counts)):
        if left == 0:
            break
        here = int(counts[c])
        rest -= here
        out[c] = hypergeometric(rng, here, rest, left)
        left -= int(out[c])
    return out


def matrix_row(p: int, sizes: np.ndarray, cells: np.ndarray, seed: int) -> np.ndarray:
    """Row p of the communication matrix."""
    low, high, counts = 0, len(sizes), cells.copy()
    upto = np.concatenate([[0], np.cumsum(sizes)])
    while high - low > 1:
        mid = (low + high) // 2
        left = split(counts, int(upto[mid] - upto[low]), [seed, TREE, low, high])
        if p < mid:
            high, counts = mid, left
        else:
            low, counts = mid, counts - left
    return counts


def shard(df: DataFrame, shards: int, seed: int = 11, cell_rows: int = CELL_ROWS) -> DataFrame:
    """df with ``shard`` and ``slot`` (gapless from 0 in each shard), uniformly shuffled."""
    plain, _, back = positional(df)
    counted = plain.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    sizes = np.zeros(max((r[0] for r in counted), default=-1) + 1, dtype=np.int64)
    for r in counted:
        sizes[r[0]] = r[1]
    first, rows, owner = cell_bounds(int(sizes.sum()), shards, cell_rows)
    plan = df.sparkSession.sparkContext.broadcast((sizes, rows))

    def deal(batches):
        sizes, rows = plan.value
        p = TaskContext.get().partitionId()
        n = int(sizes[p]) if p < len(sizes) else 0
        row = matrix_row(p, sizes, rows, seed) if n else np.zeros(0, np.int64)
        rng = np.random.default_rng([seed, DEAL, p])
        cell = rng.permutation(np.repeat(np.arange(len(row), dtype=np.int32), row))
        order = rng.integers(0, 2**63, n, dtype=np.int64)
        at = 0
        for batch in batches:
            k = batch.num_rows
            if at + k > n:
                raise RuntimeError(f"partition {p} has more rows than the {n} counted; materialise the input first")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell[at : at + k]), pa.array(order[at : at + k]), pa.array(np.arange(at, at + k, dtype=np.int64) + (p << 40))], names=[*batch.schema.names, "_cell", "_order", "_tie"])
            at += k
        if at != n:
            raise RuntimeError(f"partition {p} has {at} rows where {n} were counted; materialise the input first")

    fields = (("_cell", T.IntegerType()), ("_order", T.LongType()), ("_tie", T.LongType()))
    dealt = plain.mapInArrow(deal, with_fields(plain.schema, *fields))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_order", "_tie"))
    where = F.broadcast(df.sparkSession.createDataFrame([(int(c), int(owner[c]), int(first[c])) for c in range(len(rows))], "_cell int, shard int, _first long"))
    ranked = dealt.withColumn("_rank", rank)
    return back(ranked.join(where, "_cell").withColumn("slot", F.col("_first") + F.col("_rank") - 1), "shard", "slot")
