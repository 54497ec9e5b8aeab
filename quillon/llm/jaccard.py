"""Exact n-gram Jaccard join with count vectors in an R-tree.

Shingles of a document are hashed; equal sets form one class (two 64-bit
hashes), which is numbered and stored once with one of its texts. A class's
point is its count vector: the shingles fall into groups by hash, and the
coordinates are the groups' counts. The overlap of two sets is at most the sum
of the smaller coordinates, so two classes whose sum misses the overlap that
the threshold asks for cannot be linked. A packed R-tree over ``DIMS``
coordinates keeps the maxima of each subtree and prunes with the same bound;
what it lets through meets the bound once more with eight to sixteen groups a
shingle.

One tree over all classes would compare every leaf with every other as data
grow, so the space is first cut into cells that lose no link. Sets that link
differ in at most k shingles, so of more than k groups (by hash range) some
hold exactly the same shingles in both, and the two meet in the cell of that
group's content. There are 1 + k // 5 groups to spare. Empty groups use up
spare ones; with the rest every set leaves out its hottest cells, ranked by the
cell's size: of two linked sets' common cells the least hot one stays in both.
So a passage that many documents share gathers few of them. A set with more
empty groups than spare ones is dealt again under other hashes, and in the last
round its empty groups are cells as well. A set that can't differ by all k
leaves out as many cells more, by hash.

Cells are worked off in rounds, and after each the verified links form
components; only cells whose members lie in several go on.

1. The least member of every cell with each other member, as pairs, each once.
2. The same with a member drawn by the cell's hash.
3. Cells still open: the tree finds the pairs of different components that the
   bound allows, and a forest of them (fewer pairs than members) is emitted.
4. Only where a pair of the forest failed: all such pairs of that cell.

No round lists all pairs of a group of copies. Cells of more than ``BLOCK``
members are joined block by block in rounds 3 and 4. Pairs are verified on the
texts' own shingles.

Defined results: a text that is null or has no words has an empty set and links
with nothing; fewer words than a shingle make one shingle of all words; equal
texts (and equal sets) are linked whatever their number; repeated ids keep
their rows, each by its own text; a null id takes part with its text, and a
component is named by the least id in it (null if none has one); an empty table
gives no rows. Other columns of the input aren't read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import Scratch, settled, table
from quillon.llm.components import components
from quillon.llm.words import FOLD, chunks, mix, ngrams

DIMS = 32
LEAF = 16
BLOCK = 2048
MOST_BITS = 18
ROUNDS = 3
#: class numbers that are broadcast, 8 bytes each, to pick the texts of classes that meet any other
SEMI_ROWS = 2_000_000
#: A cell is heavy if it has so many members among the classes whose number's hash is 0 modulo HEAVY_SAMPLE; so many heavy cells are dealt over several tasks.
HEAVY, HEAVY_SAMPLE, HEAVY_CELLS, HEAVY_PARTS = 256, 64, 65_536, 64
_U = np.uint64


def bands(top: int, percent: int) -> list[int]:
    """Lower ends of the size bands up to a size beyond top."""
    out = [1]
    while out[-1] <= top:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingle hashes of one text's words, sorted."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    if len(hashes) < width:
        with np.errstate(over="ignore"):
            return mix(ngrams(hashes, len(hashes)) + _U(len(hashes)))
    return np.unique(ngrams(hashes, width))


def cells(h: np.ndarray, percent: int, ladder: list[int]) -> np.ndarray:
    """Keys of the cells of a set of sorted hashes."""
    return dealt_cells(h, percent, ladder)[0]


def dealt_cells(h: np.ndarray, percent: int, ladder: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the cells of a set of sorted hashes, and each one's lot.

    A lot is band, round and the number of cells that may be left out of the lot.
    """
    n = len(h)
    band = int(np.searchsorted(ladder, n, "right")) - 1
    keys, lots = [], []
    dealt: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    b = band
    while b == band or n * 100 >= percent * ladder[b]:
        high = ladder[b + 1] - 1
        most = (100 - percent) * 2 * high // (100 + percent)  # shingles in which two sets of the band differ at most
        own = (100 - percent) * (n + min(high, n * 100 // percent)) // (100 + percent)  # the same for this set
        b += 1
        if own == 0:
            continue  # only equal sets link, and those are one class
        spare = 1 + most // 5
        groups = most + 1 + spare
        for r in range(ROUNDS):
            if r not in dealt:
                x = h if r == 0 else np.sort(mix(h, 100 + r))
                dealt[r] = x, mix(x, 7)
            x, mixed = dealt[r]
            place = ((x >> _U(32)) * _U(groups)) >> _U(32)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            at = mix(place[first] * _U(1_000_003) + _U(b * 8 + r), 9)
            with np.errstate(over="ignore"):
                key = mix(np.add.reduceat(mixed, first) + at, 11)
            empty, last = groups - len(first), r == ROUNDS - 1
            room = max(0, spare - empty)
            if last and empty > spare:
                free = np.setdiff1d(np.arange(groups, dtype=np.uint64), place[first])
                key, room = np.concatenate([key, mix(mix(free * _U(1_000_003) + _U(b * 8 + r), 9), 13)]), spare
            keep = len(key) - (most - own)
            if keep > 0:
                keys.append(np.partition(key, keep - 1)[:keep] if keep < len(key) else key)
                lots.append(np.full(keep, (b * 8 + r) << 20 | min(room, (1 << 20) - 1), np.int32))
            if empty <= spare:
                break
    return (np.concatenate(keys), np.concatenate(lots)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def point(h: np.ndarray) -> bytes:
    """Count vectors of a set: ``DIMS`` counts, then which of many more groups hold one shingle or more, and two or more."""
    bits = min(MOST_BITS, max(9, (len(h) - 1).bit_length() + 3))
    counts = np.bincount((h & _U((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    coarse = counts.reshape(-1, DIMS).sum(axis=0).astype("<u4")
    return coarse.tobytes() + np.packbits(counts > 0).tobytes() + np.packbits(counts > 1).tobytes()


class Points:
    """Count vectors of one length: the halves of longer ones are summed."""

    def __init__(self, points: list[bytes]):
        self.coarse = np.stack([np.frombuffer(p, "<u4", DIMS) for p in points]).astype(np.int64)
        self.size = self.coarse.sum(axis=1)
        head = 4 * DIMS
        short = min(len(p) for p in points) - head
        ones, twos = [], []
        for p in points:
            one, two = (np.frombuffer(p, "<u8", (len(p) - head) // 16, head + i * (len(p) - head) // 2) for i in (0, 1))
            while len(one) * 16 > short:
                half = len(one) // 2
                one, two = one[:half] | one[half:], two[:half] | two[half:] | (one[:half] & one[half:])
            ones.append(one)
            twos.append(two)
        self.ones, self.twos = np.stack(ones), np.stack(twos)
        # shingles beyond the second of a group
        self.beyond = self.size - self._bits(self.ones) - self._bits(self.twos)

    @staticmethod
    def _bits(words: np.ndarray) -> np.ndarray:
        return np.bitwise_count(words).sum(axis=1, dtype=np.int64)

    def bound(self, i: int | np.ndarray, near: np.ndarray) -> np.ndarray:
        """At least the overlaps of sets i and near."""
        fine = self._bits(self.ones[near] & self.ones[i]) + self._bits(self.twos[near] & self.twos[i])
        return fine + np.minimum(self.beyond[near], self.beyond[i])

    def allowed(self, i: int | np.ndarray, near: np.ndarray, percent: int) -> np.ndarray:
        return self.bound(i, near) * (100 + percent) >= percent * (self.size[near] + self.size[i])


class RTree:
    """Packed R-tree over count vectors; a node keeps the maxima of its coordinates and its sizes' range."""

    def __init__(self, points: np.ndarray, fan: int = LEAF):
        order = np.lexsort((points[:, 1], points[:, 0], points.sum(axis=1)))
        self.order, self.points = order, points[order]
        self.size = self.points.sum(axis=1)
        self.levels = []
        high, low_size, high_size = self.points, self.size, self.size
        self.fan = fan
        while len(high) > 1:
            at = np.arange(0, len(high), fan)
            high, low_size, high_size = np.maximum.reduceat(high, at), np.minimum.reduceat(low_size, at), np.maximum.reduceat(high_size, at)
            self.levels.append((high, low_size, high_size))

    def partners(self, point: np.ndarray, percent: int) -> np.ndarray:
        """Members whose bound allows a link with ``point``."""
        n = int(point.sum())

        def fits(high, low_size, high_size):
            size = np.maximum(low_size, -(-percent * n // 100))
            bound = np.minimum(high, point).sum(axis=1)
            return (bound * (100 + percent) >= percent * (n + size)) & (high_size * 100 >= percent * n) & (low_size * percent <= 100 * n)

        found = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -2, -1):
            if depth == len(self.levels) - 1:
                found = np.arange(len(self.levels[depth][0]) if depth >= 0 else len(self.points))
            else:
                below = len(self.levels[depth][0]) if depth >= 0 else len(self.points)
                found = (found[:, None] * self.fan + np.arange(self.fan)).ravel()
                found = found[found < below]
            high, low, top = self.levels[depth] if depth >= 0 else (self.points, self.size, self.size)
            found = found[fits(high[found], low[found], top[found])]
        return self.order[found]


SKETCH = "doc_id long, text_hash long, n_shingles long, c1 long, c2 long"
TEXTS = "c1 long, c2 long, body string"
CELLS = "cell long, node long, lot int"
POINTS = "p long, point binary"
PAIRS = "a long, b long"
CELL_PAIRS = "cell long, a long, b long"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=_names(schema))


def _classes(h: np.ndarray) -> tuple[int, int]:
    """The two hashes that name a set."""
    if not len(h):
        return 0, 0
    with np.errstate(over="ignore"):
        return tuple(mix(np.array([mix(h, 1).sum() + _U(len(h)), mix(h, 2).sum()], np.uint64), 3).view(np.int64).tolist())


def _sketch(width: int):
    """One row per document: set size and class."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(2), fold=True):
                sets = [shingles(c.row(i), width) for i in range(c.last - c.first)]
                named = np.array([_classes(h) for h in sets], np.int64).reshape(-1, 2)
                yield _batch(SKETCH, batch.column(0)[c.first : c.last], batch.column(1)[c.first : c.last], np.array([len(h) for h in sets], np.int64), named[:, 0], named[:, 1])

    return run


def _texts(width: int):
    """The texts of the classes, once per class and task (as far as a million of them are remembered)."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for c in chunks(batch.column(0), fold=True):
                named, place = [], []
                for i in range(c.last - c.first):
                    h = shingles(c.row(i), width)
                    key = _classes(h)
                    if len(h) and key not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(key)
                        named.append(key)
                        place.append(c.first + i)
                pair = np.array(named, np.int64).reshape(-1, 2)
                yield _batch(TEXTS, pair[:, 0], pair[:, 1], batch.column(0).take(pa.array(place, pa.int64())))

    return run


def _cells(width: int, percent: int):
    """The cells of (class, text) rows."""

    def run(batches):
        ladder = bands(1 << 12, percent)
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for c in chunks(batch.column(1), fold=True):
                keys, lots, owner = [], [], []
                for i in range(c.last - c.first):
                    h = shingles(c.row(i), width)
                    while len(h) * 100 >= percent * ladder[-2]:
                        ladder = bands(ladder[-1] * 4, percent)
                    key, lot = dealt_cells(h, percent, ladder)
                    keys.append(key.view(np.int64))
                    lots.append(lot)
                    owner.append(len(key))
                yield _batch(CELLS, np.concatenate(keys), np.repeat(nodes[c.first : c.last], owner), np.concatenate(lots))

    return run


def _points(width: int):
    """Count vectors of (class, text) rows."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column(1), fold=True):
                yield _batch(POINTS, batch.column(0)[c.first : c.last], pa.array([point(shingles(c.row(i), width)) for i in range(c.last - c.first)], pa.binary()))

    return run


def _allowed(percent: int):
    """Keeps the pairs (a, b, point of a, point of b) that the bound allows."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                n = part.num_rows
                points = Points(part.column(2).to_pylist() + part.column(3).to_pylist())
                keep = points.allowed(np.arange(n), np.arange(n, 2 * n), percent)
                yield _batch(PAIRS, part.column(0), part.column(1)).filter(pa.array(keep))

    return run


def _cell_pairs(percent: int, forest: bool):
    """Pairs of different components that the bound allows, of the cells in a partition sorted by cell.

    Rows are (cell, block, side, member, component, point); a cell that was
    split into blocks has rows of two sides, of which only pairs across sides
    are wanted. ``forest``: of each cell only pairs that join what the cell's
    earlier pairs haven't joined.
    """

    def of_cell(side, member, comp, raw):
        if comp.min() == comp.max():
            return []
        points, out = Points(raw), []
        tree = RTree(points.coarse)
        up = {int(c): int(c) for c in comp}

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for i in np.flatnonzero(side != 2):
            near = tree.partners(points.coarse[i], percent)
            near = near[(comp[near] != comp[i]) & ((side[near] == 2) if side[i] == 1 else (near > i))]
            if len(near):
                near = near[points.allowed(i, near, percent)]
            for j in near.tolist():
                if forest:
                    one, two = root(int(comp[i])), root(int(comp[j]))
                    if one == two:
                        continue
                    up[max(one, two)] = min(one, two)
                out.append((member[i], member[j]))
        return out

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            edge = np.flatnonzero(np.diff(t.column(1).to_numpy())) + 1
            whole = int(edge[-1]) if len(edge) else 0
            rest = t.slice(whole)
            yield from flush(t.slice(0, whole))
        if rest is not None:
            yield from flush(rest)

    def flush(t):
        if not t.num_rows:
            return
        cell, block, side, member, comp = (t.column(i).to_numpy() for i in range(5))
        raw = t.column(5).to_pylist()
        edge = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
        for s, e in zip(edge[:-1], edge[1:]):
            if e - s > 1 and (out := of_cell(side[s:e], member[s:e], comp[s:e], raw[s:e])):
                pairs = np.sort(np.array(out, np.int64), axis=1)
                yield _batch(CELL_PAIRS, np.full(len(pairs), cell[s]), pairs[:, 0], pairs[:, 1])

    return run


def _sets(text: str | None, width: int) -> frozenset:
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD.tobytes()).split()
    if not words:
        return frozenset()
    return frozenset(zip(*(words[i:] for i in range(width)))) if len(words) >= width else frozenset([tuple(words)])


def _verify(percent: int, width: int):
    """Keeps the pairs (a, b, text_a, text_b) whose sets reach the threshold."""

    def run(batches):
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            keep, last, last_set = [], None, frozenset()
            for i in range(batch.num_rows):
                if a[i].as_py() != last:
                    last, last_set = a[i].as_py(), _sets(ta[i].as_py(), width)
                other = _sets(tb[i].as_py(), width)
                both = len(last_set & other)
                keep.append(both > 0 and both * 100 >= percent * (len(last_set) + len(other) - both))
            yield _batch(PAIRS, a, b).filter(pa.array(keep, pa.bool_()))

    return run


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id, links, text_hash, component) for every row of docs.

    ``links`` counts the verified links of the document's class that the
    components were built from; copies of one set need none. ``text_hash`` is
    xxhash64 of the text. ``component`` is the component's number, null for an
    empty set; components of a table with repeated ids can share a least id.
    """
    scratch = Scratch(docs.sparkSession)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    rows = scratch.table(plain.mapInArrow(settled(_sketch(width)), SKETCH), "sketch")
    # every class once, numbered when it is written
    body = scratch.table(plain.select("text").mapInArrow(settled(_texts(width)), TEXTS).dropDuplicates(["c1", "c2"]).select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "body"), "classes")
    texts = body.select("node", "body")

    def met_cells() -> DataFrame:
        """Cells in which two classes meet, with their sizes; the rows of heavy ones are counted in parts."""
        tiles = texts.mapInArrow(_cells(width, percent), CELLS)
        few = texts.filter(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(HEAVY_SAMPLE)) == 0).mapInArrow(_cells(width, percent), CELLS)
        heavy = few.groupBy("cell").agg(F.count(F.lit(1)).alias("sampled")).filter(F.col("sampled") >= HEAVY).orderBy(F.desc("sampled"), "cell").limit(HEAVY_CELLS)
        tiles = tiles.join(F.broadcast(heavy), "cell", "left")  # at most HEAVY_CELLS rows
        part = F.when(F.col("sampled").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.pmod(F.xxhash64("node"), F.lit(HEAVY_PARTS))))
        tiles = tiles.withColumn("part", part).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("part")))
        size = F.coalesce(F.col("sampled") * HEAVY_SAMPLE, F.col("n"))  # ranks need one figure per cell, not an exact one
        return tiles.filter(F.col("sampled").isNotNull() | (F.col("n") > 1)).select("cell", "node", "lot", size.alias("size"))

    def cool_cells() -> DataFrame:
        """Without each lot's hottest cells."""
        w = Window.partitionBy("node", "lot").orderBy(F.desc("size"), "cell")
        ranked = met.withColumn("hot", F.row_number().over(w)).filter(F.col("hot") > F.col("lot").bitwiseAND((1 << 20) - 1))
        return ranked.select("cell", "node")

    def distinct_cells() -> DataFrame:
        """Of the cells with the same members (a pair shares many) one is enough."""
        sums = cool.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("s2"), F.min("node").alias("least"))
        kept = sums.filter("n > 1").groupBy("s1", "s2", "n").agg(F.min("cell").alias("cell"), F.first("least").alias("least"))
        return cool.join(kept.select("cell", "n", "least"), "cell")

    met = scratch.table(met_cells(), "met")
    cool = scratch.table(cool_cells(), "cool")
    shared = scratch.table(distinct_cells(), "cells")
    wanted = shared.select("node").distinct()
    if wanted.count() <= SEMI_ROWS:  # else both sides are shuffled
        wanted = F.broadcast(wanted)
    body_of = scratch.table(texts.join(wanted, "node", "left_semi"), "bodies")
    point_of = scratch.table(body_of.mapInArrow(settled(_points(width)), POINTS), "points")

    def verified(pairs: DataFrame) -> DataFrame:
        two = lambda side, name: body_of.select(F.col("node").alias(side), F.col("body").alias(name))
        pairs = pairs.join(two("a", "ta"), "a").join(two("b", "tb"), "b").select("a", "b", "ta", "tb")
        return scratch.table(pairs.sortWithinPartitions("a").mapInArrow(settled(_verify(percent, width)), PAIRS), "links")

    def of_pairs(pairs: DataFrame) -> DataFrame:
        """The links among pairs of nodes: first by the bound, then by the texts."""
        two = lambda side, name: point_of.select(F.col("p").alias(side), F.col("point").alias(name))
        pairs = scratch.table(pairs.distinct(), "pairs").join(two("a", "pa"), "a").join(two("b", "pb"), "b").select("a", "b", "pa", "pb")
        return verified(scratch.table(pairs.mapInArrow(_allowed(percent), PAIRS), "allowed"))

    def placed() -> DataFrame:
        return shared.join(comp, "node", "left").select("cell", "node", "n", F.coalesce("component", "node").alias("comp"))

    def still_open(rows_of: DataFrame) -> DataFrame:
        """Rows of the cells whose members lie in several components."""
        several = rows_of.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("node", "comp"), F.xxhash64("cell", "node")).alias("drawn")).filter("lo != hi").select("cell", "drawn")
        return rows_of.join(several, "cell")

    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")

    def in_block_pairs(cell_rows: DataFrame) -> DataFrame:
        """Large cells as pairs of blocks (i, j), i <= j: a member of block b goes to (i, b) and (b, j)."""
        pair = F.explode(F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j"))))
        one = cell_rows.filter(parts == 1).select("cell", F.col("cell").alias("block"), F.lit(0).alias("side"), "node", "comp")
        more = cell_rows.filter(parts > 1).withColumn("pair", pair)
        return one.unionByName(more.select("cell", F.xxhash64("cell", "pair.i", "pair.j").alias("block"), F.when(F.col("pair.i") == F.col("pair.j"), 0).when(mine == F.col("pair.i"), 1).otherwise(2).alias("side"), "node", "comp"))

    def in_cells(cell_rows: DataFrame, forest: bool) -> DataFrame:
        ready = in_block_pairs(cell_rows).join(point_of, F.col("node") == F.col("p")).select("cell", "block", "side", "node", "comp", "point")
        found = ready.repartition("block").sortWithinPartitions("block", "side", "node").mapInArrow(_cell_pairs(percent, forest), CELL_PAIRS)
        return scratch.table(found, "found")

    def grown(more: DataFrame) -> tuple[DataFrame, DataFrame]:
        every = scratch.table(links.union(more).distinct(), "links")
        return every, scratch.table(components(every, scratch), "components")

    links = of_pairs(shared.filter("node != least").select(F.col("least").alias("a"), F.col("node").alias("b")))
    comp = scratch.table(components(links, scratch), "components")
    drawn = still_open(placed().filter("n > 2")).filter("comp != drawn.comp")
    links, comp = grown(of_pairs(drawn.select(F.least("node", "drawn.node").alias("a"), F.greatest("node", "drawn.node").alias("b"))))
    left = scratch.table(still_open(placed().filter("n > 2")).drop("drawn"), "open")
    forest = in_cells(left, True)
    sure = verified(forest.select("a", "b").distinct())
    failed = forest.join(sure, ["a", "b"], "left_anti").select("cell").distinct()
    links, comp = grown(sure)
    again = still_open(left.join(failed, "cell", "left_semi").drop("comp").join(comp, "node", "left").select("cell", "node", "n", F.coalesce("component", "node").alias("comp")))
    links, comp = grown(verified(in_cells(again, False).select("a", "b").distinct()))

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    # classes: the least id of each, then the least of each component
    least = rows.filter("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"))
    classes = body.select("node", "c1", "c2").join(least, ["c1", "c2"]).join(comp, "node", "left").join(degree, "node", "left")
    classes = classes.select("c1", "c2", "rep", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    named = classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = classes.join(named, "component").select("c1", "c2", "component", "component_id", "links")
    # the result is a few numbers per row: written, so that everything else can go
    joined = rows.join(classes, ["c1", "c2"], "left")
    own = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    result = table(joined.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), "text_hash", "component"), "linked")
    scratch.clear()
    return result
