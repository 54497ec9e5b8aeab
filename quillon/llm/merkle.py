"""A Merkle manifest of a dataset: a tree per group, one over the groups' roots, and a proof for every row.

Leaves are sorted by group, order column and digest (a range partitioning) and
numbered within their group, so a node is (group, level, index) and the size of
every group says how many children each parent has. Trees grow by events: a
digest that arrives is put into its partial parent; a parent whose children are
all there is hashed and arrives in turn at its own parent. A task does so for
pieces of ``PIECE`` neighbouring leaves; what is left, a few nodes at each
piece's two edges, is the frontier. Frontiers are shuffled by the ancestor
``STRIDE`` levels further up and grow again, until only the groups' roots are
left. Every growth keeps reverse links, from a node to the ancestor that it was
followed to and the siblings between; joined from the roots down, they give each
frontier node's path, and a leaf's proof is its siblings within the piece and
then that path.

Sizes: texts are read once and only digests are sorted; a row carries at most
32 bytes a level. The driver holds one count per partition and one root per
group, and no task more than a piece or the nodes below one ancestor.

Defined results: a null field counts as ``-``, which no value is written as; a
null group is a tree of its own, the first; a null order value comes first; ties
are in the order of their digests; repeated rows are leaves of their own; an
empty table gives an empty result. Input columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import table, with_fields

PIECE = 1 << 16
STRIDE = 12
#: rows of paths that are broadcast, each at most 32 bytes a level
BROADCAST_ROWS = 20_000
RESULTS = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

Node = tuple[int, int, int]


def written(value: Column) -> Column:
    """A field of a leaf: byte count, colon and value, or - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields, in hexadecimal."""
    return F.sha2(F.concat(*map(written, fields)), 256)


def join_digests(children: Iterable[bytes]) -> bytes:
    """A parent's digest: of its children's hexadecimal forms, one after the other."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


@dataclass
class Sizes:
    """Leaves of each group, and how many nodes and children that makes."""

    leaves: list[int]
    arity: int

    def top(self, g: int) -> int:
        level, n = 0, self.leaves[g]
        while n > 1:
            level, n = level + 1, -(-n // self.arity)
        return level

    def run(self, node: Node) -> int:
        """How many children a node of level 1 or more has."""
        g, level, j = node
        below = -(-self.leaves[g] // self.arity ** (level - 1))
        return min(self.arity, below - j * self.arity)


def grow(nodes: list[tuple[Node, bytes]], sizes: Sizes) -> list[tuple[Node, bytes, bytes]]:
    """For each node the ancestor that it can be followed to, that one's digest, and the siblings on the way."""
    tops = {g: sizes.top(g) for g in {n[0] for n, _ in nodes}}
    partial: dict[Node, dict[int, bytes]] = {}
    full: dict[Node, list[bytes]] = {}
    digest = dict(nodes)
    for node, d in nodes:
        while node[1] < tops[node[0]]:
            parent = (node[0], node[1] + 1, node[2] // sizes.arity)
            held = partial.setdefault(parent, {})
            held[node[2] % sizes.arity] = d
            if len(held) < sizes.run(parent):
                break
            full[parent] = [held[k] for k in range(len(held))]
            del partial[parent]
            node, d = parent, join_digests(full[parent])
            digest[node] = d
    ends: dict[Node, tuple[Node, bytes]] = {}

    def end(node: Node) -> tuple[Node, bytes]:
        climbed = []
        while node not in ends:
            parent = (node[0], node[1] + 1, node[2] // sizes.arity)
            if parent not in full:
                ends[node] = (node, b"")
                break
            climbed.append((node, parent))
            node = parent
        for child, parent in reversed(climbed):
            k = child[2] % sizes.arity
            siblings = b"".join(full[parent][:k] + full[parent][k + 1 :])
            ends[child] = (ends[parent][0], siblings + ends[parent][1])
        return ends[climbed[0][0]] if climbed else ends[node]

    out = []
    for node, _ in nodes:
        up, path = end(node)
        out.append((up, digest[up], path))
    return out


def fold(d: bytes, j: int, n: int, arity: int, path: bytes, at: int = 0) -> tuple[bytes, int]:
    """The root that a hexadecimal digest at place j of n leads to, with the path's hexadecimal siblings; and where it stopped reading."""
    while n > 1:
        first = j // arity * arity
        others = min(arity, n - first) - 1
        k = at + 64 * (j - first)
        d = hashlib.sha256(path[at:k] + d + path[k : at + 64 * others]).hexdigest().encode()
        at += 64 * others
        j, n = j // arity, -(-n // arity)
    return d, at


UP = (("up_level", T.IntegerType()), ("up_j", T.LongType()), ("up_digest", T.BinaryType()), ("path", T.BinaryType()))


def _batch(rows: list[pa.RecordBatch], grown: list[tuple[Node, bytes, bytes]], add: list[tuple[str, pa.Array]]) -> Iterable[pa.RecordBatch]:
    whole = pa.Table.from_batches(rows)
    for name, values in [*add, ("up_level", pa.array([u[1] for u, _, _ in grown], pa.int32())), ("up_j", pa.array([u[2] for u, _, _ in grown], pa.int64())), ("up_digest", pa.array([d for _, d, _ in grown], pa.binary())), ("path", pa.array([p for _, _, p in grown], pa.binary()))]:
        whole = whole.append_column(name, values)
    return whole.to_batches(max_chunksize=8192)


def _pieces(batches: Iterable[pa.RecordBatch], size: int = PIECE) -> Iterable[list[pa.RecordBatch]]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            room = size - sum(b.num_rows for b in held)
            held.append(batch.slice(at, room))
            at += held[-1].num_rows
            if held[-1].num_rows == room:
                yield held
                held = []
    if held:
        yield held


def _column(rows: list[pa.RecordBatch], name: str) -> list:
    return [x for b in rows for x in b.column(b.schema.get_field_index(name)).to_pylist()]


def grow_leaves(ordered: DataFrame, shifts: dict, sizes: Sizes, piece: int) -> DataFrame:
    """ordered with each leaf's group number, place in the group, ancestor in the piece and siblings up to it."""
    known = ordered.sparkSession.sparkContext.broadcast(shifts)

    def run(batches):
        for rows in _pieces(batches, piece):
            at = [known.value[p, g] for p, g in zip(_column(rows, "part"), _column(rows, "s_group"))]
            places = [pos + shift for pos, (_, shift) in zip(_column(rows, "pos"), at)]
            nodes = [((g, 0, i), bytes.fromhex(h)) for (g, _), i, h in zip(at, places, _column(rows, "s_leaf"))]
            yield from _batch(rows, grow(nodes, sizes), [("g", pa.array([g for g, _ in at], pa.int32())), ("i", pa.array(places, pa.int64()))])

    return ordered.mapInArrow(run, with_fields(ordered.schema, ("g", T.IntegerType()), ("i", T.LongType()), *UP))


def grow_frontier(frontier: DataFrame, level: int, sizes: Sizes) -> DataFrame:
    """Nodes (g, level, j, digest) followed to their ancestor at ``level`` at least, or to their root."""
    steps = F.greatest(F.lit(0), F.lit(level) - F.col("level"))
    keyed = frontier.withColumn("key", F.floor(F.col("j") / F.pow(F.lit(float(sizes.arity)), steps)).cast("long")).repartition("g", "key").sortWithinPartitions("g", "key", "level", "j")

    def flush(rows):
        nodes = [((g, level, j), d) for g, level, j, d in zip(*(_column(rows, c) for c in ("g", "level", "j", "digest")))]
        return _batch(rows, grow(nodes, sizes), [])

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(batch.column(batch.schema.get_field_index("g")).to_pylist(), batch.column(batch.schema.get_field_index("key")).to_pylist()))
            edges = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
            for low, high in zip(edges, [*edges[1:], len(keys)]):
                if keys[low] != last and sum(b.num_rows for b in held) >= 1 << STRIDE:
                    yield from flush(held)
                    held = []
                held.append(batch.slice(low, high - low))
                last = keys[low]
        if held:
            yield from flush(held)

    return keyed.mapInArrow(run, with_fields(keyed.schema, *UP))


def _ordered(leaves: DataFrame) -> DataFrame:
    """Leaves sorted over all partitions, with their partition and their place in it."""
    by = ["s_group", "s_order", "s_leaf", "tie"]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return table(leaves.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("part"), place.alias("pos")).drop("tie"), "ordered")


def manifest(docs: DataFrame, fields: list[Column], group: str, order: str, *, claimed: Column | None = None, carry: list[str] | None = None, arity: int = 2, piece: int = PIECE, stride: int = STRIDE) -> DataFrame:
    """The columns ``carry`` of every row with its leaf, roots and proof, and what a claimed leaf leads to.

    ``fields`` are what a leaf covers; ``claimed`` is the leaf that someone
    presents for the row (null: the row's own), which the proof must lead to
    ``root``: ``verified``. Beside ``RESULTS`` come ``g``, the group's number;
    ``i``, the leaf's place in it; and ``proof``, the siblings' raw digests.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (*RESULTS, "g", "i", "proof")]
    presented = F.lit(None).cast("string") if claimed is None else claimed
    leaves = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)], F.col(group).alias("s_group"), F.col(order).alias("s_order"), leaf(*fields).alias("s_leaf"), presented.alias("claimed"), F.monotonically_increasing_id().alias("tie"))
    ordered = _ordered(table(leaves, "leaves"))
    runs = ordered.groupBy("part", "s_group").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).collect()  # a count for each partition, and one more for each group
    groups = sorted({r["s_group"] for r in runs}, key=lambda x: (x is not None, x.encode() if isinstance(x, str) else x))
    number = {x: k for k, x in enumerate(groups)}
    sizes, shifts = Sizes([0] * len(groups), arity), {}
    for r in sorted(runs, key=lambda r: r["part"]):
        g = number[r["s_group"]]
        shifts[r["part"], r["s_group"]] = (g, sizes.leaves[g] - r["first"])
        sizes.leaves[g] += r["n"]

    grown = table(grow_leaves(ordered, shifts, sizes, piece).drop("part", "pos", "s_group", "s_order"), "grown")
    ends = lambda links: links.select("g", F.col("up_level").alias("level"), F.col("up_j").alias("j"), F.col("up_digest").alias("digest")).distinct()
    links: list[DataFrame] = []
    step = max(1, stride // max(1, (arity - 1).bit_length()))
    tops = [sizes.top(g) for g in range(len(groups))]
    frontier, level = ends(grown), step
    while True:
        links.append(table(grow_frontier(frontier, level, sizes), "links"))
        frontier = ends(links[-1])
        if level >= max(tops, default=0):
            break
        level += step
    roots = {r["g"]: bytes(r["digest"]) for r in frontier.collect()}  # one for each group
    above = grow([((0, 0, g), roots[g]) for g in range(len(groups))], Sizes([len(groups)], arity))
    root = above[0][1].hex() if above else ""
    session = docs.sparkSession
    reach = session.createDataFrame([(g, tops[g], 0, bytes(path)) for g, (_, _, path) in enumerate(above)], "up_g int, top_level int, top_j long, tail binary")
    for found in reversed(links):
        reach = found.join(reach, (F.col("g") == F.col("up_g")) & (F.col("up_level") == F.col("top_level")) & (F.col("up_j") == F.col("top_j")))
        reach = reach.select(F.col("g").alias("up_g"), F.col("level").alias("top_level"), F.col("j").alias("top_j"), F.concat("path", "tail").alias("tail"))
    reach = table(reach, "paths")
    if reach.count() <= BROADCAST_ROWS:
        reach = F.broadcast(reach)
    joined = grown.join(reach, (F.col("g") == F.col("up_g")) & (F.col("up_level") == F.col("top_level")) & (F.col("up_j") == F.col("top_j")))
    joined = joined.select(*[f"c{k}" for k in range(len(carry))], "s_leaf", "claimed", "g", "i", F.concat("path", "tail").alias("proof"))
    known = session.sparkContext.broadcast((sizes.leaves, [roots[g].hex() for g in range(len(groups))], root))

    def prove(batches):
        leaves, subroots, root = known.value
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            subs, proofs, folded = [], [], []
            for own, other, g, i, raw in zip(*(column(c) for c in ("s_leaf", "claimed", "g", "i", "proof"))):
                path = raw.hex().encode()
                d, at = fold((other or own).encode(), i, leaves[g], arity, path)
                d, _ = fold(d, g, len(leaves), arity, path, at)
                subs.append(subroots[g])
                proofs.append(hashlib.sha256(path).hexdigest())
                folded.append(d.decode())
            new = [pa.array(subs, pa.string()), pa.array([root] * len(subs), pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *RESULTS[1:]])

    strings = [(c, T.StringType()) for c in RESULTS[1:-1]]
    proved = joined.mapInArrow(prove, with_fields(joined.schema, *strings, ("verified", T.BooleanType())))
    return proved.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)], F.col("s_leaf").alias("leaf"), *RESULTS[1:], "g", "i", "proof")
