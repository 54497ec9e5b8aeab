"""Exact deduplication by deterministic block naming.

A text, folded from A-Z to a-z, is cut into blocks of ``block_bytes`` bytes (the
last may be shorter; an empty text has one empty block). All distinct blocks are
sorted and numbered: a block's number is its name. Then every two adjacent names
of a text form a pair, all distinct pairs are sorted and numbered again, and so
on until each text has a single name. A lone last name is paired with 0, which
no block or pair has. Texts are equal if and only if their last names and the
levels at which they got them are.

Sizes: blocks move once, after each task has left out those that it has sent
already. On the way back a text's blocks are found by 128-bit keys, so that they
needn't move again; that no two distinct blocks share a key is checked on all
blocks, and another seed is taken otherwise, so names never collide. Every level
halves the rows, which are a few integers each, and texts that have their name
drop out. A block or text that a third of all rows hold is a hot key only in
joins, which Spark splits, and in sums, which are partial first.

Defined results: a null text equals an empty one; of equal texts the row with
the largest id stays, a null id is below all others, and of rows that repeat the
id one stays; an empty table gives an empty result. Input columns may have any
names; a carried one called like a result column is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import table, with_fields
from quillon.llm.words import FOLD, buffers

BLOCK_BYTES = 4096
#: bytes of blocks that a task remembers as sent
REMEMBERED = 48 << 20
#: bytes of blocks in one outgoing batch
BATCH = 4 << 20
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def folded(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, A-Z lower-cased; a null is empty."""
    raw, offsets = buffers(column)
    step = 1 << 22
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, "right")) - 1)
        part = FOLD[raw[offsets[i] : offsets[j]]].tobytes()
        for k in range(i, j):
            yield part[offsets[k] - offsets[i] : offsets[k + 1] - offsets[i]]
        i = j


def cut(raw: bytes, block_bytes: int) -> list[bytes]:
    return [raw[k : k + block_bytes] for k in range(0, max(1, len(raw)), block_bytes)]


Key = Callable[[bytes, int], tuple[int, int]]


def key(block: bytes, seed: int) -> tuple[int, int]:
    """A block's 128-bit key as two signed integers."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(block, seed=seed), dtype="<i8").tolist())


def _rows(docs: DataFrame, text: str, block_bytes: int, seed: int, keyed: Key) -> DataFrame:
    """docs without texts, with the digest of the folded text and the keys of its blocks."""
    slim = docs.drop(text)
    names = [f.name for f in slim.schema]

    def run(batches):
        for batch in batches:
            shas, highs, lows, ends = [], [], [], [0]
            for raw in folded(batch.column(batch.schema.get_field_index(text))):
                shas.append(hashlib.sha256(raw).hexdigest())
                pairs = [keyed(b, seed) for b in cut(raw, block_bytes)]
                highs += [p[0] for p in pairs]
                lows += [p[1] for p in pairs]
                ends.append(len(highs))
            keys = pa.StructArray.from_arrays([pa.array(highs, pa.int64()), pa.array(lows, pa.int64())], names=["h1", "h2"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(shas, pa.string()), lists], names=[*names, "sha", "keys"])

    pair = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])
    return docs.mapInArrow(run, with_fields(slim.schema, ("sha", T.StringType()), ("keys", T.ArrayType(pair))))


def _blocks(docs: DataFrame, text: str, block_bytes: int, seed: int, keyed: Key) -> DataFrame:
    """(h1, h2, block) of all blocks; a task sends a block again only after it had to forget it."""

    def run(batches):
        sent: set[bytes] = set()
        held = 0
        for batch in batches:
            new: list[bytes] = []
            size = 0
            for raw in folded(batch.column(0)):
                for b in cut(raw, block_bytes):
                    if b not in sent:
                        sent.add(b)
                        new.append(b)
                        size += len(b)
                        held += len(b) + 64
                    if size >= BATCH:
                        yield _block_batch(new, [keyed(b, seed) for b in new])
                        new, size = [], 0
                    if held > REMEMBERED:
                        sent, held = set(), 0
            if new:
                yield _block_batch(new, [keyed(b, seed) for b in new])

    return docs.select(text).mapInArrow(run, "h1 long, h2 long, block binary")


def _block_batch(blocks: list[bytes], keys: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(blocks, pa.binary())], names=["h1", "h2", "block"])


def numbered(distinct: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Distinct rows sorted within their partitions and numbered from 1: (keep, name), written once.

    A number holds the partition and the place in its order.
    """
    return table(distinct.sortWithinPartitions(*by).select(*keep, (F.monotonically_increasing_id() + 1).alias("name")), "names")


def block_names(docs: DataFrame, text: str, block_bytes: int, keyed: Key = key) -> tuple[DataFrame, int]:
    """(h1, h2, name) of every distinct block, and the seed under which keys are as distinct as blocks."""
    seed = 0
    while True:
        found = _blocks(docs, text, block_bytes, seed, keyed).distinct()
        names = numbered(found, ["block"], ["h1", "h2"])
        if names.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            return names, seed
        seed += 1


def identities(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(rid, identity): equal for equal texts and for no others. rows has (rid, keys)."""
    longest = rows.agg(F.max(F.size("keys"))).first()[0] or 1
    at = rows.select("rid", F.size("keys").alias("k"), F.posexplode("keys").alias("pos", "key")).select("rid", "k", "pos", "key.h1", "key.h2")
    level = table(at.join(names, ["h1", "h2"]).select("rid", "k", "pos", "name"), "level")
    depth, done = 0, []
    while True:
        done.append(level.filter("k = 1").select("rid", (F.col("name") * 64 + depth).alias("identity")))
        if longest <= 1:
            break
        even = F.col("pos") % 2 == 0
        pairs = level.filter("k > 1").groupBy("rid", "k", F.expr("pos div 2").cast("int").alias("pos")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("b"))
        named = numbered(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"])
        level = table(pairs.join(named, ["a", "b"]).select("rid", F.expr("(k + 1) div 2").cast("int").alias("k"), "pos", "name"), "level")
        longest, depth = (longest + 1) // 2, depth + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES, keyed: Key = key) -> DataFrame:
    """The columns ``carry`` (the id alone unless given) of every row, with ``RESULTS``."""
    carry = [c for c in ([doc_id] if carry is None else carry) if c not in RESULTS]
    names, seed = block_names(docs, text, block_bytes, keyed)
    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("d_id"), F.col(text).alias("d_text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    rows = table(_rows(slim, "d_text", block_bytes, seed, keyed), "rows")
    found = table(rows.drop("keys").join(identities(rows.select("rid", "keys"), names), "rid"), "identified")
    # written, so that the join deals out both sides and Spark can split a hot text's rows
    stays = table(found.groupBy("identity").agg(F.max(F.struct("d_id", "rid")).alias("stays"), F.count(F.lit(1)).alias("group_size")), "stays")
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]
    return found.join(stays, "identity").select(*back, F.col("stays.d_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("stays.rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that stay, whole."""
    plain = docs.toDF(*[f"in{i}_" for i in range(len(docs.columns))])
    name = lambda c: plain.columns[docs.columns.index(c)]
    return dedup(plain, name(doc_id), name(text), carry=plain.columns, block_bytes=block_bytes).filter("kept").select(*[F.col(p).alias(n) for p, n in zip(plain.columns, docs.columns)])
