"""Benchmark decontamination: size-partitioned MinHash containment search.

Finds test items of which a document holds at least ``percent`` per cent of the
distinct word shingles. A short item inside a long document has a tiny Jaccard
similarity with it, so items are partitioned by set size, and for the partition
with sizes up to U a document is cut into windows of 2U shingles that start
every U: a passage of up to U shingles lies whole in one window, and its
similarity with it is at least 0.19. Partitions start at one shingle. With
``PERMUTATIONS`` minima the chance of missing one is below 0.81 ** 48 (under 1
in 20,000). Window minima are made once for the smallest partition's stride and
merged upwards for the others. Every candidate is verified by exact containment
against the whole document's shingles. The search finds passages: an item whose
shingles are scattered over a document, farther apart than its partition's
window, is only found if one window holds enough of them.

An item with fewer words than a shingle is one shingle of all its words, which
is looked up among the document's word n-grams of that length.

The items are the stated query set: they are taken in blocks of ``BLOCK_ITEMS``
and each block is searched for in all documents in one narrow pass (no
shuffle); what is broadcast is bounded by the block. With several blocks each
pass returns only the hits, keyed by two hashes of the text, which are joined
to the documents once; the documents aren't written between passes.

Defined results: null or empty texts contain nothing; items that are null or
without words are never found; items with equal texts are each reported, and so
is one with a null id (with that null); repeated documents are each annotated;
without documents or items there are no hits. Words are split at ASCII white
space and A-Z are lower-cased. Input columns may have any names; one that is
called like the result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import positional, table, with_fields
from quillon.llm.words import chunks, ngrams

PERMUTATIONS = 48
BLOCK_ITEMS = 20_000
BLOCK_SHINGLES = 2_000_000
_U = np.uint64
_FACTOR = np.random.default_rng(77).integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * _U(2) + _U(1)
_FILTER_BITS = 18
HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("n_found", T.LongType())])


class Items:
    """MinHash tables of one block of items, by size partition; and the hashes of short items, by words."""

    def __init__(self, ids: list[int | None], sets: list[np.ndarray], short: dict[int, list[tuple[int, int | None]]]):
        self.ids, self.sets = ids, sets
        self.short = {n: (np.array(sorted({h for h, _ in own}), np.uint64), own) for n, own in short.items()}
        self.parts: dict[int, list] = {}
        members: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                members.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
        for upto, own in sorted(members.items()):
            tables = []
            for f in _FACTOR:
                with np.errstate(over="ignore"):
                    least = np.array([(sets[i] * f).min() for i in own])
                order = np.argsort(least)
                might = np.zeros(1 << _FILTER_BITS, bool)
                might[(least >> _U(64 - _FILTER_BITS - 6)) & _U((1 << _FILTER_BITS) - 1)] = True
                tables.append((least[order], np.array(own)[order], might))
            self.parts[upto] = tables

    def short_hits(self, words: np.ndarray) -> list[tuple[int | None, int, int]]:
        """Hits of the items with fewer words than a shingle, in one row's words."""
        found = []
        for n, (wanted, own) in self.short.items():
            held = set(np.intersect1d(wanted, ngrams(words, n)).tolist())
            found += [(i, 1, 1) for h, i in own if h in held]
        return found

    def hits(self, grams: np.ndarray, at: np.ndarray, percent: int) -> dict[int, list[tuple[int, int, int]]]:
        """row -> hits; row i's shingles, in order, are grams[at[i]:at[i+1]]."""
        found: set[tuple[int, int]] = set()
        if not len(grams) or not self.parts:
            return {}
        sizes = np.diff(at)
        stride = min(self.parts)
        per_row = -(-sizes // stride)
        row = np.repeat(np.arange(len(sizes)), per_row)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        starts = at[row] + nth * stride
        least = np.empty((PERMUTATIONS, len(row)), np.uint64)
        with np.errstate(over="ignore"):
            for k, f in enumerate(_FACTOR):
                least[k] = np.minimum.reduceat(grams * f, starts)
        for upto, tables in self.parts.items():
            while stride < upto:
                even = np.flatnonzero(nth % 2 == 0)
                least = np.minimum.reduceat(least, even, axis=1)
                row, nth, stride = row[even], nth[even] // 2, stride * 2
            last = np.append(row[1:] != row[:-1], True)
            for k, (values, own, might) in enumerate(tables):
                window = least[k].copy()
                np.minimum(window[:-1], least[k][1:], out=window[:-1], where=~last[:-1])
                pick = np.flatnonzero(might[(window >> _U(64 - _FILTER_BITS - 6)) & _U((1 << _FILTER_BITS) - 1)])
                lo, hi = np.searchsorted(values, window[pick], "left"), np.searchsorted(values, window[pick], "right")
                for w, a, b in zip(pick[hi > lo], lo[hi > lo], hi[hi > lo]):
                    found.update((int(row[w]), int(i)) for i in own[a:b])
        out: dict[int, list[tuple[int, int, int]]] = {}
        now, have = -1, np.zeros(0, np.uint64)
        for r, i in sorted(found):
            if r != now:
                now, have = r, np.unique(grams[at[r] : at[r + 1]])
            want = self.sets[i]
            spot = np.minimum(np.searchsorted(have, want), len(have) - 1)
            n = int(np.count_nonzero(have[spot] == want))
            if n * 100 >= percent * len(want):
                out.setdefault(r, []).append((self.ids[i], len(want), n))
        return out


def _blocks(items: DataFrame, item_id: str, text: str, width: int) -> Iterator[Items]:
    """The items in blocks of bounded size."""
    ids, sets, short, total, n = [], [], {}, 0, 0
    for row in items.select(F.col(item_id).cast("long"), text).toLocalIterator(prefetchPartitions=False):
        for c in chunks(pa.array([row[1]], pa.string()), fold=True):
            words = c.row(0)
            if not len(words):
                continue
            n += 1
            if len(words) < width:
                short.setdefault(len(words), []).append((int(ngrams(words, len(words))[0]), row[0]))
            else:
                own = np.unique(ngrams(words, width))
                ids.append(row[0])
                sets.append(own)
                total += len(own)
        if n >= BLOCK_ITEMS or total >= BLOCK_SHINGLES:
            yield Items(ids, sets, short)
            ids, sets, short, total, n = [], [], {}, 0, 0
    if n:
        yield Items(ids, sets, short)


def _searched(docs: DataFrame, at: int, block: Items, width: int, percent: int) -> DataFrame:
    """docs with the block's hits in their last column ``found``."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    names = [*docs.columns, "found"]

    def run(batches):
        for batch in batches:
            hits: list[list] = [[] for _ in range(batch.num_rows)]
            for c in chunks(batch.column(at), fold=True):
                grams = [ngrams(c.row(i), width) for i in range(c.last - c.first)]
                edge = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int64)
                for r, own in shared.value.hits(np.concatenate(grams), edge, percent).items():
                    hits[c.first + r] += [dict(zip(HIT.names, h)) for h in own]
                if shared.value.short:
                    for i in range(c.last - c.first):
                        hits[c.first + i] += [dict(zip(HIT.names, h)) for h in shared.value.short_hits(c.row(i))]
            kind = pa.list_(pa.struct([(f, pa.int64()) for f in HIT.names]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, kind)], names=names)

    return docs.mapInArrow(run, with_fields(docs.schema, ("found", T.ArrayType(HIT))))


def annotate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, percent: int = 80, out: str = "hits") -> DataFrame:
    """docs with an array of (item_id, n_item, n_found) of the items found in each."""
    plain, name, back = positional(docs)
    blocks = list(_blocks(items, item_id, item_text, width)) if items.limit(BLOCK_ITEMS).count() < BLOCK_ITEMS else None
    if blocks is not None and len(blocks) < 2:
        done = _searched(plain, docs.columns.index(text), blocks[0], width, percent) if blocks else plain.withColumn("found", F.array().cast(T.ArrayType(HIT)))
        return back(done.withColumnRenamed("found", out), out)
    # hits depend on the text alone
    key = [F.xxhash64(name(text)).alias("h1"), F.xxhash64(F.lit(1), name(text)).alias("h2")]
    every: DataFrame | None = None
    for block in blocks or _blocks(items, item_id, item_text, width):
        hit = _searched(plain.select(name(text), *key), 0, block, width, percent).filter(F.size("found") > 0)
        hit = table(hit.select("h1", "h2", "found").dropDuplicates(["h1", "h2"]), "hits")
        every = hit if every is None else every.union(hit)
    whole = every.groupBy("h1", "h2").agg(F.flatten(F.collect_list("found")).alias(out))
    done = plain.select("*", *key).join(whole, ["h1", "h2"], "left")
    return back(done.withColumn(out, F.coalesce(out, F.array().cast(T.ArrayType(HIT)))), out)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, item_id, n_item, n_found) of every document and item that reach the threshold."""
    found = annotate(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, **how)
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.n_item", "h.n_found")


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", **how) -> DataFrame:
    """The documents in which no item was found, with their own columns."""
    plain, name, back = positional(docs)
    return back(annotate(plain, items, text=name(text), out="found_", **how).filter(F.size("found_") == 0))
