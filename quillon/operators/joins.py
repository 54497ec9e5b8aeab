"""Join operators: lookups with fallbacks, overlay merge, term search, box joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import geometry as G
from quillon.sources.shared import written

#: terms of one automaton, and their characters; a longer list is taken in blocks
TERM_ROWS, TERM_CHARS = 50_000, 2_000_000


def lookup_with_fallback(left: DataFrame, right: DataFrame, keys: list[str], right_key: str, value: str, out: str) -> DataFrame:
    """left with ``value`` of the first key in order that right knows, or null. right's keys are unique."""
    found = left
    for i, k in enumerate(keys):
        side = right.select(F.col(right_key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        found = found.join(side, F.col(k) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    return found.withColumn(out, F.coalesce(*[F.col(f"_v{i}") for i in range(len(keys))])).drop(*[f"_v{i}" for i in range(len(keys))])


def overlay(base: DataFrame, top: DataFrame, key: str, columns: list[str], position: str) -> DataFrame:
    """Rows of base, replaced in place where top has the key, then top's other rows in order."""
    b = base.select(F.col(key).alias("_b"), F.col(position).alias("_p"), *[F.col(c).alias(f"b_{c}") for c in columns])
    o = top.select(F.col(key).alias("_o"), F.col(position).alias("_q"), *[F.col(c).alias(f"o_{c}") for c in columns])
    both = b.join(o, F.col("_b") == F.col("_o"), "full_outer")
    pick = [F.when(F.col("_o").isNotNull(), F.col(f"o_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in columns]
    return both.select(F.coalesce("_b", "_o").alias(key), *pick, F.col("_b").isNull().cast("int").alias("block"), F.coalesce("_p", "_q").alias("position"))


def term_matches(texts: DataFrame, text: str, terms: DataFrame, term: str, whole_words: bool) -> DataFrame:
    """Every pair of a text and a term that occurs in it, letter case aside.

    An Aho-Corasick automaton of the terms reads every text once, where it is;
    a longer term list is taken in blocks of bounded size. For whole words the
    characters on either side of a hit must not be ASCII letters or digits.
    """
    found = None
    listed = terms.select(F.col(term).alias("t"), F.lower(term).alias("low")).distinct().filter("length(low) > 0")
    lowered = texts.withColumn("_low", F.lower(text))
    size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("low")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // TERM_ROWS), -(-size[1] // TERM_CHARS))
    for b in range(blocks):
        part = {}
        for t, low in listed.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).toLocalIterator():  # at most about TERM_ROWS terms
            part.setdefault(low, []).append(t)
        one = _holding(lowered, "_low", part, whole_words).drop("_low")
        found = one if found is None else found.unionByName(one)
    return found.join(terms, F.col("_term") == F.col(term)).drop("_term")


WORDLIKE = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def _holding(texts: DataFrame, text: str, terms: dict[str, list[str]], whole_words: bool) -> DataFrame:
    """texts with ``_term``: a row for each term whose key occurs in the text, by one pass of an automaton over it."""
    at = texts.columns.index(text)
    names = [*texts.columns, "_term"]

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for key in terms:
            automaton.add_word(key, key)
        automaton.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for i, value in enumerate(batch.column(at).to_pylist() if terms else ()):
                value = value or ""
                apart = lambda at, end: (at == 0 or value[at - 1] not in WORDLIKE) and (end == len(value) or value[end] not in WORDLIKE)  # noqa: B023, E731
                for key in {k for last, k in automaton.iter(value) if not whole_words or apart(last + 1 - len(k), last + 1)}:
                    rows += [i] * len(terms[key])
                    hits += terms[key]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int64())).columns, pa.array(hits, pa.string())], names=names)

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("_term", T.StringType())]))


def containing_box(points: DataFrame, boxes: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Each point with the box of its page that holds it; of several, the one with the nearest centre, then least id.

    ``boxes`` has box_id, x0, y0, x1, y1 and the columns ``by``; the join is keyed by page.
    """
    b = boxes.select(*[F.col(c).alias(f"_{c}") for c in by], "box_id", F.col("x0").alias("bx0"), F.col("y0").alias("by0"), F.col("x1").alias("bx1"), F.col("y1").alias("by1"))
    on = [F.col(c) == F.col(f"_{c}") for c in by]
    inside = F.col(x).between(F.col("bx0"), F.col("bx1")) & F.col(y).between(F.col("by0"), F.col("by1"))
    d = F.pow((F.col("bx0") + F.col("bx1")) / 2 - F.col(x), 2) + F.pow((F.col("by0") + F.col("by1")) / 2 - F.col(y), 2)
    joined = points.join(b, [*on, inside], "inner").withColumn("_d", d)
    return joined.groupBy(*points.columns).agg(F.min_by("box_id", F.struct("_d", "box_id")).alias("box_id"))


def overlapping(left: DataFrame, right: DataFrame, by: list[str], least: float = 0.0) -> DataFrame:
    """Pairs of boxes of a page that overlap, with area and intersection over union."""
    r = right.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("box_id").alias("other_id"), *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    on = [F.col(c) == F.col(f"_{c}") for c in by]
    cross = (F.col("x0") < F.col("rx1")) & (F.col("rx0") < F.col("x1")) & (F.col("y0") < F.col("ry1")) & (F.col("ry0") < F.col("y1"))
    shared = G.overlap(F.col("x0"), F.col("x1"), F.col("rx0"), F.col("rx1")) * G.overlap(F.col("y0"), F.col("y1"), F.col("ry0"), F.col("ry1"))
    total = G.area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) + G.area(F.col("rx0"), F.col("ry0"), F.col("rx1"), F.col("ry1")) - F.col("shared")
    pairs = left.join(r, [*on, cross]).withColumn("shared", shared).withColumn("iou", F.col("shared") / total)
    return pairs.filter(F.col("iou") > least).select(*by, "box_id", "other_id", "shared", "iou")


def nearest_below(left: DataFrame, right: DataFrame, by: list[str], most: float) -> DataFrame:
    """Each box with the nearest box of its page that starts below it, overlaps it in x and is within ``most``."""
    r = right.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("box_id").alias("below_id"), F.col("x0").alias("rx0"), F.col("x1").alias("rx1"), F.col("y0").alias("ry0"))
    on = [F.col(c) == F.col(f"_{c}") for c in by]
    near = (F.col("ry0") >= F.col("y1")) & (F.col("ry0") - F.col("y1") <= most) & (F.col("x0") < F.col("rx1")) & (F.col("rx0") < F.col("x1"))
    pairs = left.join(r, [*on, near])
    return pairs.groupBy(*by, "box_id").agg(F.min_by("below_id", F.struct(F.col("ry0") - F.col("y1"), F.col("below_id"))).alias("below_id"), F.min(F.col("ry0") - F.col("y1")).alias("gap"))


def split_cached(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests that the cache answers and those that it doesn't."""
    return requests.join(cache, key, "left_semi"), requests.join(cache, key, "left_anti")


def chains(edges: DataFrame) -> DataFrame:
    """(chain, position, node) of the paths that edges prev -> next form; at most one edge leaves or enters a node.

    Done by pointer doubling: the number of rounds is the logarithm of the
    longest chain. A cycle has no head, so its nodes are in no chain: after as
    many rounds as any path can need, what still has a node above is on one.
    """
    nodes = edges.select(F.col("prev").alias("node")).union(edges.select("next")).distinct()
    now = nodes.join(edges.select(F.col("next").alias("node"), F.col("prev").alias("up")), "node", "left").select("node", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("d"))
    now = written(now, "chains")
    for _ in range(now.count().bit_length() + 1):
        step = now.select(F.col("node").alias("n2"), F.col("up").alias("up_up"), F.col("d").alias("d2"))
        both = now.join(step, F.col("up") == F.col("n2"), "left")
        after = written(both.select("node", F.coalesce("up_up", "up").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), F.col("up_up").isNotNull().alias("moved")), "chains")
        now = after.drop("moved")
        if after.filter("moved").limit(1).count() == 0:
            return now.select(F.coalesce("up", "node").alias("chain"), F.col("d").alias("position"), "node")
    heads = now.filter("up is null").select(F.col("node").alias("head"))
    return now.join(heads, F.coalesce("up", "node") == F.col("head"), "left_semi").select(F.coalesce("up", "node").alias("chain"), F.col("d").alias("position"), "node")


def exactly_one(pairs: DataFrame, key: str) -> DataFrame:
    """Pairs whose key has no other pair."""
    return pairs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).filter("_n = 1").drop("_n")


def missing_inputs(jobs: DataFrame, artifacts: DataFrame, key: str, kind: str, required: tuple[str, ...], source: str | None = None) -> DataFrame:
    """(key, missing): jobs that lack inputs they need, of their own or of the job named in ``source``, in the order of ``required``.

    Of a job's artifacts one flag for each needed kind is kept, so sums have a fixed size and Spark can spill them.
    """
    flags = [f"_held_{i}" for i in range(len(required))]
    own = artifacts.filter(F.col(kind).isin(*required)).groupBy(F.col(key).alias("_job")).agg(*[F.max(F.col(kind) == r).alias(f) for f, r in zip(flags, required)])
    found = jobs.join(own, F.col(key) == F.col("_job"), "left").drop("_job")
    if source is not None:
        theirs = own.select("_job", *[F.col(f).alias(f"_other{f}") for f in flags])
        found = found.join(theirs, F.col(source) == F.col("_job"), "left").drop("_job").withColumns({f: F.coalesce(f, F.lit(False)) | F.coalesce(f"_other{f}", F.lit(False)) for f in flags})
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(f, F.lit(False)), F.lit(r)) for f, r in zip(flags, required)]))
    return found.select(key, missing.alias("missing")).filter(F.size("missing") > 0)
