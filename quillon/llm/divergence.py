"""Source divergence audit: how far the sources of a language differ in words, and by which words.

Terms are runs of letters (every character beyond ASCII counts as one); a
language keeps those that at least ``LEAST_DOCS`` of its documents hold. A
group, that is a source of a language or the language, gives a term the share
``p = 1 + floor(10**9 * (count + 1) / (N + V))``; the divergence of shares p and
q is ``floor((p - q)**2 / q)``. All arithmetic is on integers.

Pairs of sources are summed sparsely. Nearly all terms are missing in both, and
each of those adds the same baseline, so a pair's sum is V baselines plus a
correction for each term of the one, of the other and of both. Corrections of a
single source depend on the count alone, so terms with equal counts are summed
as one; tasks sum pairs before they send them.

Ranks are found by radix selection. Round by round a histogram of the next 16
bits of the values, counted where the rows are, tells for each group in which
bucket its last wanted rank lies; rows above are in, rows below are out, the
bucket's are refined further, and ties of whole values by the UTF-8 bytes of the
item. Once a bucket has at most ``FINISH`` rows, those and the rows above are
sorted, so a group's sort is bounded whatever its size.

Sizes: a task counts its documents before it sends (language, source, term)
rows, so a hot source or word is a row for each task. The driver holds the
groups, whose squares per language the result has.

Defined results: null texts, languages and sources are empty strings; repeated
rows count like others; a group without terms has pairs of value 0 or the
baseline and no term rows; an empty table gives an empty result. Input columns
may have any names.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import table

LEAST_DOCS = 3
MOST_RANKS = 200
SCALE = 10**9
#: rows of one group that are sorted at once
FINISH = 4096
DIGIT = 16
#: (language, source, term) rows that a task holds before it sends them
HELD = 300_000
#: pairs of sources that are expanded at once
PAIRS = 1 << 18
#: groups whose totals are broadcast
BROADCAST_GROUPS = 50_000
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LETTERS).split()


def count_terms(docs: DataFrame, text: str, language: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs), several rows of a key at most one for each task and flush."""

    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())

    def send(counts: dict):
        rows = ((*group, t.decode(), both >> 32, both & 0xFFFFFFFF) for group, own in counts.items() for t, both in own.items())
        while part := list(islice(rows, 1 << 14)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*part), kinds)], names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        counts: dict[tuple[str, str], dict[bytes, int]] = {}  # a term's occurrences, times 2**32, and documents
        held = 0
        for batch in batches:
            for t, lang, src in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = counts.setdefault((lang or "", src or ""), {})
                held -= len(own)
                get = own.get
                for term, n in Counter(terms(t)).items():
                    own[term] = get(term, 0) + (n << 32) + 1
                held += len(own)
                if held > HELD:
                    yield from send(counts)
                    counts, held = {}, 0
        yield from send(counts)

    return docs.select(text, language, source).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(counted: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, total, held: [(source, n)]), a row for each term that its language keeps."""
    per_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    per_term = per_source.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))
    return per_term.filter(F.col("docs") >= least_docs).drop("docs")


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10**9 * (count + 1) / whole), by long division in steps of 1000, so that nothing overflows."""
    left, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", left * 1000, whole)
        left = (left * 1000) % whole
    return out + 1


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    left, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // whole, left % whole
    return out + 1


def apart(p, q):
    return (p - q) * (p - q) // q


def pair_sums(kept: DataFrame, groups: list[tuple[str, str, int, int]]) -> DataFrame:
    """(a, b, part): corrections of ordered pairs of groups, as numbers in ``groups`` (lang, source, N, V)."""
    known = kept.sparkSession.sparkContext.broadcast(groups)

    def run(batches):
        groups = known.value
        number = {(lang, src): k for k, (lang, src, _, _) in enumerate(groups)}
        whole = np.array([n + v for _, _, n, v in groups], dtype=np.int64)
        base = shares(np.zeros(len(groups), np.int64), np.maximum(whole, 1))
        mates: dict[str, list[int]] = {}
        for k, (lang, *_) in enumerate(groups):
            mates.setdefault(lang, []).append(k)
        first = np.array([mates[lang][0] for lang, *_ in groups])
        size = np.array([len(mates[lang]) for lang, *_ in groups])

        def summed(a, b, value):
            keys = a * np.int64(len(groups)) + b
            distinct, at = np.unique(keys, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, at, value)
            return pa.RecordBatch.from_arrays([pa.array(distinct // len(groups)), pa.array(distinct % len(groups)), pa.array(total)], names=["a", "b", "part"])

        def spread(lengths):
            """For rows of so many entries each: the row of every entry, and its place in the row."""
            row = np.repeat(np.arange(len(lengths)), lengths)
            return row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

        for batch in batches:
            held = batch.column(1)
            ends = np.asarray(held.offsets)
            flat = held.values.slice(ends[0], ends[-1] - ends[0])
            lengths = np.diff(ends)
            langs = np.repeat(np.array(batch.column(0).to_pylist(), dtype=object), lengths)
            g = np.array([number[x] for x in zip(langs, flat.field(0).to_pylist())], dtype=np.int64)
            n = np.asarray(flat.field(1)).astype(np.int64)
            p = shares(n, whole[g]) if len(g) else n
            # a source's own terms, those of equal counts at once, against every other source of the language
            once, times = np.unique(np.stack([g, p]), axis=1, return_counts=True) if len(g) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
            for low in range(0, once.shape[1], max(1, PAIRS // max(1, int(size.max(initial=1))))):
                part = slice(low, low + max(1, PAIRS // max(1, int(size.max(initial=1)))))
                own, mine, count = once[0, part], once[1, part], times[part]
                row, place = spread(size[own])
                own, mine, count = own[row], mine[row], count[row]
                other = first[own] + place
                yield summed(own, other, count * (apart(mine, base[other]) - apart(base[own], base[other])))
                yield summed(other, own, count * (apart(base[other], mine) - apart(base[other], base[own])))
            # terms that two sources share: every entry with the entries of its term
            starts, mates_of = np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(lengths, lengths)
            upto = np.cumsum(mates_of)
            low = 0
            while low < len(upto):
                high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, "right")))
                row, place = spread(mates_of[low:high])
                x, y = row + low, starts[low:high][row] + place
                x, y = x[x != y], y[x != y]
                px, py, bx, by = p[x], p[y], base[g[x]], base[g[y]]
                yield summed(g[x], g[y], apart(px, py) - apart(px, by) - apart(bx, py) + apart(bx, by))
                low = high

    return kept.select("lang", "held").mapInArrow(run, "a long, b long, part long").filter("a != b").groupBy("a", "b").agg(F.sum("part").alias("part"))


def top_by_radix(rows: DataFrame, group: str, value: str, item: str, most: int) -> DataFrame:
    """The ``most`` rows of each group with the largest values (not negative), ties by the item's bytes: rows with ``rank``.

    A group's cut says which rows may still be in: those whose leading bits are
    above ``bits`` and, where these are equal, whose item begins with at most
    ``bytes``. ``need`` rows come from the bucket at the cut, ``size`` are in it.
    """
    plain = rows.select("*", F.col(item).cast("binary").alias("_raw"))
    cuts = None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        digit = F.shiftright(F.col(value), shift)
        if cuts is None:
            opened = plain.select(F.col(group).alias("_g"), digit.alias("_d"), F.lit(most).alias("_need"))
        else:
            held = cuts.filter("_size > _finish").select("_g", "_bits", "_need")
            if held.isEmpty():
                break
            opened = plain.join(held, (F.col(group) == F.col("_g")) & (F.shiftright(F.col(value), shift + DIGIT) == F.col("_bits"))).select("_g", digit.alias("_d"), "_need")
        counted = opened.groupBy("_g", "_d", "_need").agg(F.count(F.lit(1)).alias("_n"))  # at most 65,536 buckets a group
        new = _cut(counted, F.desc("_d")).select("_g", F.col("_d").alias("_bits"), F.lit(shift).alias("_shift"), F.unhex(F.lit("")).alias("_bytes"), F.lit(0).alias("_depth"), "_need", "_size", F.lit(FINISH).alias("_finish"))
        cuts = table(new if cuts is None else cuts.filter("_size <= _finish").unionByName(new), "cuts")
    depth = 0
    while not (held := cuts.filter("_size > _finish")).isEmpty():  # ties of whole values: two more bytes
        depth += 2
        tied = plain.join(held.select("_g", "_bits", "_bytes", "_need"), (F.col(group) == F.col("_g")) & (F.col(value) == F.col("_bits")) & (F.substring("_raw", 1, depth - 2) == F.col("_bytes")))
        counted = tied.groupBy("_g", "_bits", F.substring("_raw", 1, depth).alias("_d"), "_need").agg(F.count(F.lit(1)).alias("_n"))
        new = _cut(counted, F.asc("_d"), "_bits").select("_g", "_bits", F.lit(0).alias("_shift"), F.col("_d").alias("_bytes"), F.lit(depth).alias("_depth"), "_need", "_size", F.when(F.octet_length("_d") < depth, F.lit(2**31 - 1)).otherwise(F.lit(FINISH)).alias("_finish"))
        cuts = table(cuts.filter("_size <= _finish").unionByName(new), "cuts")
    lead = F.expr(f"shiftright({value}, _shift)")
    within = (lead > F.col("_bits")) | ((lead == F.col("_bits")) & (F.expr("substring(_raw, 1, _depth)") <= F.col("_bytes")))
    near = plain.join(cuts.select("_g", "_bits", "_shift", "_bytes", "_depth"), F.col(group) == F.col("_g")).filter(within)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), F.asc("_raw")))
    return near.withColumn("rank", rank).filter(F.col("rank") <= most).select(*rows.columns, "rank")


def _cut(counted: DataFrame, order: Column, *keep: str) -> DataFrame:
    """The bucket of each group in which its last needed row lies (its last bucket if it has fewer rows), what is needed of it and its size."""
    w = Window.partitionBy("_g").orderBy(order)
    summed = counted.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_last", F.lead("_n").over(w).isNull())
    at = summed.filter((F.col("_upto") - F.col("_n") < F.col("_need")) & ((F.col("_upto") >= F.col("_need")) | F.col("_last")))
    return at.select("_g", "_d", *keep, F.least(F.col("_need") - F.col("_upto") + F.col("_n"), F.col("_n")).cast("int").alias("_need"), F.col("_n").alias("_size"))


def audit(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source", *, least_docs: int = LEAST_DOCS, most: int = MOST_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    session = docs.sparkSession
    plain = docs.select(F.col(text).alias("text"), F.coalesce(F.col(language), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"))
    kept = table(kept_terms(count_terms(plain, "text", "lang", "source"), least_docs), "kept")
    flat = kept.select("lang", "term", "total", F.explode("held").alias("x")).select("lang", "term", "total", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"))
    groups = plain.select("lang", "source").distinct().join(flat.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left").join(per_lang, "lang", "left")
    found = sorted(tuple(r) for r in groups.select("lang", "source", F.coalesce("own", F.lit(0)), F.coalesce("v", F.lit(0)), F.coalesce("all", F.lit(0))).collect())
    numbers = session.createDataFrame([(k, *x) for k, x in enumerate(found)], "g long, lang string, source string, own long, v long, all long")
    if len(found) <= BROADCAST_GROUPS:
        numbers = F.broadcast(numbers)

    of = lambda side: numbers.select(F.col("g").alias(side), F.col("lang").alias(f"lang_{side}"), F.col("source").alias(f"source_{side}"), F.col("v").alias(f"v_{side}"), share(F.lit(0).cast("long"), F.greatest(F.col("own") + F.col("v"), F.lit(1))).alias(f"base_{side}"))
    sums = pair_sums(kept, [(lang, src, own, v) for lang, src, own, v, _ in found])
    pairs = of("a").join(of("b"), (F.col("lang_a") == F.col("lang_b")) & (F.col("a") != F.col("b"))).join(sums, ["a", "b"], "left")
    value = F.coalesce("part", F.lit(0)) + F.col("v_a") * F.expr("(base_a - base_b) * (base_a - base_b) div base_b")
    pairs = pairs.select(F.col("lang_a").alias("lang"), F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))

    sides = flat.join(numbers, ["lang", "source"]).select("g", "lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("own") + F.col("v")).alias("p"), share(F.col("total"), F.col("all") + F.col("v")).alias("q"))
    over = table(sides.filter("p > q").select("g", "lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value")), "over")
    best = top_by_radix(over, "g", "value", "item", most).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(best)
