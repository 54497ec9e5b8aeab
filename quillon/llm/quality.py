"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document is measured by a set of ratios in parts per million. For each
language and source a sketch per ratio is kept, over the documents that pass the
base rule: a histogram over integer buckets that hold a value's five leading
bits, so relative error is at most 1/32. Merging two sketches adds their counts,
so the result depends neither on the order of merges nor on partitioning, and a
hot source is summed on the map side first. The threshold of a group is its
upper quartile plus ``spread`` interquartile ranges. Where quartiles coincide,
as in ratios that are 0 in most documents, it is the ``TAIL`` quantile instead.
No constant is added to either. Quartiles take ``least_docs`` documents and
tails ``tail_docs``; a group with fewer uses its language's merged sketch, then
that of all documents. Documents are joined with their group's thresholds and
filtered.

Defined results: a null or empty text has no words and fails the base rule;
null languages or sources form groups of their own; equal texts in one group
get equal verdicts; an empty table gives an empty result. Input columns may have
any names; one called like a result column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import settled, table, with_fields
from quillon.llm.words import chunks, ngrams

RATIOS = ("r_symbols", "r_dup_lines", "r_repeat", "r_again", "r_upper", "r_length")
LEADING_BITS = 5
SPREAD = 8
#: a quantile as numerator and denominator
TAIL = (995, 1000)
LEAST_DOCS, TAIL_DOCS = 100, 1000
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_again", "n_upper")


def repeated_words(hashes: np.ndarray, n: int = 5) -> int:
    """Words inside n-word windows that occur twice or more."""
    grams = ngrams(hashes, n)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    for hit in (order[1:][same], order[:-1][same]):
        hit = np.unique(hit)
        edge[hit] += 1
        edge[hit + n] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def measure_column(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text."""
    out = {m: np.zeros(len(column), dtype=np.int64) for m in MEASURES}
    for c in chunks(column):
        raw, offs = c.raw, c.offsets
        rows = slice(c.first, c.last)
        per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])
        lead = (raw & 0xC0) != 0x80
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        out["n_words"][rows] = np.diff(c.doc_at)
        out["word_chars"][rows] = per(lead & ~space)
        out["n_symbols"][rows] = per(_SYMBOL[raw])
        out["n_upper"][rows] = per((raw >= 65) & (raw <= 90))
        for i in range(c.last - c.first):
            h = c.row(i)
            lines = [x for x in raw[offs[i] : offs[i + 1]].tobytes().split(b"\n") if x and not x.isspace()]
            out["n_lines"][c.first + i] = len(lines)
            out["n_dup_lines"][c.first + i] = len(lines) - len(set(lines))
            out["n_repeat_words"][c.first + i] = repeated_words(h)
            out["n_again"][c.first + i] = np.count_nonzero(h[1:] == h[:-1])
    return out


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one long column for each of ``MEASURES``."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            got = measure_column(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(got[m]) for m in MEASURES)], names=[*batch.schema.names, *MEASURES])

    return docs.mapInArrow(settled(run), with_fields(docs.schema, *((m, T.LongType()) for m in MEASURES)))


def ratios(measured: DataFrame) -> DataFrame:
    """The ratios in parts per million, 0 where the denominator is 0."""
    of = lambda a, b: F.when(F.col(b) > 0, F.expr(f"{a} * 1000000 div {b}")).otherwise(F.lit(0)).cast("long")
    return measured.withColumns({"r_symbols": of("n_symbols", "word_chars"), "r_dup_lines": of("n_dup_lines", "n_lines"), "r_repeat": of("n_repeat_words", "n_words"), "r_again": of("n_again", "n_words"), "r_upper": of("n_upper", "word_chars"), "r_length": of("word_chars", "n_words")})


def bucket(value: Column) -> Column:
    """A value's bucket in the sketch: all but its leading bits cleared."""
    cut = F.greatest(F.lit(0), F.length(F.bin(value)) - LEADING_BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def sketches(rated: DataFrame, by: list[str]) -> DataFrame:
    """One row per group, ratio and bucket: (by, ratio, bucket, n)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), bucket(F.col(r)).alias("bucket")) for r in RATIOS])).alias("x")
    return rated.select(*by, pairs).select(*by, "x.ratio", "x.bucket").groupBy(*by, "ratio", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, by: list[str], spread: int) -> DataFrame:
    """One row per group: documents, and each ratio's limit by quartiles (null where they coincide) and by the tail.

    A group's buckets number at most 32 per power of two, so sorting them into
    one array is bounded whatever the number of documents. A tail is the upper
    end of its bucket, so that the bucket's values are within it.
    """
    rows = sketch.groupBy(*by, "ratio").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("hist"))
    step = lambda num, den: F.expr(f"aggregate(hist, named_struct('seen', 0L, 'at', 0L), (s, x) -> named_struct('seen', s.seen + x.n, 'at', IF(s.seen * {den} < total * {num}, x.bucket, s.at)), s -> s.at)")
    rows = rows.select(*by, "ratio", "total", step(1, 4).alias("q1"), step(3, 4).alias("q3"), step(*TAIL).alias("q"))
    most = F.when(F.col("q3") > F.col("q1"), F.col("q3") + spread * (F.col("q3") - F.col("q1")))
    end = F.expr(f"q + shiftleft(1L, greatest(0, length(bin(q)) - {LEADING_BITS})) - 1")
    rows = rows.withColumns({"most": most, "tail": end})
    of = lambda c, r: F.max(F.when(F.col("ratio") == r, F.col(c))).alias(f"{c}_{r}")
    return rows.groupBy(*by).agg(F.max("total").alias("docs"), *[of(c, r) for c in ("most", "tail") for r in RATIOS])


def thresholds(rated: DataFrame, language: str, source: str, *, spread: int = SPREAD, least_docs: int = LEAST_DOCS, tail_docs: int = TAIL_DOCS) -> DataFrame:
    """(language, source, most_*): each group's own limits or those it falls back to."""
    passed = rated.filter(~base_failed())
    fine = sketches(passed.select(F.col(language).alias("g_lang"), F.col(source).alias("g_source"), *RATIOS), ["g_lang", "g_source"])
    names = ["docs", *[f"{c}_{r}" for c in ("most", "tail") for r in RATIOS]]
    own = limits(fine, ["g_lang", "g_source"], spread)
    per_lang = limits(merge(fine, ["g_lang"]), ["g_lang"], spread)
    over_all = limits(merge(fine, []), [], spread)
    lang = per_lang.select(F.col("g_lang").alias("l_lang"), *[F.col(n).alias(f"l_{n}") for n in names])
    whole = F.broadcast(over_all.select(*[F.col(n).alias(f"w_{n}") for n in names]))  # one row
    joined = own.join(lang, F.col("g_lang").eqNullSafe(F.col("l_lang"))).join(whole)
    pick = lambda n, least: F.when(F.col("docs") >= least, F.col(n)).when(F.col("l_docs") >= least, F.col(f"l_{n}")).otherwise(F.col(f"w_{n}"))
    return joined.select("g_lang", "g_source", *[F.coalesce(pick(f"most_{r}", least_docs), pick(f"tail_{r}", tail_docs)).alias(f"most_{r}") for r in RATIOS])


def judge(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source", *, spread: int = SPREAD, least_docs: int = LEAST_DOCS, tail_docs: int = TAIL_DOCS, carry: list[str] | None = None) -> DataFrame:
    """docs (or the columns ``carry``) with measures, ratios, ``base_failed`` and ``kept``."""
    whole = text in (docs.columns if carry is None else carry)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (*MEASURES, *RATIOS, "base_failed", "kept")]
    slim = docs.select(*[F.col(c).alias(f"c_{c}") for c in carry], F.col(language).alias("d_lang"), F.col(source).alias("d_source"), F.col(text).alias("d_text"))
    rated = ratios(measure(slim, "d_text")).drop("d_text")
    if not whole:  # without the texts it is small: measure them once only
        rated = table(rated, "measures")
    most = thresholds(rated, "d_lang", "d_source", spread=spread, least_docs=least_docs, tail_docs=tail_docs)
    joined = rated.join(most, F.col("d_lang").eqNullSafe(F.col("g_lang")) & F.col("d_source").eqNullSafe(F.col("g_source")), "left")
    fits = F.lit(True)
    for r in RATIOS:
        fits = fits & (F.col(r) <= F.col(f"most_{r}"))
    return joined.select(*[F.col(f"c_{c}").alias(c) for c in carry], *MEASURES, *RATIOS, base_failed().alias("base_failed"), (~base_failed() & F.coalesce(fits, F.lit(False))).alias("kept"))
