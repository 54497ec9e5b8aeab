"""Translations that are still English: wholly, as copies of their source, or in long runs inside other text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import rules as Q
from quillon.functions import text as X
from quillon.functions.text import let

# What a run of English is and how much of it counts.
RUN = r"[A-Za-z][A-Za-z0-9\s,;:()'./%+-]{30,}"
FORMULA_TOKEN = r"<f\d+-[0-9a-z]{3}/>|\[\[FORMULA_\d+\]\]|@@P\d+@@"
RUN_WORDS, COPIED_RUN_WORDS, OUTPUT_WORDS = 10, 12, 12
MIXED_CJK, MIXED_CHUNK, MIXED_WORDS = 6, 6, 24
COPIED, LEAST_COPIED = 0.82, 32


@dataclass(frozen=True)
class Unit:
    """The columns of a translated item; ``measures`` are those of ``measured``, else they are taken where they are needed."""

    source: Column
    translated: Column
    kind: Column
    bodylike: Column
    reference: Column
    grouped: Column
    formulas: Column
    direct_math: Column
    measures: Column | None = None

    @property
    def forced(self) -> Column:
        return Q.forced_body(self.source, self.kind, self.bodylike, self.grouped, self.formulas | self.direct_math)

    @property
    def dense(self) -> Column:
        """Whether body text has so many formulas that English words say little."""
        n = F.regexp_count(self.source, F.lit(FORMULA_TOKEN))
        return (self.grouped | self.formulas) & ((n >= 3) | (self.grouped & (n >= 1)))


def long_runs(plain: Column) -> Column:
    """Runs of English of ten words or more that read like prose, in a text without placeholders."""
    runs = F.transform(F.regexp_extract_all(plain, F.lit(RUN), F.lit(0)), X.normalize_space)
    return F.filter(runs, lambda r: (X.english_words(r) >= RUN_WORDS) & Q.english_prose(r))


def measures(u: Unit) -> Column:
    """struct<zh, en, longest, runs> of a translation that isn't blank, of body text outside references; null for others."""
    taken = lambda s: F.struct(F.regexp_count(s, F.lit("[一-鿿]")).alias("zh"), X.english_words(s).alias("en"), F.array_max(X.chunk_word_lengths(s)).alias("longest"), long_runs(s).alias("runs"))
    may = (F.trim(F.coalesce(u.translated, F.lit(""))) != "") & ~u.reference & u.forced
    return F.when(may, let(X.strip_placeholders(u.translated), taken))


def measured(df: DataFrame, u: Unit, name: str = "measures") -> tuple[DataFrame, Unit]:
    """df with the measures of its units as a column, and the units that use it; so they are taken once for all verdicts."""
    return df.withColumn(name, measures(u)), replace(u, measures=F.col(name))


def _with_measures(u: Unit, body: Callable[[Column], Column]) -> Column:
    return body(u.measures) if u.measures is not None else let(measures(u), body)


def keeps_terms(u: Unit, m: Column) -> Column:
    """Enough Chinese with short English terms in it, where formulas or groups explain those."""
    short = (F.size(m["runs"]) == 0) & (m["longest"] <= MIXED_CHUNK)
    few = m["en"] <= F.greatest(F.lit(MIXED_WORDS), m["zh"] * 2)
    return F.coalesce((m["zh"] >= MIXED_CJK) & short & few & (u.direct_math | u.grouped | u.formulas), F.lit(False))


def _english(u: Unit, m: Column) -> Column:
    verdict = F.when(F.size(m["runs"]) > 0, True).when(m["en"] < OUTPUT_WORDS, False).when(m["zh"] == 0, True).when(u.dense, False).otherwise(m["en"] >= F.greatest(F.lit(OUTPUT_WORDS), F.floor(m["zh"] / 2)))
    may = m.isNotNull() & ~(u.direct_math & (m["zh"] > 0)) & ~keeps_terms(u, m) & verdict
    return F.coalesce(may & ~F.coalesce(Q.author_list(u.source), F.lit(False)), F.lit(False))


def mostly_english(u: Unit) -> Column:
    """A translation of English prose that is English itself, apart from what may stay so."""
    return _with_measures(u, lambda m: _english(u, m))


def surface(text: Column) -> Column:
    """Small letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(X.normalize_space(X.strip_placeholders(text))), "[^a-z0-9]+", " "))


@F.pandas_udf(T.BooleanType())
def any_copied(texts: pd.Series) -> pd.Series:
    """Whether a text behind the first is the first or, from 32 characters, nearly so; null lists aren't looked at."""
    from difflib import SequenceMatcher

    def copied(a: str, b: str) -> bool:
        if not a or not b:
            return False
        if a == b:
            return True
        if min(len(a), len(b)) < LEAST_COPIED or 2 * min(len(a), len(b)) / (len(a) + len(b)) < COPIED:  # the lengths' bound on the ratio
            return False
        return SequenceMatcher(None, a, b).ratio() >= COPIED

    return pd.Series([t is not None and any(copied(t[0] or "", x) for x in t[1:]) for t in texts], dtype=bool)


def untranslated(u: Unit) -> Column:
    """Mostly English, without any Chinese, and a copy of the source."""
    return any_copied(_with_measures(u, lambda m: F.when((m["zh"] == 0) & _english(u, m), F.array(surface(u.source), surface(u.translated)))))


def mixed_residue(u: Unit) -> Column:
    """Chinese with a run of twelve English words or more that copies the source."""

    def texts(m: Column) -> Column:
        may = m.isNotNull() & (m["zh"] > 0) & ~u.dense & ~keeps_terms(u, m)
        runs = F.filter(m["runs"], lambda r: X.english_words(r) >= COPIED_RUN_WORDS)
        return F.when(may & (F.size(runs) > 0), F.concat(F.array(surface(u.source)), F.transform(runs, surface)))

    return any_copied(_with_measures(u, texts))
