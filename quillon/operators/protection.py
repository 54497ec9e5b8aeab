"""Formulas and glossary terms in a text replaced by tags, and the maps of what stands for what."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and letters that tags and formulas are known by.
PREFIX = {"formula": "f", "term": "t", "unit": "u", "numeric": "n", "variable": "v", "citation": "c"}
TAG = re.compile(r"<[futnvc]\d+-[0-9a-z]{3}/>|\[\[FORMULA_\d+]]|@@F\d+@@")
GLUED_PROSE = re.compile(r"([}\]])([A-Za-z][a-z]{2,})")
LATEX = re.compile(r"((?:\\[A-Za-z]+|[A-Za-z])(?:\s*(?:_\s*\{[^{}]*\}|\^\s*\{[^{}]*\}|_\s*[A-Za-z0-9]|\^\s*[A-Za-z0-9]|\{[^{}]*\}|\([^()]*\)|\[[^\[\]]*\]|[=+\-−*/<>.,A-Za-z0-9]++|\\[A-Za-z]+))++)")
GREEK = re.compile(r"((?:\\[A-Za-z]+|[α-ωΑ-Ωωγβμφαζη∂])(?:\s*(?:_\s*\{[^{}]*\}|\^\s*\{[^{}]*\}|[A-Za-z0-9]|\\[A-Za-z]+))*)")
GREEK_PAIR = re.compile(r"^(?:\\alpha|α)\s*(?:\{\s*,\s*\}|,)\s*(?:\\beta|β)(?:\s*-\s*[A-Za-z]+)?$")
WRAPPER = re.compile(r"\\(?:mathrm|mathit|mathbf|mathcal|text)\s*\{\s*([^{}]+?)\s*\}")
SIGNS = re.compile(r"[\\_^{}αβγμφζη∂]")
LONE_GREEK = re.compile(r"(?:\\[A-Za-z]+|[α-ωΑ-Ω∂])")
BOND = re.compile(r"[A-Za-z]{1,3}-[A-Za-z]{1,3}")
CITED = re.compile(r"(?:\d+\s*[A-Za-z]|[A-Za-z])(?:\s*,\s*(?:\d+\s*[A-Za-z]|[A-Za-z])){2,}")
CITED_PART = re.compile(r"(?:\d+\s*[A-Za-z](?:\s*-\s*[A-Za-z])?|[A-Za-z](?:\s*-\s*[A-Za-z])?)")

MAP = "array<struct<token_tag:string,token_type:string,original_text:string,restore_text:string,source_offset:int,checksum:string>>"
PROTECTED = f"text string, protected_map {MAP}"
FORMULAS = "array<struct<placeholder:string,token_tag:string,formula_text:string>>"


def _bare(value: str) -> str:
    """A candidate without style wrappers and braces."""
    before = None
    while value != before:
        before, value = value, WRAPPER.sub(r"\1", value)
    return " ".join(value.replace("{", "").replace("}", "").split())


def _no_formula(value: str) -> bool:
    """Prose, citations, single Greek letters and bonds such as C-H, which stay in the text."""
    bare = _bare(value)
    words = re.findall(r"[A-Za-z]{3,}", _bare(re.sub(r"\\[A-Za-z]+", " ", value)))
    if len(words) >= 4 and sum(w != w.upper() for w in words) >= 3:
        return True
    if not any(c in bare for c in "_^+=/"):
        if "*" not in bare and BOND.fullmatch(bare.replace(" ", "")):
            return True
        if not any(c in bare for c in "()[]"):
            parts = [p.strip() for p in bare.split(",") if p.strip()]
            cited = CITED.fullmatch(bare) or (len(parts) >= 4 and all(CITED_PART.fullmatch(p) for p in parts))
            return bool(cited or LONE_GREEK.fullmatch(bare))
    return False


def formula_spans(text: str) -> list[tuple[int, int, str, str, str]]:
    """Non-overlapping formulas, leftmost and longest first: (start, end, type, text, restored text)."""
    found = [(m.start(), m.end(), m[0].strip()) for p in (LATEX, GREEK) for m in p.finditer(text)]
    out, at = [], 0
    for start, end, value in sorted(found, key=lambda f: (f[0], -f[1])):
        if start >= at and end > at and SIGNS.search(value) and not GREEK_PAIR.match(value) and not _no_formula(value):
            out.append((start, end, "formula", value, value))
            at = end
    return out


def term_spans(text: str, entries: list[dict]) -> list[tuple[int, int, str, str, str]]:
    """Occurrences of glossary entries in the order given, none on another or on a tag.

    An entry with a context counts within 160 characters of it.
    """
    taken = [m.span() for m in TAG.finditer(text)]  # in order and apart, so that only neighbours can overlap
    out = []
    for e in entries:
        mode = e["match_mode"]
        pattern = e["source"] if mode == "regex" else rf"(?<![A-Za-z0-9_]){re.escape(e['source'])}(?![A-Za-z0-9_])"
        for m in re.finditer(pattern, text, re.I if mode == "case_insensitive" else 0):
            start, end = m.span()
            i = bisect_left(taken, (start, end))
            if start >= end or (i and taken[i - 1][1] > start) or (i < len(taken) and taken[i][0] < end):
                continue
            if not e["context"] or e["context"].casefold() in text[max(0, start - 160) : end + 160].casefold():
                taken.insert(i, (start, end))
                out.append((start, end, "term", m[0], m[0] if e["level"] == "preserve" else e["target"]))
    return out


def checksum_of(kind: str, text: str) -> str:
    import hashlib

    return hashlib.blake2s(f"{kind}\0{text}".encode("utf-8", "surrogatepass"), digest_size=2).hexdigest()[:3]


def protected(text: str | None, entries: list[dict]) -> tuple[str, list[dict]]:
    """A text with tags for its formulas and terms, and what they stand for; the first of overlapping spans wins."""
    text = GLUED_PROSE.sub(r"\1 \2", text or "")
    out, made, at, numbers = [], [], 0, {}
    for start, end, kind, original, restored in sorted([*formula_spans(text), *term_spans(text, entries)], key=lambda s: (s[0], -s[1])):
        if start < at:
            continue
        numbers[kind] = numbers.get(kind, 0) + 1
        sum_ = checksum_of(kind, original)
        tag = f"<{PREFIX[kind]}{numbers[kind]}-{sum_}/>"
        out += [text[at:start], tag]
        made.append({"token_tag": tag, "token_type": kind, "original_text": original, "restore_text": restored, "source_offset": start, "checksum": sum_})
        at = end
    return "".join([*out, text[at:]]), made


def protect(entries: list[dict] | None = None):
    """A function of a text column to struct<text, protected_map>; ``entries`` is a glossary's hard entries in order.

    Entries have source, target, level, match_mode and context. Offsets count
    code points in the text as it is tagged (a space is put between a closing
    bracket and a word). A null text is an empty one.
    """
    listed = [e for e in entries or [] if e["source"]]

    @F.pandas_udf(PROTECTED)
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([protected(t, listed) for t in text], columns=["text", "protected_map"])

    return run


def formula_map(protected_map: Column) -> Column:
    """The formulas of a protected map that have a tag and a text."""
    body = lambda e: F.coalesce(F.nullif(e["restore_text"], F.lit("")), F.nullif(e["original_text"], F.lit("")))
    kept = F.filter(F.coalesce(protected_map, F.array().cast(MAP)), lambda e: (e["token_type"] == "formula") & (F.coalesce(e["token_tag"], F.lit("")) != "") & body(e).isNotNull())
    return F.transform(kept, lambda e: F.struct(e["token_tag"].alias("placeholder"), e["token_tag"].alias("token_tag"), body(e).alias("formula_text")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def formula_checksums(texts: pd.Series) -> pd.Series:
    return pd.Series([[checksum_of("formula", t) for t in row] if row is not None else [] for row in texts])


def protected_map(formulas: Column) -> Column:
    """A protected map from formulas (placeholder, formula_text); offsets aren't known (-1)."""
    given = F.coalesce(formulas, F.array().cast(FORMULAS))
    body = F.transform(given, lambda e: F.coalesce(e["formula_text"], F.lit("")))
    sums = formula_checksums(body)
    text = lambda e: F.coalesce(e["formula_text"], F.lit(""))
    entry = lambda e, s: F.struct(F.coalesce(e["placeholder"], F.lit("")).alias("token_tag"), F.lit("formula").alias("token_type"), text(e).alias("original_text"), text(e).alias("restore_text"), F.lit(-1).alias("source_offset"), s.alias("checksum"))
    return F.zip_with(given, sums, entry)


__all__ = ["FORMULAS", "MAP", "formula_map", "formula_spans", "protect", "protected", "protected_map", "term_spans"]
