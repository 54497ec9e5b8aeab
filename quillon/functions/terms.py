"""Term candidates of a source text and its translation, and which of them are useful."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions.text import let

# How terms are written, words that tell against them and what a term's sides score.
_LEFT = r"([\x{4e00}-\x{9fff}][\x{4e00}-\x{9fff}A-Za-z0-9·\-]{1,24})"
_RIGHT = r"([A-Za-z][A-Za-z0-9 ._+/\-]{1,48})"
PAIRS = (_LEFT + "（(?:或称|又称|简称)?" + _RIGHT + "）", _LEFT + r"\((?:or |also known as )?" + _RIGHT + r"\)", _LEFT + "（" + _RIGHT + "）")
TECHNICAL = r"(?U:\b)[A-Z][A-Za-z0-9]*(?:[-_/][A-Za-z0-9]+)*(?:(?U:\s+)[A-Z][A-Za-z0-9]*(?:[-_/][A-Za-z0-9]+)*){0,3}(?U:\b)"
STOP_KEYS = ("or", "and", "the", "from", "with", "for", "this", "that")
EDGES = r"[ ,.;:()\[\]{}，。；：（）【】]"
BLOCKED = "的已将被从在这其"
PAIR_SCORE, IDENTITY_SCORE = 1.0, 0.55
TOKENS, TERM_CHARS, VALUE_CHARS, VALUE_CJK, KEY_WORDS = 24, 80, 12, 8, 4
CJK = r"[\x{4e00}-\x{9fff}]"


def clean_term(c: Column) -> Column:
    """White space collapsed, brackets and punctuation at the edges gone, at most 80 characters."""
    return F.substring(F.regexp_replace(X.normalize_space(c), f"^{EDGES}+|{EDGES}+$", ""), 1, TERM_CHARS)


def useful_key(key: Column) -> Column:
    return (F.length(key) >= 2) & ~F.lower(key).isin(*STOP_KEYS) & key.rlike(r"\p{L}")


def useful_value(value: Column) -> Column:
    return value.rlike(CJK)


def noun_phrase(value: Column) -> Column:
    """A short phrase without punctuation and without words that only sentences have."""
    s = clean_term(value)
    return (s != "") & ~s.rlike("[，。；：、,.!?！？]") & (F.length(s) <= VALUE_CHARS) & (F.regexp_count(s, F.lit(CJK)) <= VALUE_CJK) & ~s.rlike(f"[{BLOCKED}]")


def allowed(key: Column, value: Column) -> Column:
    """Whether a term may be shown again: a useful key of at most four words, and itself or a noun phrase as value."""
    k, v = clean_term(key), clean_term(value)
    keyed = useful_key(k) & (F.size(F.split(k, " ")) <= KEY_WORDS) & (v != "")
    return keyed & ((F.lower(k) == F.lower(v)) | (useful_value(v) & noun_phrase(v)))


def candidates(source: Column, translated: Column) -> Column:
    """[(key, value, origin, score)]: pairs that the translation explains, then technical tokens that it kept."""
    entry = lambda k, v, origin, score: F.struct(k.alias("key"), v.alias("value"), F.lit(origin).alias("origin"), F.lit(score).alias("score"))

    def pairs(said: Column, pattern: str) -> Column:
        sides = F.arrays_zip(F.regexp_extract_all(said, F.lit(pattern), F.lit(2)).alias("k"), F.regexp_extract_all(said, F.lit(pattern), F.lit(1)).alias("v"))
        return F.transform(sides, lambda s: entry(clean_term(s["k"]), clean_term(s["v"]), "explicit_pair", PAIR_SCORE))

    explained = lambda said: F.filter(F.concat(*(pairs(said, p) for p in PAIRS)), lambda c: useful_key(c["key"]) & useful_value(c["value"]))
    tokens = F.transform(F.slice(F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(TECHNICAL), F.lit(0)), 1, TOKENS), lambda t: entry(clean_term(t), clean_term(t), "identity_technical_token", IDENTITY_SCORE))
    kept = lambda said: let(F.lower(said), lambda low: F.filter(tokens, lambda c: useful_key(c["key"]) & (F.instr(low, F.lower(c["key"])) > 0)))
    return let(X.normalize_space(translated), lambda said: F.concat(explained(said), kept(said)))
