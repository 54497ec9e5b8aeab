"""Text functions on columns: normalisation, cues, counts, placeholders, signatures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
WORD = r"[A-Za-z]+(?:[-'][A-Za-z]+)?"
PLACEHOLDER = r"<[ft]\d+-[0-9a-z]{3}/>|\[\[FORMULA_\d+\]\]|@@P\d+@@"
CHUNK = r"[A-Za-z][A-Za-z0-9'./%+\-]*+(?:\s++[A-Za-z][A-Za-z0-9'./%+\-]*+)*+"
SHORT_FRAGMENT = r"^[A-Za-z][A-Za-z0-9._/-]{0,7}$"
HEADING_START = r"^(?:\(?\d+(?:\.\d+)*\)?[.)]?\s+|[A-Z][A-Z\s\-]{3,}|[•\-*]\s+)"
CONTINUATION_STARTS = "and or but with without whereas while which that than then thus therefore however nevertheless moreover furthermore second".split()
CONTINUATION_ENDS = "the a an of to for with and or but that these those this two three four five several many more less".split()
SUSPICIOUS_ENDS = "is are was were be been being have has had can could may might should would must will shall".split()
TECH_TERM = r"\b(?:[A-Z][a-z]+(?:-[A-Z][A-Za-z0-9]+)+|[A-Z]{2,}(?:[-_/][A-Za-z0-9]+)+|[A-Za-z]+[0-9][A-Za-z0-9]*(?:[-_/][A-Za-z0-9]+)*|[A-Z]{2,}[a-z]*\b)\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_space(c: Column) -> Column:
    """Unicode white space collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def last_word(c: Column) -> Column:
    """Last English word, lower-cased, or ''."""
    return F.lower(F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.lit(-1)), F.lit("")))


def starts_like_continuation(c: Column, normal: bool = False) -> Column:
    """A small first letter, or a cue as the last word of the first 32 characters; ``normal`` texts have single spaces already."""
    s = c if normal else normalize_space(c)
    return (s != "") & (s.rlike("^[a-z]") | last_word(F.substring(s, 1, 32)).isin(CONTINUATION_STARTS))


def ends_like_continuation(c: Column, normal: bool = False) -> Column:
    s = c if normal else normalize_space(c)
    return (s != "") & (s.endswith("-") | (~s.rlike(r"[.!?:;]$") & last_word(s).isin(CONTINUATION_ENDS)))


def starts_like_heading(c: Column, normal: bool = False) -> Column:
    return (c if normal else normalize_space(c)).rlike(HEADING_START)


def ends_terminal(c: Column, normal: bool = False) -> Column:
    return (c if normal else normalize_space(c)).rlike(r"[.!?:;]$")


def dollar_balance(c: Column, normal: bool = False) -> Column:
    """Unescaped dollar signs."""
    return F.regexp_count(c if normal else normalize_space(c), F.lit(r"(?<!\\)\$"))


def strip_placeholders(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), PLACEHOLDER, " ")


def placeholder_sequence(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PLACEHOLDER), F.lit(0))


def english_words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD))


def chunk_word_lengths(c: Column) -> Column:
    """English words of each run of English words."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CHUNK), F.lit(0)), english_words), lambda n: n > 0)


def short_fragment(c: Column) -> Column:
    return F.trim(c).rlike(SHORT_FRAGMENT)


def preview(c: Column, limit: int = 220) -> Column:
    """White space collapsed; at most limit characters, the last an ellipsis if cut."""
    s = normalize_space(c)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…")))


def trim_context(c: Column, limit: int = 360) -> Column:
    """At most limit - 1 characters and three dots if cut."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("...")))


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def chunk_words(c: Column, size: int = 48) -> Column:
    """Text cut every ``size`` words."""
    words = F.split(normalize_space(c), " ")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - 1), F.lit(size)), lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))


def formula_density(c: Column, n: Column) -> Column:
    """Placeholders per character, four places, half to even."""
    return F.when((F.length(c) > 0) & (n > 0), F.bround(n / F.greatest(F.lit(1), F.length(c)), 4)).otherwise(0.0)


def restore_tokens(c: Column, tokens: Column) -> Column:
    """Every token (tag, text) of an array put back in order."""
    return F.aggregate(tokens, c, lambda acc, t: F.replace(acc, t["tag"], t["text"]))


def redact(c: Column, secrets: Column) -> Column:
    """Every non-blank secret replaced by a mark."""
    return F.aggregate(secrets, c, lambda acc, s: F.when(F.trim(s) == "", acc).otherwise(F.replace(acc, s, F.lit("[REDACTED]"))))


def url_file_name(c: Column) -> Column:
    """Last path part of a URL without query and fragment, or null."""
    path = F.split_part(F.split_part(F.trim(c), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return F.nullif(F.trim(F.element_at(F.split(path, "/"), -1)), F.lit(""))


def parse_page_ranges(c: Column) -> Column:
    """'1-3,5' as a sorted distinct array of pages."""
    part = lambda p: F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(F.split(F.replace(c, F.lit(" "), F.lit("")), ","), lambda p: p != ""), part))))


def signature(*columns: Column) -> Column:
    """Hash of an ordered list of texts."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in columns]).cast("binary"), 256)


def bounded_term_pattern(term: Column) -> Column:
    """Case-insensitive pattern of a term between non-word edges; spaces match any white space."""
    escaped = F.regexp_replace(normalize_space(term), r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])"), F.replace(escaped, F.lit(" "), F.lit(r"\s+")), F.lit("(?![A-Za-z0-9])"))
