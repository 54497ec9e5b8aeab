"""The quality query in DuckDB's SQL."""

from quillon.llm.quality import LEADING_BITS, LEAST_DOCS, RATIOS, SPREAD, TAIL, TAIL_DOCS


def sql(spread: int = SPREAD, least_docs: int = LEAST_DOCS, tail_docs: int = TAIL_DOCS, columns: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept", source: str = "documents") -> str:
    ratio = {"r_symbols": ("n_symbols", "word_chars"), "r_dup_lines": ("n_dup_lines", "n_lines"), "r_repeat": ("n_repeat_words", "n_words"), "r_again": ("n_again", "n_words"), "r_upper": ("n_upper", "word_chars"), "r_length": ("word_chars", "n_words")}
    rated = ", ".join(f"CASE WHEN {b} > 0 THEN {a} * 1000000 // {b} ELSE 0 END AS {r}" for r, (a, b) in ratio.items())

    def level(name: str, keys: str, lead: str) -> str:
        comma = f"{keys}, " if keys else ""
        by = f"PARTITION BY {comma}ratio"
        wide = ", ".join(f"max({c}) FILTER (ratio = '{r}') AS {c}_{r}" for c in ("most", "tail") for r in RATIOS)
        return f"""
{name}_h AS (SELECT {comma}ratio, bucket, sum(n) AS n FROM fine GROUP BY {comma}ratio, bucket),
{name}_c AS (SELECT *, sum(n) OVER ({by}) AS total, sum(n) OVER ({by} ORDER BY bucket) AS upto FROM {name}_h),
{name}_q AS (SELECT {comma}ratio, max(total) AS docs, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3, min(bucket) FILTER (upto * {TAIL[1]} >= total * {TAIL[0]}) AS q FROM {name}_c GROUP BY {comma}ratio),
{name} AS (SELECT {comma}max(docs) AS docs, {wide} FROM (SELECT {comma}ratio, docs, CASE WHEN q3 > q1 THEN q3 + {spread} * (q3 - q1) END AS most, q + (1::BIGINT << greatest(0, length(bin(q)) - {LEADING_BITS})) - 1 AS tail FROM {name}_q) {f"GROUP BY {keys}" if keys else ""})"""

    pick = lambda n, least: f"CASE WHEN o.docs >= {least} THEN o.{n} WHEN l.docs >= {least} THEN l.{n} ELSE a.{n} END"
    fits = " AND ".join(f"{r} <= coalesce({pick(f'most_{r}', least_docs)}, {pick(f'tail_{r}', tail_docs)})" for r in RATIOS)
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH texts AS (SELECT *, row_number() OVER () AS rn, coalesce(text, '') AS tx, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM {source}),
grams AS (SELECT rn, i, array_to_string(ws[i:i + 4], ' ') AS g FROM texts, unnest(range(1, greatest(1, len(ws) - 3))) AS u(i)),
again AS (SELECT rn, i FROM grams QUALIFY count(*) OVER (PARTITION BY rn, g) > 1),
covered AS (SELECT rn, count(DISTINCT i + k) AS n FROM again, unnest(range(5)) AS u(k) GROUP BY rn),
measured AS (SELECT t.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(tx, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(tx, '[^A-Z]', '', 'g')) AS n_upper,
  len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_again,
  list_filter(string_split(tx, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls, coalesce(c.n, 0) AS n_repeat_words FROM texts t LEFT JOIN covered c USING (rn)),
lined AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM measured),
rated AS (SELECT *, {rated}, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM lined),
long AS (SELECT lang, source, ratio, v FROM (SELECT lang, source, {", ".join(RATIOS)} FROM rated WHERE NOT base_failed) UNPIVOT (v FOR ratio IN ({", ".join(RATIOS)}))),
fine AS (SELECT lang, source, ratio, (v >> greatest(0, length(bin(v)) - 5)) << greatest(0, length(bin(v)) - 5) AS bucket, count(*) AS n FROM long GROUP BY ALL),
{level("own", "lang, source", "")},
{level("per_lang", "lang", "")},
{level("over_all", "", "")},
judged AS (SELECT r.*, NOT base_failed AND coalesce({fits}, false) AS kept FROM rated r LEFT JOIN own o ON r.lang IS NOT DISTINCT FROM o.lang AND r.source IS NOT DISTINCT FROM o.source
  LEFT JOIN per_lang l ON r.lang IS NOT DISTINCT FROM l.lang LEFT JOIN over_all a ON true)
SELECT {columns} FROM judged"""


