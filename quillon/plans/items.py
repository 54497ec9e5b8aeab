"""Page items and document blocks derived from plain documents by fixed rules, in Spark and in SQL.

A document's lines are its blocks, eight to a page. Roles, tags, results and
boxes follow from the ids by formula, so every operator of the engine has an
input in which all its cases occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUB_TYPES = ["title", "body", "", "heading", "body", "footnote", "header", "figure_caption", "metadata"]
DERIVED = ["", "abstract", "", "reference_entry", "caption", "affiliation", ""]
TAGS = ["", " Caption", "reference_zone", "abstract", ""]
STATUSES = ["translated", "kept_origin", "translated", "failed", "partially_translated"]
ROUTES = [["batched"], ["single", "retry"], ["single", "single"], ["segment", "dlq"]]


def cycle(values: list[str], at: Column) -> Column:
    """The value at position at, modulo the list's length."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(at, F.lit(len(values))).cast("int"))


def dealt(rows: DataFrame) -> DataFrame:
    """Items dealt over all tasks by their keys; a file's row group is read by one task, however many rows it holds."""
    return rows.repartition("doc_id", "block_idx")


def items(documents: DataFrame) -> DataFrame:
    """One row per non-blank line: doc_id, lang, source, page_idx, block_idx, item_id, text."""
    lines = documents.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    lines = lines.filter(F.trim("text") != "").withColumn("block_idx", F.col("pos").cast("long")).drop("pos")
    page = F.expr("block_idx div 8")
    return lines.select("doc_id", "lang", "source", page.alias("page_idx"), "block_idx", F.format_string("p%03d-b%03d", page, F.col("block_idx")).alias("item_id"), "text")


def blocks(documents: DataFrame) -> DataFrame:
    """Items with types, roles, tags, results and boxes."""
    d, b = F.col("doc_id"), F.col("block_idx")
    n = F.length("text")
    x0 = (50 + (b % 2) * 260).cast("double")
    y0 = (40 + (b % 8) * 70).cast("double")
    routes = F.array(*[F.array(*map(F.lit, r)) for r in ROUTES])
    errors = F.when((d + b) % 6 == 0, F.array(F.lit("transport_error"))).when((d + b) % 6 == 3, F.array(F.lit("validation_error"), F.lit("rate_limit_error"))).otherwise(F.array().cast("array<string>"))
    return items(documents).select(
        "*",
        F.when(F.col("text").contains("|"), "table").otherwise("text").alias("block_type"),
        cycle(SUB_TYPES, b).alias("sub_type"),
        cycle(DERIVED, d + b).alias("derived_role"),
        cycle(TAGS, d + 2 * b).alias("tag"),
        cycle(STATUSES, 3 * d + b).alias("final_status"),
        F.get(routes, F.pmod(d + b, F.lit(4)).cast("int")).alias("route_path"),
        errors.alias("error_types"),
        ((d * 7919 + b * 104729) % 60000).alias("latency_ms"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 200 + n % 40).alias("x1"), (y0 + 20 + n % 60).alias("y1"),
    )


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


ITEMS = """items AS (SELECT doc_id, lang, source, (i - 1) // 8 AS page_idx, i - 1 AS block_idx, printf('p%03d-b%03d', (i - 1) // 8, i - 1) AS item_id, lines[i] AS text
FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) AS u(i) WHERE trim(lines[i]) <> '')"""

BLOCKS = f"""{ITEMS},
blocks AS (SELECT *, CASE WHEN contains(text, '|') THEN 'table' ELSE 'text' END AS block_type, ({_list(SUB_TYPES)})[block_idx % 9 + 1] AS sub_type, ({_list(DERIVED)})[(doc_id + block_idx) % 7 + 1] AS derived_role,
 ({_list(TAGS)})[(doc_id + 2 * block_idx) % 5 + 1] AS tag, ({_list(STATUSES)})[(3 * doc_id + block_idx) % 5 + 1] AS final_status,
 ([{", ".join(_list(r) for r in ROUTES)}])[(doc_id + block_idx) % 4 + 1] AS route_path,
 CASE (doc_id + block_idx) % 6 WHEN 0 THEN ['transport_error'] WHEN 3 THEN ['validation_error', 'rate_limit_error'] ELSE CAST([] AS VARCHAR[]) END AS error_types,
 (doc_id * 7919 + block_idx * 104729) % 60000 AS latency_ms, CAST(50 + (block_idx % 2) * 260 AS DOUBLE) AS x0, CAST(40 + (block_idx % 8) * 70 AS DOUBLE) AS y0,
 CAST(250 + (block_idx % 2) * 260 + length(text) % 40 AS DOUBLE) AS x1, CAST(60 + (block_idx % 8) * 70 + length(text) % 60 AS DOUBLE) AS y1 FROM items)"""
