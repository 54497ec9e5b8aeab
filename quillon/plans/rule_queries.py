"""Queries of projections (P), predicates (F), plug-in rule lists (X) and evaluation checks (E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import roles as R
from quillon.functions import rules as Q
from quillon.functions import text as X
from quillon.plans.items import BLOCKS, ITEMS, blocks, items
from quillon.plans.registry import query
from quillon.plans.text_queries import listed, norm, words


def _map_case(table: dict[str, str], key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN '{v}'" for k, v in table.items()) + " END"


_TAG = "lower(trim(tag))"
_LAYOUT = f"CASE WHEN block_type = 'text' THEN coalesce({_map_case(R.LAYOUT_OF_SUB_TYPE, 'sub_type')}, CASE WHEN derived_role = 'caption' OR {_TAG} IN {listed(R.CAPTION_TAGS)} OR sub_type IN {listed(R.CAPTION_SUB_TYPES)} THEN 'caption' END, 'paragraph') ELSE 'unknown' END"
_SEMANTIC = f"""CASE WHEN derived_role = 'abstract' OR {_TAG} = 'abstract' THEN 'abstract' WHEN derived_role = 'reference_entry' OR {_TAG} IN {listed(R.REFERENCE_TAGS)} OR sub_type = 'reference_entry' THEN 'reference'
 WHEN sub_type = 'metadata' OR derived_role = 'metadata' THEN 'metadata' WHEN derived_role = 'affiliation' THEN 'affiliation' WHEN layout_role IN {listed(R.ANCILLARY)} THEN 'metadata' WHEN block_type = 'text' AND layout_role IN ('paragraph', 'list_item') THEN 'body' ELSE 'unknown' END"""
_STRUCTURE = f"""CASE WHEN block_idx % 17 = 5 THEN 'sidebar' WHEN sub_type IN {listed(R.CAPTION_SUB_TYPES[1:])} THEN sub_type WHEN sub_type = 'reference_entry' OR semantic_role = 'reference' THEN 'reference_entry' WHEN semantic_role = 'abstract' THEN 'body' WHEN layout_role = 'caption' THEN 'caption' WHEN semantic_role = 'metadata' THEN 'metadata'
 ELSE coalesce({_map_case(R.STRUCTURE_OF_LAYOUT, 'layout_role')}, '') END"""
_REASON = f"""CASE WHEN block_type <> 'text' THEN 'non_text' WHEN layout_role = 'caption' THEN 'caption_text' WHEN layout_role IN {listed(R.ANCILLARY)} THEN 'layout_role=' || layout_role WHEN semantic_role IN ('reference', 'metadata', 'affiliation', 'acknowledgement', 'unknown') THEN 'semantic_role=' || semantic_role
 WHEN layout_role IN {listed(R.BODYLIKE_LAYOUT)} AND semantic_role = 'abstract' THEN 'semantic_role=abstract' WHEN layout_role IN {listed(R.BODYLIKE_LAYOUT)} AND semantic_role = 'body' THEN 'main_text' ELSE 'conservative_skip' END"""
ROLES_SQL = f"{BLOCKS}, lay AS (SELECT *, {_LAYOUT} AS layout_role FROM blocks), sem AS (SELECT *, {_SEMANTIC} AS semantic_role FROM lay), roles AS (SELECT *, {_STRUCTURE} AS structure_role, {_REASON} AS reason FROM sem)"


def roled(documents: DataFrame) -> DataFrame:
    """Blocks with layout, semantic and structure role and the reason to translate or not.

    Some names are untidy, as in files, and some blocks have a structure role in their metadata.
    """
    c, none, tags = F.col, F.lit(""), F.array("tag")
    i = c("block_idx")
    sub = F.when(i % 19 == 3, F.concat(F.lit(" "), F.upper("sub_type"))).otherwise(c("sub_type"))
    kind = F.when(i % 23 == 2, F.initcap("block_type")).otherwise(c("block_type"))
    stored = F.when(i % 17 == 5, " Sidebar ").when(i % 17 == 6, "unknown")
    b = blocks(documents).withColumn("layout_role", R.layout_role(none, kind, sub, c("derived_role"), tags))
    b = b.withColumn("semantic_role", R.semantic_role(none, kind, sub, c("derived_role"), tags, c("layout_role")))
    return b.withColumns({"structure_role": R.structure_role(none, sub, c("layout_role"), c("semantic_role"), stored), "reason": R.translate_reason(kind, c("layout_role"), c("semantic_role"))})


@query("p01_default_hits", f"WITH {BLOCKS} SELECT count(*) FILTER (sub_type = '') AS sub_type_hits, count(*) FILTER (derived_role = '') AS derived_hits, count(*) FILTER (trim(tag) = '') AS tag_hits, count(*) AS blocks FROM blocks")
def default_hits(t):
    """How often each default fires."""
    return blocks(t.documents).agg(F.count_if(F.col("sub_type") == "").alias("sub_type_hits"), F.count_if(F.col("derived_role") == "").alias("derived_hits"), F.count_if(F.trim("tag") == "").alias("tag_hits"), F.count(F.lit(1)).alias("blocks"))


@query("p02_continuation_hint", f"WITH {ITEMS} SELECT doc_id, item_id, trim(' ' || source || ' ') AS group_id, greatest(-1, block_idx - 5) AS reading_order, least(1.0, greatest(0.0, CAST(length(text) - 50 AS DOUBLE) / 100)) AS confidence FROM items")
def continuation_hint(t):
    return items(t.documents).select("doc_id", "item_id", F.trim(F.concat(F.lit(" "), "source", F.lit(" "))).alias("group_id"), F.greatest(F.lit(-1), F.col("block_idx") - 5).alias("reading_order"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.length("text") - 50).cast("double") / 100)).alias("confidence"))


@query("p04_roles", f"WITH {ROLES_SQL} SELECT doc_id, item_id, layout_role, semantic_role, structure_role, reason, reason IN ('caption_text', 'semantic_role=abstract', 'main_text') AS translate FROM roles")
def roles(t):
    """Roles and the decision to translate."""
    return roled(t.documents).select("doc_id", "item_id", "layout_role", "semantic_role", "structure_role", "reason", R.translates(F.col("reason")).alias("translate"))


@query("p08_assets_first_wins", f"WITH {BLOCKS}, r AS (SELECT source || '/' || sub_type AS asset_id, item_id AS uri, row_number() OVER (PARTITION BY source || '/' || sub_type ORDER BY doc_id, block_idx) AS rn FROM blocks WHERE sub_type <> '') SELECT asset_id, uri FROM r WHERE rn = 1")
def assets(t):
    """The first use of each asset id wins."""
    b = blocks(t.documents).filter("sub_type != ''").select(F.concat_ws("/", "source", "sub_type").alias("asset_id"), F.struct("doc_id", "block_idx").alias("at"), "item_id")
    return b.groupBy("asset_id").agg(F.min_by("item_id", "at").alias("uri"))


@query("p09_role_profile", f"WITH {ROLES_SQL} SELECT doc_id, item_id, concat_ws('|', block_type, sub_type, derived_role, layout_role, semantic_role, structure_role) AS profile FROM roles")
def role_profile(t):
    return roled(t.documents).select("doc_id", "item_id", F.concat_ws("|", "block_type", "sub_type", "derived_role", "layout_role", "semantic_role", "structure_role").alias("profile"))


@query("p12_item_order", f"WITH {ITEMS} SELECT doc_id, item_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, block_idx) AS item_order, page_idx + 1 AS page_number FROM items")
def item_order(t):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("page_idx", "block_idx")
    return items(t.documents).select("doc_id", "item_id", F.row_number().over(w).cast("long").alias("item_order"), (F.col("page_idx") + 1).alias("page_number"))


@query("p13_debug_index", f"WITH {BLOCKS} SELECT doc_id, item_id, page_idx + 1 AS page_number, array_to_string(route_path, '/') AS route, array_to_string(error_types, ',') AS errors, final_status FROM blocks")
def debug_index(t):
    return blocks(t.documents).select("doc_id", "item_id", (F.col("page_idx") + 1).alias("page_number"), F.array_join(F.filter("route_path", lambda r: F.trim(r) != ""), "/").alias("route"), F.array_join("error_types", ",").alias("errors"), "final_status")


@query("p18_job_rows", "SELECT o_orderkey AS job_id, coalesce(nullif(o_orderpriority, ''), 'queued') AS stage, CASE WHEN o_custkey % 50 > 0 THEN 100.0 * (o_orderkey % (o_custkey % 50)) / (o_custkey % 50) END AS percent FROM orders")
def job_rows(t):
    cur, total = F.col("o_orderkey"), F.col("o_custkey") % 50
    return t.orders.select(cur.alias("job_id"), X.first_non_blank(F.col("o_orderpriority"), F.lit("queued")).alias("stage"), F.when(total > 0, 100.0 * F.try_mod(cur, total) / total).alias("percent"))


@query("p25_rescale_boxes", f"WITH {BLOCKS} SELECT doc_id, item_id, CASE WHEN abs(s - 1) <= 0.01 THEN x0 ELSE round_even(x0 * s, 3) END AS x0, CASE WHEN abs(s - 1) <= 0.01 THEN x1 ELSE round_even(x1 * s, 3) END AS x1 FROM (SELECT *, 1.0 + CAST(page_idx % 4 AS DOUBLE) / 8 AS s FROM blocks)")
def rescale(t):
    s = 1.0 + (F.col("page_idx") % 4).cast("double") / 8
    scaled = lambda c: F.when(F.abs(s - 1) <= 0.01, F.col(c)).otherwise(F.bround(F.col(c) * s, 3)).alias(c)
    return blocks(t.documents).select("doc_id", "item_id", scaled("x0"), scaled("x1"))


@query("p26_effective_role", f"WITH {ROLES_SQL} SELECT doc_id, item_id, lower(coalesce(nullif(nullif(layout_role, 'unknown'), ''), nullif(semantic_role, ''), structure_role)) AS role FROM roles")
def effective_role(t):
    return roled(t.documents).select("doc_id", "item_id", F.lower(F.coalesce(R.explicit(F.col("layout_role")), F.nullif(F.col("semantic_role"), F.lit("")), F.col("structure_role"))).alias("role"))


@query("p28_sync_records", f"WITH {ITEMS}, stored AS (SELECT doc_id, item_id, 'old ' || item_id AS note, left(text, 5) AS text FROM items WHERE block_idx % 3 <> 0) SELECT doc_id, item_id, i.text, coalesce(s.note, 'new') AS note, s.item_id IS NULL AS appended FROM items i LEFT JOIN stored s USING (doc_id, item_id)")
def sync_records(t):
    """Fresh text overwrites, stored notes stay, rows of new ids are appended."""
    fresh = items(t.documents)
    stored = fresh.filter("block_idx % 3 != 0").select("doc_id", "item_id", F.concat(F.lit("old "), "item_id").alias("note"))
    both = fresh.join(stored, ["doc_id", "item_id"], "left")
    return both.select("doc_id", "item_id", "text", F.coalesce("note", F.lit("new")).alias("note"), F.col("note").isNull().alias("appended"))


@query("f01_item_filters", f"WITH {BLOCKS} SELECT doc_id, item_id FROM blocks WHERE page_idx = 0 AND lower(final_status) = 'failed' AND list_contains(list_transform(error_types, lambda x: lower(x)), 'transport_error') AND contains(array_to_string(route_path, '/'), 'single') AND contains(text, 'a')")
def item_filters(t):
    return filter_items(blocks(t.documents), page=0, status="FAILED", error="Transport_Error", route="single", q="a").select("doc_id", "item_id")


def filter_items(df: DataFrame, page: int | None = None, status: str = "", error: str = "", route: str = "", q: str = "") -> DataFrame:
    """All the given conditions at once; those left out don't filter."""
    if page is not None:
        df = df.filter(F.col("page_idx") == page)
    if status:
        df = df.filter(F.lower("final_status") == status.lower())
    if error:
        df = df.filter(F.exists("error_types", lambda e: F.lower(e) == error.lower()))
    if route:
        df = df.filter(F.array_join("route_path", "/").contains(route))
    return df.filter(F.col("text").contains(q)) if q else df


@query("f02_filter_after_page", "SELECT * FROM (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200 OFFSET 100) WHERE o_orderstatus = 'F'")
def filter_after_page(t):
    """The status filter comes after paging, so a page may be short."""
    page = t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderstatus").offset(100).limit(200)
    return page.filter("o_orderstatus = 'F'")


@query("f05_review_candidates", f"WITH {BLOCKS} SELECT doc_id, item_id FROM blocks WHERE block_type = 'text' AND length({norm('text')}) <= 160 AND {norm('text')} <> '' AND tag = ''")
def review_candidates(t):
    s = X.normalize_space(F.col("text"))
    return blocks(t.documents).filter(Q.all_match([F.col("block_type") == "text", F.length(s) <= 160, s != "", F.col("tag") == ""])).select("doc_id", "item_id")


_URL = Q.URL_LIKE.replace("'", "''")
_BARE = "regexp_replace(s, '^[()\\[\\]<>\"''“”‘’,;]+|[()\\[\\]<>\"''“”‘’,;]+$', '', 'g')"
_HARD = (
    f"(s <> '' AND (regexp_matches({_BARE}, '{_URL}') OR regexp_matches({_BARE}, '^[\\w.+-]+@[\\w.-]+\\.[A-Za-z]{{2,}}$') OR (length(s) <= 220 AND len({words('s')}) <= 32 AND regexp_matches(s, '{Q.RIGHTS}') "
    f"AND len(list_filter({list(Q.RIGHTS_SIGNALS)}, lambda m: contains(lower(s), m))) > 0 AND len(list_filter({list(Q.RIGHTS_DISCLAIMERS)}, lambda m: contains(lower(s), m))) = 0)))"
)
#: items of every kind that the rules tell apart
_MADE = """CASE (doc_id + block_idx) % 13 WHEN 0 THEN 'https://a.example/' || block_idx WHEN 1 THEN '(me.' || block_idx || '@b.example)' WHEN 2 THEN 'Copyright ' || block_idx || ' ' || split_part(text, ' ', 1) || '. All rights reserved.'
 WHEN 3 THEN 'F ' || block_idx % 90 WHEN 4 THEN '  ' WHEN 5 THEN '<f1-abc/> ' WHEN 6 THEN 'Copyright: written permission of ' || split_part(text, ' ', 1) ELSE text END"""


def made(t):
    """Blocks with roles, some of whose texts are links, addresses, notices, labels or blank; every fifth without a policy."""
    c, b = F.col("text"), F.col("block_idx")
    word, n = F.split_part("text", F.lit(" "), F.lit(1)), b.cast("string")
    kinds = [F.concat(F.lit("https://a.example/"), n), F.concat(F.lit("(me."), n, F.lit("@b.example)")), F.concat(F.lit("Copyright "), n, F.lit(" "), word, F.lit(". All rights reserved.")), F.concat(F.lit("F "), (b % 90).cast("string")), F.lit("  "), F.lit("<f1-abc/> "), F.concat(F.lit("Copyright: written permission of "), word)]
    text = F.coalesce(*[F.when((F.col("doc_id") + b) % 13 == i, k) for i, k in enumerate(kinds)], c)
    r = roled(t.documents)
    caption = (F.col("derived_role") == "caption") | R.has_any(F.array("tag"), R.CAPTION_TAGS)
    return r.withColumns({"text": text, "policy": F.when(b % 5 != 0, R.translates(F.col("reason"))), "caption": caption, "zone": F.when(b % 3 == 0, "non_flow").otherwise("flow")})


_MADE_SQL = f"{ROLES_SQL}, made AS (SELECT * EXCLUDE (text, s0), s0 AS text, trim(regexp_replace(regexp_replace(s0, '<[ft]\\d+-[0-9a-z]{{3}}/>', ' ', 'g'), '\\s+', ' ', 'g')) AS compact, {norm('s0')} AS s FROM (SELECT *, {_MADE} AS s0, CASE WHEN block_idx % 5 <> 0 THEN reason IN ('caption_text', 'semantic_role=abstract', 'main_text') END AS policy, derived_role = 'caption' OR {_TAG} = 'caption' AS caption, CASE WHEN block_idx % 3 = 0 THEN 'non_flow' ELSE 'flow' END AS zone FROM roles))"
_LABEL = "(length(compact) <= 4 AND regexp_matches(replace(compact, ' ', ''), '^[\\p{L}\\p{N}]+$'))"


@query(
    "f06_keep_reason",
    f"WITH {_MADE_SQL} SELECT doc_id, item_id, CASE WHEN s = '' THEN 'empty_source_text' WHEN compact = '' THEN 'placeholder_only' WHEN NOT policy THEN 'policy_skip' WHEN {_HARD} THEN 'hard_metadata_fragment' WHEN {_LABEL} AND caption THEN 'short_non_body_label' WHEN {_LABEL} AND NOT coalesce(policy, false) AND zone = 'non_flow' THEN 'short_non_body_label' END AS reason FROM made",
)
def keep_reason(t):
    item = Q.Item(F.col("text"), F.col("policy"), F.col("caption"), F.col("zone"))
    return made(t).select("doc_id", "item_id", Q.keep_reason(item).alias("reason"))


@query("f09_hard_metadata", f"WITH {_MADE_SQL} SELECT doc_id, item_id, {_HARD} AS hard FROM made")
def hard_metadata(t):
    return made(t).select("doc_id", "item_id", Q.hard_metadata(F.col("text")).alias("hard"))


_LETTERS = "length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g'))"


def _prose(s: str) -> str:
    return f"({s} <> '' AND NOT regexp_matches({s}, '@|https?://') AND len({words(s)}) >= 8 AND {_LETTERS.format(s)} >= 30 AND NOT {_code(s)})"


def _code(s: str) -> str:
    token = "regexp_matches(x, '[A-Za-z_][A-Za-z0-9_]*\\([A-Za-z0-9_,]+\\)|[(){}\\[\\]=*<>+/,;:]|^[A-Z][A-Z0-9_.-]{3,}$|_|[A-Za-z].*\\d|\\d.*[A-Za-z]')"
    codeish = f"len(list_filter(string_split({s}, ' '), lambda x: {token}))"
    n = f"len(string_split({s}, ' '))"
    upper = f"CAST(length(regexp_replace({s}, '[^\\p{{Lu}}]', '', 'g')) AS DOUBLE) / greatest(1, {_LETTERS.format(s)})"
    operators = f"len(regexp_extract_all({s}, '[(){{}}\\[\\]=*<>+/,;:]'))"
    return f"(length({s}) >= 24 AND NOT regexp_matches({s}, '[一-鿿]') AND {n} BETWEEN 2 AND 64 AND {codeish} >= greatest(3, {n} // 2) AND (len({words(s)}) <= 4 OR ({upper} >= 0.55 AND NOT regexp_matches({s}, '{Q.PROSE_CUE}')) OR {operators} >= greatest(6, length({s}) // 18)))"


_BODYLIKE = f"(semantic_role IN ('body', 'abstract') OR structure_role = 'body' OR layout_role = 'paragraph') AND NOT (caption OR layout_role IN ('footnote', 'title', 'heading') OR semantic_role = 'reference' OR structure_role = 'reference_entry')"
_ODD = "CAST(length(regexp_replace({0}, '[\\p{{L}}\\p{{N}}.,;:!?()\\[\\]{{}}''\"\\-_/+*&%$#=@\\s]', '', 'g')) AS DOUBLE) / greatest(1, length(regexp_replace({0}, '\\s+', '', 'g'))) > 0.35"
_UNIT = "CASE WHEN block_idx % 11 = 4 THEN '__cg__:' || block_idx ELSE item_id END"


@query(
    "f07_batchable",
    f"WITH {_MADE_SQL}, b AS (SELECT *, (doc_id + block_idx) % 7 = 3 AS formula, trim(regexp_replace(compact, '\\s+', ' ', 'g')) AS p FROM made) SELECT doc_id, item_id FROM b WHERE (doc_id + block_idx) % 9 <> 1 AND block_idx % 10 <> 7 AND NOT starts_with({_UNIT}, '__cg__:') AND block_type = 'text' AND {_BODYLIKE} "
    f"AND p <> '' AND NOT {_code('s')} AND NOT ({_ODD.format('p')}) AND NOT regexp_matches(trim(text), '{X.SHORT_FRAGMENT}') AND len({words('p')}) >= CASE WHEN formula THEN 5 ELSE 8 END AND {_prose('p')} AND length(compact) BETWEEN 16 AND 1200 AND len(regexp_extract_all(text, '<[ft]\\d+-[0-9a-z]{{3}}/>')) <= 8",
)
def batchable(t):
    """Plain body prose that can share a request."""
    c, i = F.col, F.col("doc_id") + F.col("block_idx")
    body = c("semantic_role").isin("body", "abstract") | (c("structure_role") == "body") | (c("layout_role") == "paragraph")
    other = c("caption") | c("layout_role").isin("footnote", "title", "heading") | (c("semantic_role") == "reference") | (c("structure_role") == "reference_entry")
    unit = F.when(c("block_idx") % 11 == 4, F.concat(F.lit(Q.GROUP_UNIT), c("block_idx").cast("string"))).otherwise(c("item_id"))
    group = F.when(c("block_idx") % 10 == 7, "g").otherwise("")
    mode = F.when(i % 9 == 1, "direct_typst").otherwise("placeholder")
    ok = Q.batchable(c("text"), c("block_type"), body & ~other, mode, group, unit, i % 7 == 3)
    return made(t).filter(ok).select("doc_id", "item_id")


@query("f10_references", f"""WITH {ITEMS}, n AS (SELECT *, {norm('text')} AS s, regexp_replace({norm('text')}, '[À-ÖØ-öø-ÿ]', 'z', 'g') AS z FROM items), m AS (SELECT *, len(regexp_extract_all(s, '[,;]')) AS commas, regexp_matches(z, '{Q.YEAR}') AS y, regexp_matches(z, '{Q.DOI}') AS d, regexp_matches(z, '{Q.JOURNAL}') AS j, regexp_matches(z, '{Q.PAGE_RANGE}') AS p,
 regexp_matches(s, '{Q.REF_INDEX}') AS i, regexp_matches(s, '{Q.AUTHOR_START.replace("'", "''")}') AS a FROM n)
 SELECT doc_id, item_id, (d AND (y OR commas >= 1)) OR ((i OR a) AND (y OR d OR j OR p OR commas >= 2)) OR (y AND (j OR p) AND commas >= 1) AS entry, regexp_matches(s, '^[a-z(\\\\\\["''`]') OR regexp_matches(s, '^[)\\],.;:]') OR d OR j OR p OR (y AND (contains(s, ',') OR length(s) <= 240)) AS continues FROM m""")
def references(t):
    c = F.col("text")
    return items(t.documents).select("doc_id", "item_id", Q.reference_entry(c).alias("entry"), Q.reference_continuation(c).alias("continues"))


@query("f11_code_literal", f"WITH {ITEMS}, n AS (SELECT doc_id, item_id, {norm('text')} AS s FROM items) SELECT doc_id, item_id, {_code('s')} AS code FROM n")
def code_literal(t):
    return items(t.documents).select("doc_id", "item_id", Q.code_literal(F.col("text")).alias("code"))


@query("f15_english_prose", f"WITH {ITEMS}, n AS (SELECT doc_id, item_id, {norm('text')} AS s FROM items) SELECT doc_id, item_id, {_prose('s')} AS prose FROM n")
def english_prose(t):
    return items(t.documents).select("doc_id", "item_id", Q.english_prose(F.col("text")).alias("prose"))


@query("f17_garbled", f"WITH {ITEMS}, n AS (SELECT doc_id, item_id, regexp_replace(text, '\\s+', '', 'g') AS s FROM items) SELECT doc_id, item_id, s = '' OR CAST(length(regexp_replace(s, '[\\p{{L}}\\p{{N}}.,;:!?()\\[\\]{{}}''\"\\-_/+*&%$#=@]', '', 'g')) AS DOUBLE) / greatest(1, length(s)) > 0.35 AS garbled FROM n")
def garbled(t):
    return items(t.documents).select("doc_id", "item_id", Q.garbled(F.col("text")).alias("garbled"))


@query("f18_author_list")
def author_list(t):
    return items(t.documents).select("doc_id", "item_id", Q.author_list(F.col("text")).alias("authors"))


_FORMULA = "repeat('\\alpha_1 ', block_idx % 10) || repeat('{\\bf x} ', doc_id % 4) || repeat('{{α}} ', (doc_id + block_idx) % 3) || repeat('\\mathrm{a} ', block_idx % 5) || left(text, 150)"


def _times(p: str) -> str:
    return f"len(regexp_extract_all(s, '{p}'))"


@query(
    "f19_garbled_formula",
    f"WITH {ITEMS}, n AS (SELECT doc_id, item_id, trim({_FORMULA}) AS s FROM items), k AS (SELECT *, {_times(Q.ALPHA)} AS g, {_times(Q.LEGACY_STYLE)} AS l, {_times(Q.BRACED_ALPHA)} AS d, {_times(Q.CLEAN_STYLE)} AS c FROM n) SELECT doc_id, item_id, CASE WHEN s = '' THEN false WHEN g >= 8 OR l >= 2 OR d >= 2 THEN true WHEN c >= 3 AND l = 0 AND g <= 2 AND d = 0 THEN false ELSE length(s) >= 180 AND g >= 4 END AS garbled_formula FROM k",
)
def garbled_formula(t):
    b, d = F.col("block_idx"), F.col("doc_id")
    times = lambda x, n: F.repeat(F.lit(x), n.cast("int"))
    s = F.concat(times("\\alpha_1 ", b % 10), times("{\\bf x} ", d % 4), times("{{α}} ", (d + b) % 3), times("\\mathrm{a} ", b % 5), F.substring("text", 1, 150))
    return items(t.documents).select("doc_id", "item_id", Q.garbled_formula(s).alias("garbled_formula"))


@query("f20_validate_blocks", f"WITH {ROLES_SQL} SELECT doc_id, item_id, CASE WHEN x1 - 30 * (block_idx % 13) <= x0 THEN item_id || '.bbox: not a box' ELSE '' END || CASE WHEN sub_type = '' THEN item_id || '.sub_type: missing' ELSE '' END AS problems FROM roles WHERE x1 - 30 * (block_idx % 13) <= x0 OR sub_type = ''")
def validate(t):
    """Broken rules of each block as 'path: message'."""
    rules: list[tuple[Column, str]] = [(F.col("x1") - 30 * (F.col("block_idx") % 13) <= F.col("x0"), ".bbox: not a box"), (F.col("sub_type") == "", ".sub_type: missing"), (~F.col("block_type").isin("text", "table"), ".type: unexpected")]
    found = F.array_compact(F.array(*[F.when(bad, F.concat("item_id", F.lit(message))) for bad, message in rules]))
    return blocks(t.documents).select("doc_id", "item_id", found.alias("p")).filter(F.size("p") > 0).select("doc_id", "item_id", F.array_join("p", "").alias("problems"))


@query("f21_missing_fields", f"WITH {BLOCKS} SELECT doc_id, item_id, array_to_string(list_filter([CASE WHEN sub_type = '' THEN 'sub_type' END, CASE WHEN derived_role = '' THEN 'derived_role' END, CASE WHEN tag = '' THEN 'tag' END], lambda x: x IS NOT NULL), ',') AS missing FROM blocks")
def missing_fields(t):
    names = ["sub_type", "derived_role", "tag"]
    return blocks(t.documents).select("doc_id", "item_id", F.array_join(F.array_compact(F.array(*[F.when(F.col(n) == "", F.lit(n)) for n in names])), ",").alias("missing"))


@query("f22_page_range", f"WITH {ITEMS} SELECT doc_id, item_id FROM items WHERE page_idx BETWEEN 1 AND 3")
def page_range(t):
    return items(t.documents).filter(F.col("page_idx").between(1, 3)).select("doc_id", "item_id")


@query("f25_export_gate", f"WITH {BLOCKS} SELECT doc_id, item_id, final_status FROM blocks WHERE final_status IN ('kept_origin', 'failed') AND NOT (list_contains(route_path, 'batched') OR list_contains(route_path, 'dlq'))")
def export_gate(t):
    excused = F.arrays_overlap("route_path", F.array(F.lit("batched"), F.lit("dlq")))
    return blocks(t.documents).filter(F.col("final_status").isin("kept_origin", "failed") & ~excused).select("doc_id", "item_id", "final_status")


@query("f26_role_predicates", f"WITH {ROLES_SQL} SELECT doc_id, item_id, derived_role = 'caption' OR {_TAG} = 'caption' AS caption, layout_role = 'footnote' AS footnote, semantic_role = 'reference' OR structure_role = 'reference_entry' AS reference, layout_role IN ('title', 'heading') AS title_like FROM roles")
def role_predicates(t):
    c = F.col
    return roled(t.documents).select("doc_id", "item_id", ((c("derived_role") == "caption") | R.has_any(F.array("tag"), R.CAPTION_TAGS)).alias("caption"), (c("layout_role") == "footnote").alias("footnote"), ((c("semantic_role") == "reference") | (c("structure_role") == "reference_entry")).alias("reference"), c("layout_role").isin("title", "heading").alias("title_like"))


@query("f31_skip_defaults", f"WITH {BLOCKS} SELECT CASE block_type WHEN 'text' THEN '' ELSE 'skip_' || block_type END AS label, count(*) AS n, count(*) FILTER (final_status = 'kept_origin') AS resets FROM blocks GROUP BY 1")
def skip_defaults(t):
    label = F.when(F.col("block_type") == "text", "").otherwise(F.concat(F.lit("skip_"), "block_type"))
    return blocks(t.documents).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("final_status") == "kept_origin").alias("resets"))


@query("f32_title_skip", f"WITH {BLOCKS} SELECT doc_id, item_id, CASE WHEN sub_type = 'title' THEN text END AS output, CASE WHEN sub_type = 'title' THEN 'skip_title' ELSE '' END AS label FROM blocks")
def title_skip(t):
    title = F.col("sub_type") == "title"
    return blocks(t.documents).select("doc_id", "item_id", F.when(title, F.col("text")).alias("output"), F.when(title, "skip_title").otherwise("").alias("label"))


@query("f35_cjk_dominant", f"WITH {ITEMS}, n AS (SELECT doc_id, item_id, {norm('text')} AS s FROM items), c AS (SELECT *, len(regexp_extract_all(s, '[㐀-䶿一-鿿]')) AS cjk FROM n) SELECT doc_id, item_id, length(s) >= 16 AND cjk >= 10 AND cjk >= 2 * len(regexp_extract_all(s, '[A-Za-z]')) AS cjk_dominant FROM c")
def cjk_dominant(t):
    return items(t.documents).select("doc_id", "item_id", Q.cjk_dominant(F.col("text")).alias("cjk_dominant"))


@query("e01_assertions", f"WITH {ITEMS} SELECT doc_id, item_id, length(text) >= 20 AS long_enough, contains(text, 'the') AS has_expected, NOT contains(text, 'stupid') AS clean, CAST((CASE WHEN length(text) >= 20 THEN 1 ELSE 0 END) + (CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(text, 'stupid') THEN 0 ELSE 1 END) AS DOUBLE) / 3 AS score FROM items")
def assertions(t):
    """Row checks and the share that pass."""
    checks = {"long_enough": F.length("text") >= 20, "has_expected": F.col("text").contains("the"), "clean": ~F.col("text").contains("stupid")}
    return items(t.documents).select("doc_id", "item_id", *[c.alias(n) for n, c in checks.items()], (sum(c.cast("double") for c in checks.values()) / len(checks)).alias("score"))


@query("e02_case_drift", f"WITH {BLOCKS}, r AS (SELECT doc_id, item_id, CASE WHEN block_idx % 7 = 0 THEN 'failed' ELSE final_status END AS final_status FROM blocks) SELECT doc_id, item_id, b.final_status AS saved, r.final_status AS replayed FROM blocks b JOIN r USING (doc_id, item_id) WHERE b.final_status IS DISTINCT FROM r.final_status")
def case_drift(t):
    saved = blocks(t.documents).select("doc_id", "item_id", F.col("final_status").alias("saved"))
    replay = blocks(t.documents).select("doc_id", "item_id", F.when(F.col("block_idx") % 7 == 0, "failed").otherwise(F.col("final_status")).alias("replayed"))
    return saved.join(replay, ["doc_id", "item_id"]).filter(~F.col("saved").eqNullSafe(F.col("replayed")))


@query("e03_manifest_check", "SELECT source || '/' || n_chars AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def manifest_check(t):
    """Ids that a manifest lists more than once."""
    return t.documents.groupBy(F.concat_ws("/", "source", "n_chars").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("x05_policy_hints", f"WITH {ITEMS}, h AS (SELECT doc_id, item_id, hint, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k_at DESC) AS rn FROM (SELECT doc_id, item_id, 'style ' || k AS hint, k AS k_at FROM items, unnest(range(3)) AS u(k) WHERE (block_idx + k) % 3 = 0)) SELECT doc_id, item_id, concat_ws(chr(10), source, hint) AS hints FROM items i LEFT JOIN (SELECT doc_id, item_id, hint FROM h WHERE rn = 1) USING (doc_id, item_id)")
def policy_hints(t):
    """The last hint of an item is appended to what it has."""
    i = items(t.documents)
    h = i.select("doc_id", "item_id", "block_idx", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("at")).filter((F.col("block_idx") + F.col("at")) % 3 == 0)
    h = h.groupBy("doc_id", "item_id").agg(F.concat(F.lit("style "), F.max("at").cast("string")).alias("hint"))
    return i.join(h, ["doc_id", "item_id"], "left").select("doc_id", "item_id", F.concat_ws("\n", "source", "hint").alias("hints"))


@query("x09_policy_counts", f"WITH {ROLES_SQL}, n AS (SELECT *, {norm('text')} AS s FROM roles) SELECT CASE WHEN block_type <> 'text' THEN 'skip_type' WHEN sub_type = 'title' THEN 'skip_title' WHEN semantic_role = 'reference' THEN 'skip_reference' WHEN regexp_matches(s, '{X.SHORT_FRAGMENT}') THEN 'skip_short' ELSE 'translate' END AS label, count(*) AS n FROM n GROUP BY 1")
def policy_counts(t):
    """An ordered list of policies; each item counts for the first that takes it."""
    policies = [("skip_type", F.col("block_type") != "text"), ("skip_title", F.col("sub_type") == "title"), ("skip_reference", F.col("semantic_role") == "reference"), ("skip_short", X.short_fragment(X.normalize_space(F.col("text"))))]
    label = F.coalesce(Q.first_match(policies), F.lit("translate"))
    return roled(t.documents).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def scan_saved(saved: DataFrame, replayed: DataFrame, key: list[str], order: list[str], *, status: str = "", reason: str = "", page: int | None = None, query: str = "", offset: int = 0, limit: int = 20, only_drifted: bool = True) -> DataFrame:
    """Saved rows that the filters take, in order and cut to a slice, beside their replays; of those with ``only_drifted`` the changed ones.

    ``query`` is looked for in ids, texts, reasons and labels, letter case aside.
    """
    s = saved
    if status.strip():
        s = s.filter(F.col("final_status") == status.strip())
    if reason.strip():
        s = s.filter(F.col("skip_reason") == reason.strip())
    if page is not None:
        s = s.filter(F.col("page_idx") + 1 == page)
    if query.strip():
        hay = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("item_id", "source_text", "translated_text", "skip_reason", "label")]
        s = s.filter(F.exists(F.array(*hay), lambda x: x.contains(query.strip().lower())))
    s = s.orderBy(*order).offset(offset).limit(max(0, limit))
    both = s.join(replayed.select(*key, F.col("final_status").alias("replayed")), key, "left")
    drifted = ~F.col("final_status").eqNullSafe(F.col("replayed"))
    return both.withColumn("drifted", drifted).filter("drifted") if only_drifted else both.withColumn("drifted", drifted)


@query(
    "f03_scan_drift",
    f"WITH {ROLES_SQL}, s AS (SELECT * FROM roles WHERE final_status = 'kept_origin' AND page_idx = 0 AND contains(lower(item_id || chr(0) || text || chr(0) || '' || chr(0) || reason || chr(0) || sub_type), 'an') ORDER BY block_idx, doc_id LIMIT 300 OFFSET 20) SELECT doc_id, item_id, final_status AS saved, CASE WHEN (doc_id + block_idx) % 3 = 0 THEN 'translated' ELSE final_status END AS replayed FROM s WHERE (doc_id + block_idx) % 3 = 0",
)
def scan_drift(t):
    """The saved side is filtered, ordered and sliced before the replays are looked up."""
    r = roled(t.documents).select("doc_id", "page_idx", "block_idx", "item_id", F.col("text").alias("source_text"), F.lit("").alias("translated_text"), F.col("reason").alias("skip_reason"), F.col("sub_type").alias("label"), "final_status")
    replayed = r.select("doc_id", "item_id", F.when((F.col("doc_id") + F.col("block_idx")) % 3 == 0, "translated").otherwise(F.col("final_status")).alias("final_status"))
    found = scan_saved(r, replayed, ["doc_id", "item_id"], ["block_idx", "doc_id"], status="kept_origin", page=1, query=" AN ", offset=20, limit=300)
    return found.select("doc_id", "item_id", F.col("final_status").alias("saved"), "replayed")
