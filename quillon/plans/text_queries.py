"""Queries of text functions (C, P14, P20, P22-P24, F23, G) over items and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import catalog as K
from quillon.functions import text as X
from quillon.plans.items import BLOCKS, ITEMS, blocks, items
from quillon.plans.registry import query

NORM = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
WORDS = "regexp_extract_all({0}, '[A-Za-z]+(?:[-''][A-Za-z]+)?')"


def norm(c: str) -> str:
    return NORM.format(c)


def words(c: str) -> str:
    return WORDS.format(c)


def last(c: str) -> str:
    return f"coalesce(lower(({words(c)})[-1]), '')"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def starts(c: str) -> str:
    return f"({c} <> '' AND (regexp_matches({c}, '^[a-z]') OR {last(f'left({c}, 32)')} IN {listed(X.CONTINUATION_STARTS)}))"


def ends(c: str) -> str:
    return f"({c} <> '' AND ({c} LIKE '%-' OR (NOT regexp_matches({c}, '[.!?:;]$') AND {last(c)} IN {listed(X.CONTINUATION_ENDS)})))"


@query("c01_normalize", f"WITH {ITEMS} SELECT doc_id, item_id, {norm('text')} AS normalized FROM items")
def normalize(t):
    return items(t.documents).select("doc_id", "item_id", X.normalize_space(F.col("text")).alias("normalized"))


@query("c02_last_word", f"WITH {ITEMS} SELECT doc_id, item_id, {last('text')} AS last_word FROM items")
def last_word(t):
    return items(t.documents).select("doc_id", "item_id", X.last_word(F.col("text")).alias("last_word"))


@query(
    "c03_lexical_cues",
    f"WITH {ITEMS}, n AS (SELECT *, {norm('text')} AS s FROM items) SELECT doc_id, item_id, {starts('s')} AS starts_on, {ends('s')} AS ends_open, regexp_matches(s, '^(?:\\(?\\d+(?:\\.\\d+)*\\)?[.)]?\\s+|[A-Z][A-Z\\s\\-]{{3,}}|[•\\-*]\\s+)') AS heading, "
    f"regexp_matches(s, '[.!?:;]$') AS terminal, {last('s')} IN {listed(X.SUSPICIOUS_ENDS)} AS suspicious FROM n",
)
def cues(t):
    c = F.col("text")
    return items(t.documents).select("doc_id", "item_id", X.starts_like_continuation(c).alias("starts_on"), X.ends_like_continuation(c).alias("ends_open"), X.starts_like_heading(c).alias("heading"), X.ends_terminal(c).alias("terminal"), X.last_word(c).isin(X.SUSPICIOUS_ENDS).alias("suspicious"))


@query("c04_math_balance", f"WITH {ITEMS}, n AS (SELECT *, replace({norm('text')}, '\\$', '') AS s FROM items) SELECT doc_id, item_id, length(s) - length(replace(s, '$', '')) AS dollars, (length(s) - length(replace(s, '$', ''))) % 2 = 0 AS balanced FROM n")
def math_balance(t):
    n = X.dollar_balance(F.col("text")).cast("long")
    return items(t.documents).select("doc_id", "item_id", n.alias("dollars"), (n % 2 == 0).alias("balanced"))


@query("c05_script_counts", f"WITH {ITEMS} SELECT doc_id, item_id, len(regexp_extract_all(text, '[一-鿿]')) AS cjk, len({words('text')}) AS english_words, list_max([0] || list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''./%+\\-]*(?:\\s+[A-Za-z][A-Za-z0-9''./%+\\-]*)*'), lambda x: len({words('x')}))) AS longest_run, regexp_matches(trim(text), '^[A-Za-z][A-Za-z0-9._/-]{{0,7}}$') AS short_fragment FROM items")
def script_counts(t):
    c = F.col("text")
    longest = F.coalesce(F.array_max(X.chunk_word_lengths(c)), F.lit(0)).cast("long")
    return items(t.documents).select("doc_id", "item_id", F.regexp_count(c, F.lit("[一-鿿]")).cast("long").alias("cjk"), X.english_words(c).cast("long").alias("english_words"), longest.alias("longest_run"), X.short_fragment(c).alias("short_fragment"))


#: common short words stand in for formulas: each becomes a placeholder
MARKS = {" of ": " <f1-ofx/> ", " de ": " <f2-dex/> ", " to ": " <t3-tox/> ", " la ": " @@P4@@ ", " der ": " [[FORMULA_5]] "}


def _nested(inner: str, pairs) -> str:
    for k, v in pairs:
        inner = f"replace({inner}, '{k}', '{v}')"
    return inner


_MARKED_SQL = f"marked AS (SELECT *, {_nested('text', MARKS.items())} AS protected FROM items)"


def marked(t):
    c = F.col("text")
    for k, v in MARKS.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return items(t.documents).withColumn("protected", c)


_PH = "regexp_extract_all(protected, '<[ft]\\d+-[0-9a-z]{3}/>|\\[\\[FORMULA_\\d+\\]\\]|@@P\\d+@@')"


@query("c06_placeholders", f"WITH {ITEMS}, {_MARKED_SQL} SELECT doc_id, item_id, array_to_string({_PH}, ',') AS placeholders, len({_PH}) AS n, len(list_distinct({_PH})) AS n_distinct, regexp_replace(protected, '<[ft]\\d+-[0-9a-z]{{3}}/>|\\[\\[FORMULA_\\d+\\]\\]|@@P\\d+@@', ' ', 'g') AS stripped FROM marked")
def placeholders(t):
    p = X.placeholder_sequence(F.col("protected"))
    return marked(t).select("doc_id", "item_id", F.array_join(p, ",").alias("placeholders"), F.size(p).cast("long").alias("n"), F.size(F.array_distinct(p)).cast("long").alias("n_distinct"), X.strip_placeholders(F.col("protected")).alias("stripped"))


@query("c08_restore_tokens", f"WITH {ITEMS} SELECT doc_id, item_id, text AS restored FROM items")
def restore(t):
    """Protecting and restoring is the identity on every item."""
    tokens = F.array(*[F.struct(F.lit(v.strip()).alias("tag"), F.lit(k.strip()).alias("text")) for k, v in MARKS.items()])
    return marked(t).select("doc_id", "item_id", X.restore_tokens(F.col("protected"), tokens).alias("restored"))


@query("c10_cache_key", f"WITH {ITEMS} SELECT doc_id, item_id, sha256(concat_ws(chr(31), lang, source, trim(text))) AS cache_key, left(sha256(concat_ws(chr(31), lang, source, trim(text))), 2) AS shard FROM items")
def cache_key(t):
    key = X.signature(F.col("lang"), F.col("source"), F.trim("text"))
    return items(t.documents).select("doc_id", "item_id", key.alias("cache_key"), F.substring(key, 1, 2).alias("shard"))


@query("c16_segment_plan", f"WITH {ITEMS}, {_MARKED_SQL}, s AS (SELECT doc_id, item_id, list_filter(list_transform(string_split_regex(protected, '<[ft]\\d+-[0-9a-z]{{3}}/>'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM marked) SELECT doc_id, item_id, len(parts) AS n_segments, array_to_string(parts, '|') AS segments FROM s")
def segment_plan(t):
    parts = F.filter(F.transform(F.split("protected", r"<[ft]\d+-[0-9a-z]{3}/>"), lambda x: F.trim(x)), lambda x: x != "")
    return marked(t).select("doc_id", "item_id", F.size(parts).cast("long").alias("n_segments"), F.array_join(parts, "|").alias("segments"))


@query("c17_chunk_words", f"WITH {ITEMS}, w AS (SELECT doc_id, item_id, string_split({norm('text')}, ' ') AS ws FROM items) SELECT doc_id, item_id, i // 48 AS chunk, array_to_string(ws[i + 1:i + 48], ' ') AS chunk_text FROM w, unnest(range(0, len(ws), 48)) AS u(i)")
def chunk_words(t):
    return items(t.documents).select("doc_id", "item_id", F.posexplode(X.chunk_words(F.col("text"))).alias("chunk", "chunk_text")).withColumn("chunk", F.col("chunk").cast("long"))


@query("c18_formula_density", f"WITH {ITEMS}, {_MARKED_SQL} SELECT doc_id, item_id, CASE WHEN len({_PH}) > 0 THEN round_even(CAST(len({_PH}) AS DOUBLE) / length(protected), 4) ELSE 0.0 END AS density FROM marked")
def formula_density(t):
    n = F.size(X.placeholder_sequence(F.col("protected")))
    return marked(t).select("doc_id", "item_id", X.formula_density(F.col("protected"), n).alias("density"))


@query("c19_placeholder_alias", f"WITH {ITEMS}, {_MARKED_SQL}, p AS (SELECT doc_id, item_id, {_PH} AS ps FROM marked), d AS (SELECT doc_id, item_id, x AS placeholder, min(i) AS first_at FROM (SELECT doc_id, item_id, unnest(ps) AS x, unnest(range(len(ps))) AS i FROM p) GROUP BY ALL) SELECT doc_id, item_id, placeholder, '@@P' || row_number() OVER (PARTITION BY doc_id, item_id ORDER BY first_at) || '@@' AS alias FROM d")
def placeholder_alias(t):
    """Distinct placeholders in order of first use, numbered from 1."""
    return marked(t).select("doc_id", "item_id", F.posexplode(F.array_distinct(X.placeholder_sequence(F.col("protected")))).alias("i", "placeholder")).select("doc_id", "item_id", "placeholder", F.format_string("@@P%d@@", F.col("i") + 1).alias("alias"))


def _case(rules, text, otherwise):
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{otherwise}' END"


_MESSAGES = ["HTTP 429 rate limit", "connection timeout", "model refusal", "placeholder inventory mismatch", "odd reply", "Retry-After: 3"]
_NAMES = ["book: batch 1/2", "classification page 3", "continuation-review 1", "mixed-split x", "garbled-reconstruct", "domain-infer", "a typst-repair b", "", "other"]
_ARRAY = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
_PICK = lambda v, at: F.get(F.array(*map(F.lit, v)), F.pmod(at, F.lit(len(v))).cast("int"))


@query(
    "c20_error_taxonomy",
    f"WITH e AS (SELECT event_id, ({_ARRAY(_MESSAGES)})[event_id % 6 + 1] AS message, CASE event_id % 11 WHEN 0 THEN 429 WHEN 1 THEN 503 END AS status, ({_ARRAY(_NAMES)})[event_id % 9 + 1] AS label FROM events) "
    f"SELECT event_id, CASE WHEN status = 429 THEN 'rate_limit_error' WHEN status >= 500 THEN 'transport_error' ELSE {_case(K.ERRORS, 'lower(message)', 'protocol_error')} END AS error_class, CASE WHEN label = '' THEN 'unspecified' ELSE {_case(K.LABELS, 'lower(label)', 'other_llm')} END AS request_stage FROM e",
)
def error_taxonomy(t):
    i = F.col("event_id")
    status = F.when(i % 11 == 0, 429).when(i % 11 == 1, 503)
    return t.events.select("event_id", K.error_class(_PICK(_MESSAGES, i), status).alias("error_class"), K.request_stage(_PICK(_NAMES, i)).alias("request_stage"))


@query("c22_url_tail", "SELECT page_id, nullif(trim(string_split(string_split(string_split(trim(url), '#')[1], '?')[1], '/')[-1]), '') AS file_name FROM pages")
def url_tail(t):
    return t.pages.select("page_id", X.url_file_name(F.col("url")).alias("file_name"))


_LEVEL_NAMES = ["keep", "Fixed", "preferred", "", "不翻译", "required", "no-translate", "odd"]
_MODES = ["regex", "CI", "exact", "", "ignore-case"]


@query(
    "c23_glossary_entries",
    f"WITH g AS (SELECT item_id, trim(split_part(text, ' ', 1)) AS src, lower(({_ARRAY(_LEVEL_NAMES)})[item_id % 8 + 1]) AS lv, lower(({_ARRAY(_MODES)})[item_id % 5 + 1]) AS mm FROM benchmark), "
    f"n AS (SELECT item_id, src AS source, CASE WHEN lv IN {listed(K.LEVELS['preserve'])} THEN 'preserve' WHEN lv IN {listed(K.LEVELS['canonical'])} THEN 'canonical' ELSE 'preferred' END AS level, CASE WHEN mm = 'regex' THEN 'regex' WHEN mm IN {listed(K.MATCH_MODES['case_insensitive'])} THEN 'case_insensitive' ELSE 'exact' END AS match_mode FROM g) "
    "SELECT item_id, source, CASE WHEN level = 'preserve' THEN source ELSE upper(source) END AS target, level, match_mode FROM n WHERE source <> '' AND length(source) <= 200",
)
def glossary_entries(t):
    g = glossary(t)
    return g.filter((F.col("source") != "") & (F.length("source") <= 200)).select("item_id", "source", "target", "level", "match_mode")


def glossary(t):
    """A glossary from the first words of the benchmark items."""
    i = F.col("item_id")
    source = F.trim(F.split_part("text", F.lit(" "), F.lit(1)))
    level = K.glossary_level(_PICK(_LEVEL_NAMES, i))
    return t.benchmark.select("item_id", source.alias("source"), F.when(level == "preserve", source).otherwise(F.upper(source)).alias("target"), level.alias("level"), K.match_mode(_PICK(_MODES, i)).alias("match_mode"))


@query("p14_preview", f"WITH {ITEMS}, n AS (SELECT doc_id, item_id, {norm('text')} AS s FROM items) SELECT doc_id, item_id, CASE WHEN length(s) <= 220 THEN s ELSE rtrim(left(s, 219)) || '…' END AS preview FROM n")
def preview(t):
    return items(t.documents).select("doc_id", "item_id", X.preview(F.col("text")).alias("preview"))


_STAGES = ["ocr_upload", "translating", "rendering", "finished", "translation_batches", "overlay", "other", "normalizing"]


@query(
    "p16_stage_names",
    f"WITH e AS (SELECT event_id, ({_ARRAY(_STAGES)})[event_id % 8 + 1] AS stage, CASE event_id % 3 WHEN 0 THEN 'stage_progress' ELSE 'note' END AS event FROM events) SELECT event_id, stage, "
    + "CASE " + " ".join(f"WHEN stage IN {listed(v)} THEN '{k}'" for k, v in K.USER_STAGES.items()) + " END AS user_stage, "
    + "CASE " + " ".join(f"WHEN stage IN {listed(v)} THEN '{k}'" for k, v in K.UNITS.items()) + " WHEN event = 'stage_progress' THEN 'step' ELSE 'none' END AS unit FROM e",
)
def stage_names(t):
    i = F.col("event_id")
    e = t.events.select("event_id", _PICK(_STAGES, i).alias("stage"), F.when(i % 3 == 0, "stage_progress").otherwise("note").alias("event"))
    return e.select("event_id", "stage", K.user_stage(F.col("stage")).alias("user_stage"), K.progress_unit(F.col("stage"), F.col("event")).alias("unit"))


@query("p20_redact", f"WITH {ITEMS} SELECT doc_id, item_id, replace(replace(text, 'the', '[REDACTED]'), 'ing', '[REDACTED]') AS redacted FROM items")
def redact(t):
    return items(t.documents).select("doc_id", "item_id", X.redact(F.col("text"), F.array(F.lit("the"), F.lit(" "), F.lit("ing"))).alias("redacted"))


@query("p22_first_non_blank", f"WITH {BLOCKS} SELECT doc_id, item_id, coalesce(nullif(trim(tag), ''), nullif(trim(derived_role), ''), nullif(trim(sub_type), ''), block_type) AS label FROM blocks")
def first_non_blank(t):
    return blocks(t.documents).select("doc_id", "item_id", X.first_non_blank(F.col("tag"), F.col("derived_role"), F.col("sub_type"), F.col("block_type")).alias("label"))


@query("p23_bbox_valid", f"WITH {BLOCKS} SELECT doc_id, item_id, CASE WHEN x1 - 30 * (block_idx % 13) > x0 THEN x1 - 30 * (block_idx % 13) END AS right_edge FROM blocks")
def bbox_valid(t):
    from quillon.functions.geometry import valid_box

    box = F.array("x0", "y0", F.col("x1") - 30 * (F.col("block_idx") % 13), "y1")
    return blocks(t.documents).select("doc_id", "item_id", F.get(valid_box(box), F.lit(2)).alias("right_edge"))


@query("p24_canonical_id", f"WITH {ITEMS} SELECT doc_id, item_id, regexp_extract(item_id, '^(p\\d+)-b(\\d+)', 1) || '-b' || lpad(regexp_extract(item_id, '^(p\\d+)-b(\\d+)', 2), 4, '0') AS canonical_id FROM items")
def canonical_id(t):
    part = lambda i: F.regexp_extract("item_id", r"^(p\d+)-b(\d+)", i)
    return items(t.documents).select("doc_id", "item_id", F.concat(part(1), F.lit("-b"), F.lpad(part(2), 4, "0")).alias("canonical_id"))


@query("f23_page_ranges", "WITH r AS (SELECT o_orderkey, (o_orderkey % 7 + 1) || '-' || (o_orderkey % 7 + 1 + o_orderkey % 4) || ', ' || (o_orderkey % 3 + 1) AS ranges FROM orders) SELECT o_orderkey, array_to_string(list_sort(list_distinct(range(o_orderkey % 7 + 1, o_orderkey % 7 + 2 + o_orderkey % 4) || [o_orderkey % 3 + 1])), ',') AS pages FROM r")
def page_ranges(t):
    k = F.col("o_orderkey")
    text = F.format_string("%d-%d, %d", k % 7 + 1, k % 7 + 1 + k % 4, k % 3 + 1)
    return t.orders.select("o_orderkey", F.array_join(X.parse_page_ranges(text), ",").alias("pages"))


@query("f24_order_ranges", "SELECT o_orderkey, array_to_string(list_sort(list_filter(range(least(o_orderkey % 9, o_orderkey % 5), greatest(o_orderkey % 9, o_orderkey % 5) + 1), lambda x: x % 2 = 0)), ',') AS ids FROM orders")
def order_ranges(t):
    """Ranges in either direction, kept to the valid (even) ids."""
    k = F.col("o_orderkey")
    a, b = k % 9, k % 5
    ids = F.array_intersect(F.sequence(F.least(a, b), F.greatest(a, b)), F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"), F.lit(2).cast("long")))
    return t.orders.select("o_orderkey", F.array_join(F.array_sort(ids), ",").alias("ids"))


@query("g01_tags", f"WITH {BLOCKS} SELECT doc_id, item_id, array_to_string(list_filter([lower(trim(tag)), lower(sub_type)], lambda x: x <> ''), ',') AS tags, lower(trim(tag)) IN ('caption', 'abstract') OR sub_type IN ('caption', 'abstract') AS overlaps FROM blocks")
def tags(t):
    from quillon.functions.roles import has_any, normalize_tags

    both = F.array("tag", "sub_type")
    return blocks(t.documents).select("doc_id", "item_id", F.array_join(normalize_tags(both), ",").alias("tags"), has_any(both, ["caption", "abstract"]).alias("overlaps"))


@query("g06_json_columns", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(nullif(event_type, ''), 'event') AS kind FROM events")
def json_columns(t):
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"), X.first_non_blank(F.col("event_type"), F.lit("event")).alias("kind"))


@query("g10_guidance_lines", "SELECT source, doc_id // 400 AS part, string_agg(doc_id || ': ' || lang, chr(10) ORDER BY doc_id) AS lines FROM documents GROUP BY source, doc_id // 400")
def guidance_lines(t):
    """Rows of a group as ordered lines of text; a source's documents in parts of four hundred ids."""
    d = t.documents.groupBy("source", F.expr("doc_id div 400").alias("part")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "lang"))).alias("r"))
    return d.select("source", "part", F.array_join(F.transform("r", lambda x: F.concat_ws(": ", x["doc_id"].cast("string"), x["lang"])), "\n").alias("lines"))
