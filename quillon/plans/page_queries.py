"""Queries of records, page policies, protection and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import more as M
from quillon.functions import text as X
from quillon.operators import fitting as T
from quillon.operators import pages as G
from quillon.operators import protection as Z
from quillon.operators import sequential as S
from quillon.plans.items import BLOCKS, ITEMS, blocks, cycle, dealt, items
from quillon.plans.registry import query
from quillon.plans.rule_queries import ROLES_SQL, roled
from quillon.plans.text_queries import norm
from quillon.sources import sinks


@query("p11_records", f"WITH {ROLES_SQL} SELECT doc_id, item_id, page_idx, block_idx, block_type, layout_role, semantic_role, structure_role, text AS source_text, text AS protected_source_text, reason IN ('caption_text', 'semantic_role=abstract', 'main_text') AS should_translate, '' AS translated_text, 'single' AS unit_kind FROM roles")
def records(t):
    from quillon.functions.roles import translates

    return roled(t.documents).select("doc_id", "item_id", "page_idx", "block_idx", "block_type", "layout_role", "semantic_role", "structure_role", F.col("text").alias("source_text"), F.col("text").alias("protected_source_text"), translates(F.col("reason")).alias("should_translate"), F.lit("").alias("translated_text"), F.lit("single").alias("unit_kind"))


@query("p19_library_rows", "SELECT c_custkey AS book_id, coalesce(nullif(trim(c_name), ''), 'untitled') AS title, count(o_orderkey) AS jobs, max(o_orderdate) AS updated FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def library_rows(t):
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("jobs"), F.max("o_orderdate").alias("updated"))
    return t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("book_id"), F.coalesce(X.first_non_blank(F.col("c_name")), F.lit("untitled")).alias("title"), F.coalesce("jobs", F.lit(0)).alias("jobs"), "updated")


@query("p21_redact_events", "SELECT event_id, replace(event_type || ' by ' || user_id, 'click', '[REDACTED]') AS message, coalesce(nullif(event_type, ''), 'event') AS event FROM events")
def redact_events(t):
    message = F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string"))
    return t.events.select("event_id", X.redact(message, F.array(F.lit("click"), F.lit(""))).alias("message"), X.first_non_blank(F.col("event_type"), F.lit("event")).alias("event"))


@query("p27_mirror_child", "SELECT event_id, 'ocr_' || event_type AS event, user_id AS child_job, CAST(json_extract(props, '$.k') AS BIGINT) AS payload_k FROM events")
def mirror_child(t):
    """A child's event in its parent's namespace, its payload wrapped."""
    wrapped = F.to_json(F.struct(F.col("user_id").alias("child_job"), F.from_json("props", "map<string,string>").alias("payload")))
    w = F.from_json(wrapped, "child_job long, payload map<string,string>")
    return t.events.select("event_id", F.concat(F.lit("ocr_"), "event_type").alias("event"), w["child_job"].alias("child_job"), w["payload"]["k"].cast("long").alias("payload_k"))


@query("f14_literal_label", f"WITH {BLOCKS} SELECT doc_id, item_id, CASE WHEN block_type = 'table' THEN 'code' WHEN contains(text, '###') THEN 'translate_literal' ELSE '' END AS label FROM blocks")
def literal_label(t):
    return blocks(t.documents).select("doc_id", "item_id", F.when(F.col("block_type") == "table", "code").when(F.col("text").contains("###"), "translate_literal").otherwise("").alias("label"))


def _stages():
    """The page policies in order (columns need a session, so they are made when asked for)."""
    return [
        ("type", G.skip_stage("skip_type", F.col("block_type") != "text")),
        ("title", G.skip_stage("skip_title", F.col("sub_type") == "title")),
        ("metadata", G.skip_stage("skip_metadata", (F.col("sub_type") == "metadata") & (F.col("page_idx") < 2))),
        ("reference", G.skip_stage("skip_reference", (F.col("semantic_role") == "reference") & (X.english_words(F.col("text")) < 12))),
    ]


@query("f34_legacy_policies", f"WITH {ROLES_SQL} SELECT doc_id, item_id, CASE WHEN block_type <> 'text' THEN 'skip_type' WHEN sub_type = 'title' THEN 'skip_title' WHEN sub_type = 'metadata' AND page_idx < 2 THEN 'skip_metadata' WHEN semantic_role = 'reference' AND len(regexp_extract_all(text, '[A-Za-z]+(?:[-''][A-Za-z]+)?')) < 12 THEN 'skip_reference' ELSE '' END AS label FROM roles")
def legacy_policies(t):
    return G.run_stages(roled(t.documents).withColumn("label", F.lit("")), _stages()).select("doc_id", "item_id", "label")


@query("x06_profile_stages", f"WITH {ROLES_SQL} SELECT CASE WHEN block_type <> 'text' THEN 'skip_type' WHEN sub_type = 'metadata' AND page_idx < 2 THEN 'skip_metadata' ELSE '' END AS label, count(*) AS n FROM roles GROUP BY 1")
def profile_stages(t):
    """The same list under a profile that turns two stages off."""
    done = G.run_stages(roled(t.documents).withColumn("label", F.lit("")), _stages(), G.Profile("plain", frozenset({"title", "reference"})))
    return done.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_TERMS = [
    {"source": "the", "target": "der", "level": "canonical", "match_mode": "case_insensitive", "context": ""}, {"source": "of", "target": "von", "level": "preserve", "match_mode": "exact", "context": "that"},
    {"source": r"\b[a-z]+tion\b", "target": "Sache", "level": "preserve", "match_mode": "regex", "context": ""},
]


def tagged(t, *carried: str):
    """Items with formulas between their words, protected with a glossary; ``carried`` are columns of blocks that stay."""
    i = F.col("doc_id") + F.col("block_idx")
    math = cycle([" \\alpha_{1}+x^{2} ", " E = m c^{2}, ", " C-H ", " {\\bf k}where ", " \\beta ", " a, b, c "], i)
    text = F.concat(F.substring_index("text", " ", 3), math, F.col("text"))
    made = dealt(blocks(t.documents) if carried else items(t.documents))
    return made.select("doc_id", "item_id", *carried, Z.protect(_TERMS)(text).alias("p")).select("doc_id", "item_id", *carried, "p.*")


@query("c07_protect")
def protect(t):
    return tagged(t).select("doc_id", "item_id", "text", F.size("protected_map").alias("n"))


@query("g05_formula_maps")
def formula_maps(t):
    """Formulas of a protected map, and the protected map made of them again."""
    formulas = Z.formula_map(F.col("protected_map"))
    back = Z.protected_map(formulas)
    return tagged(t).select("doc_id", "item_id", F.to_json(formulas).alias("formulas"), F.to_json(back).alias("protected_map"))


@query("c15_box_split")
def box_split(t):
    """Protected texts split over three boxes of different room."""
    formulas = Z.formula_map(F.col("protected_map"))
    n = F.length("text").cast("double")
    room = F.array(n * 0.2, n * 0.1, n * 0.3)
    return tagged(t).select("doc_id", "item_id", F.array_join(S.box_parts("text", formulas, room), "\n").alias("parts"))


@query("c25_pseudo_lines", f"WITH {ITEMS}, w AS (SELECT doc_id, item_id, string_split({norm('text')}, ' ') AS ws FROM items) SELECT doc_id, item_id, i // 10 AS line, array_to_string(ws[i + 1:i + 10], ' ') AS line_text, CAST(40 + 12 * (i // 10) AS DOUBLE) AS y0 FROM w, unnest(range(0, len(ws), 10)) AS u(i)")
def pseudo_lines(t):
    """Lines of ten words, twelve points apart."""
    lines = items(t.documents).select("doc_id", "item_id", F.posexplode(X.chunk_words(F.col("text"), 10)).alias("line", "line_text"))
    return lines.select("doc_id", "item_id", F.col("line").cast("long").alias("line"), "line_text", (40 + 12 * F.col("line")).cast("double").alias("y0"))


_CUES = ["angle", "value", "rotation angle", "function of", "sum", "angles"]


@query("c26_repair_math", f"WITH {ITEMS} SELECT doc_id, item_id, split_part(text, ' ', 1) || ' the ' || ({_CUES})[(doc_id + block_idx) % 6 + 1] || CASE WHEN (doc_id + block_idx) % 6 IN (0, 2, 3, 5) THEN ' \\theta' ELSE '  ' END || ' and ' || text AS repaired FROM items")
def repair_math(t):
    """A control character behind an angle is the letter theta, any other is a space."""
    lost = cycle(["\u0008", "\u0001", "\u001f"], F.col("block_idx"))
    raw = F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" the "), cycle(_CUES, F.col("doc_id") + F.col("block_idx")), F.lit(" "), lost, F.lit(" and "), F.col("text"))
    theta = F.regexp_replace(raw, r"(?<=\b(?:fixing|rotation angle|torsion angle|dihedral angle|angle|angles|function of)\s{1,3})[\x01-\x08\x0b\x0c\x0e-\x1f]", r"\\theta")
    return items(t.documents).select("doc_id", "item_id", F.regexp_replace(theta, r"[\x01-\x08\x0b\x0c\x0e-\x1f]", " ").alias("repaired"))


def _fit_case(t):
    """Tagged items with the box and size that they are to be fitted with."""
    formulas = F.transform(Z.formula_map(F.col("protected_map")), lambda e: F.struct(e["placeholder"].alias("placeholder"), e["formula_text"].alias("formula_text")))
    d = tagged(t, "x0", "x1", "y0", "y1")
    return d.withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0"), "formulas": formulas, "size": F.lit(9.0) + (F.col("doc_id") % 4), "leading": F.lit(0.2)})


@query("m05_fitted_size")
def fitted_size(t):
    d = _fit_case(t)
    got = T.solve("w", "h", "text", "formulas", "leading", F.lit(6.0), F.lit(14.0))
    return d.select("doc_id", "item_id", got.alias("g")).select("doc_id", "item_id", "g.size", "g.lines", "g.overflow")


def _pull(x: str, slope: str) -> str:
    return f"greatest(0.0, least(1.0, (1.0 / (1.0 + exp(-{slope} * ({x}))) - 0.5) * 2.0))"


_PLAN = f"""{BLOCKS}, c AS (SELECT doc_id, item_id, CAST(y1 - y0 AS DOUBLE) AS h, doc_id % 3 AS n, CAST(9.0004 AS DOUBLE) + doc_id % 4 AS size, CAST(block_idx % 5 AS DOUBLE) / 8 AS ratio, CAST(ceil(length(text) / 20.0) * 12 AS DOUBLE) AS tall, CAST(greatest(1, length(regexp_replace(text, '\\s+', '', 'g'))) AS DOUBLE) AS chars FROM blocks),
f AS (SELECT *, CASE WHEN n > 0 THEN round_even(least(1.0, n / (n + chars / 12.0)), 3) ELSE 0.0 END AS share, CASE WHEN n > 0 THEN round_even(least(1.0, n * CAST(0.16 AS DOUBLE) + n * CAST(0.025 AS DOUBLE)), 3) ELSE 0.0 END AS cx FROM c),
w AS (SELECT *, greatest(0.22, exp(-1.35 * (ratio * 0.65 + share * 0.55 + n * 0.26 + cx * 0.45))) AS trust, tall * (1.0 - 0.18 * {_pull('ratio * 0.42 + share * 0.38 + n * 0.05', '3.0')}) / greatest(h, 1.0) AS fill FROM f),
g AS (SELECT *, round_even(0.2 * {_pull('(0.86 - fill) / 0.86', '5.0')} * trust, 3) AS growth, round_even(CASE WHEN ratio <= 0.15 THEN 0.6 WHEN ratio <= 0.35 THEN 0.4 ELSE 0.2 END * {_pull('fill - 0.86', '4.2')} * trust * trust, 3) AS shrink FROM w),
z AS (SELECT *, round_even(greatest(7.8, least(round_even(size + growth - shrink, 2), size + 0.2)), 2) AS new FROM g)"""


@query("m12_fit_plan", f"WITH {_PLAN} SELECT doc_id, item_id, new AS size, CASE WHEN abs(new - size) >= 0.005 THEN 'continuous_fit' ELSE 'fast_estimate' END AS mode, concat_ws(',', CASE WHEN growth > 0 THEN 'underfilled_body' END, CASE WHEN shrink > 0 THEN 'height_pressure' END, CASE WHEN ratio > 0 THEN 'formula_weighted' END, CASE WHEN cx > 0 THEN 'formula_complexity' END, CASE WHEN n > 0 THEN 'formula_count_weighted' END) AS reasons FROM z")
def fit_plan(t):
    """A change of size and the codes of what it rests on; the estimate is a formula here, so that SQL can follow."""
    d, b = F.col("doc_id"), F.col("block_idx")
    entry = F.struct(F.lit("p").alias("placeholder"), F.lit(r"\frac{a}{b}_2").alias("formula_text"))
    formulas = F.array_repeat(entry, (d % 3).cast("int"))
    estimated = F.struct((F.ceil(F.length("text") / 20.0) * 12).cast("double").alias("height"), ((b % 5).cast("double") / 8).alias("formula_ratio"))
    size = F.lit(9.0004) + d % 4  # no sum lies halfway between two hundredths
    p = T.plan((F.col("y1") - F.col("y0")).cast("double"), F.col("text"), formulas, size, estimated, size + 0.2)
    return blocks(t.documents).select("doc_id", "item_id", p.alias("p")).select("doc_id", "item_id", "p.size", "p.mode", F.concat_ws(",", "p.reasons").alias("reasons"))


def replay(df: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The rows that are asked for, by an equality join on their key."""
    return df.join(wanted.select(*key).distinct(), key, "left_semi")


@query("e05_replay_item", f"WITH {ROLES_SQL} SELECT doc_id, item_id, reason, reason IN ('caption_text', 'semantic_role=abstract', 'main_text') AS translates FROM roles WHERE block_idx = doc_id % 9")
def replay_items(t):
    """One item of every document looked up by its id and put through the policies again."""
    from quillon.functions.roles import translates

    d = t.documents.select("doc_id", (F.col("doc_id") % 9).alias("b"))
    wanted = d.select("doc_id", F.format_string("p%03d-b%03d", F.expr("b div 8"), F.col("b")).alias("item_id"))
    return replay(roled(t.documents), wanted, ["doc_id", "item_id"]).select("doc_id", "item_id", "reason", translates(F.col("reason")).alias("translates"))


_CUT = "CASE WHEN length(x) <= 260 THEN x ELSE rtrim(left(x, 259)) || '…' END"


@query(
    "p15_item_diagnostics",
    f"WITH {ITEMS}, m AS (SELECT *, CASE block_idx % 4 WHEN 0 THEN {norm('text')} WHEN 1 THEN 'kept' ELSE 'from trace' END AS x FROM items) SELECT doc_id, item_id, CASE WHEN block_idx % 3 = 0 THEN 'own' ELSE item_id END AS diagnosed_id, CASE WHEN block_idx % 5 = 0 THEN 'family' ELSE 'translation' END AS provider, 'placeholder' AS prompt_mode, {_CUT} AS raw_excerpt FROM m",
)
def item_diagnostics(t):
    """Diagnostics with their gaps filled; every payload lacks something else."""
    b = F.col("block_idx")
    none = F.lit(None).cast("string")
    step = lambda c: F.struct(none.alias("raw_excerpt"), F.lit("").alias("raw_output"), c.alias("message"))
    payload = F.struct(
        F.when(b % 3 == 0, "own").alias("item_id"), none.cast("bigint").alias("page_idx"), none.alias("provider"), F.when(b % 5 == 0, "family").alias("provider_family"), none.alias("prompt_mode"), none.alias("request_label"),
        F.when(b % 4 == 1, "kept").alias("raw_excerpt"), F.when(b % 4 == 0, F.col("text")).alias("raw_output"), F.lit("").alias("raw_response"), F.array(step(F.lit("")), step(F.lit("from trace")), step(F.lit("later"))).alias("error_trace"),
    )
    d = M.item_diagnostics(payload, F.col("item_id"), F.col("page_idx"), F.lit("placeholder"))
    return items(t.documents).select("doc_id", "item_id", d.alias("d")).select("doc_id", "item_id", F.col("d.item_id").alias("diagnosed_id"), "d.provider", "d.prompt_mode", "d.raw_excerpt")


@query("a26_normalization_view", "SELECT doc_id, lang AS provider, doc_id % 2 = 0 AS provider_was_explicit, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS blocks_seen, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS page_defaults, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'v1' END AS \"schema\" FROM documents")
def normalization_view(t):
    """Reports with and without their outer object, defaults and validation."""
    d, n = F.col("doc_id"), F.col("n_chars").cast("bigint")
    defaults = F.when(d % 3 != 0, F.struct(F.lit(1).cast("bigint").alias("pages_seen"), n.alias("blocks_seen"), F.create_map(F.lit("unit"), n, F.lit("width"), n).alias("page_defaults")))
    inner = F.struct(F.col("lang").alias("provider"), (d % 2 == 0).alias("provider_was_explicit"), defaults.alias("defaults"), F.when(d % 5 != 0, F.struct(F.lit("v1").alias("schema"))).alias("validation"))
    report = F.when(d % 2 == 0, F.to_json(F.struct(inner.alias("normalization")))).otherwise(F.to_json(inner))
    return t.documents.select("doc_id", M.normalization_view(report).alias("v")).select("doc_id", "v.provider", "v.provider_was_explicit", "v.blocks_seen", F.col("v.page_defaults").cast("long").alias("page_defaults"), "v.schema")


@query("a28_run_report", f"WITH {BLOCKS} SELECT count(DISTINCT doc_id || '/' || page_idx) AS pages_processed, count(*) FILTER (final_status = 'translated') AS translated_items_total, max(latency_ms) AS slowest, count(*) FILTER (len(error_types) > 0) AS failed_requests, 'book' AS mode FROM blocks")
def run_report(t):
    """A run's figures written as one JSON document and read again."""
    b = blocks(t.documents)
    metrics = b.agg(F.count_distinct("doc_id", "page_idx").alias("pages_processed"), F.count_if(F.col("final_status") == "translated").alias("translated_items_total"), F.lit("book").alias("mode"))
    requests = b.agg(F.max("latency_ms").alias("slowest"), F.count_if(F.size("error_types") > 0).alias("failed_requests"))
    doc = sinks.run_report(metrics, {"requests": requests})
    got = F.from_json("value", "pages_processed bigint, translated_items_total bigint, mode string, requests struct<slowest:bigint,failed_requests:bigint>")
    return doc.select(got.alias("d")).select("d.pages_processed", "d.translated_items_total", "d.requests.slowest", "d.requests.failed_requests", "d.mode")


@query("m01_job_ids", "SELECT o_orderkey, strftime(CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400), '%Y%m%d%H%M%S') AS prefix, strftime(CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400), '%Y-%m-%dT%H:%M:%SZ') AS made, 6 AS digits FROM orders")
def job_ids(t):
    """Ids of jobs made at given times: a second in UTC and six random hex digits."""
    at = F.timestamp_add("SECOND", F.col("o_orderkey") % 86400, F.col("o_orderdate").cast("timestamp"))
    made = t.orders.select("o_orderkey", M.job_id(at).alias("id"), M.iso_seconds(at).alias("made"))
    return made.select("o_orderkey", F.split_part("id", F.lit("-"), F.lit(1)).alias("prefix"), "made", F.length(F.regexp_extract("id", "-([0-9a-f]{6})$", 1)).cast("int").alias("digits"))
