"""Queries of the remaining rows: guards, reviews, summaries, neighbours, nested arrays, fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import more as M
from quillon.functions import text as X
from quillon.operators import sets as U
from quillon.plans.items import BLOCKS, ITEMS, blocks, items
from quillon.plans.join_queries import _DEDUP, _G, unique_glossary
from quillon.plans.registry import query
from quillon.plans.rule_queries import ROLES_SQL, roled
from quillon.plans.text_queries import _ARRAY, _PICK, norm
from quillon.sources import sinks

_BODY = "(semantic_role IN ('body', 'abstract') OR structure_role = 'body' OR layout_role = 'paragraph')"


def _body():
    return F.col("semantic_role").isin("body", "abstract") | (F.col("structure_role") == "body") | (F.col("layout_role") == "paragraph")


@query("f08_eligible", f"WITH {ROLES_SQL}, n AS (SELECT *, replace({norm('text')}, '\\$', '') AS s FROM roles) SELECT doc_id, item_id, {_BODY} AND (length(s) - length(replace(s, '$', ''))) % 2 = 0 AND s <> '' AS eligible FROM n")
def eligible(t):
    c = F.col("text")
    return roled(t.documents).select("doc_id", "item_id", (_body() & (X.dollar_balance(c) % 2 == 0) & (X.normalize_space(c) != "")).alias("eligible"))


_WORDY = "regexp_replace(split_part(text, ' ', 1), '[^A-Za-z]', '', 'g')"


@query(
    "f13_structured",
    f"WITH {ITEMS}, n AS (SELECT doc_id, item_id, {norm("CASE block_idx % 5 WHEN 0 THEN 'Size: ' || block_idx WHEN 1 THEN text WHEN 2 THEN 'A' || " + _WORDY + " || ': 1 - B' || " + _WORDY + " || ': x' WHEN 3 THEN 'Name: ' || text ELSE 'Flag: \"' || replace(split_part(text, ' ', 1), '\"', '') || '\"' END")} AS s FROM items), "
    f"l AS (SELECT *, len(regexp_extract_all(s, '{M.FIELD_LABEL}')) AS n, trim(regexp_extract(s, '^[^:]*:(.*)$', 1)) AS v FROM n) SELECT doc_id, item_id, s <> '' AND length(s) <= 1200 AND (n >= 2 OR (n = 1 AND regexp_matches(v, '{M.LITERAL.replace("'", "''")}'))) AS structured FROM l",
)
def structured(t):
    """Fields of several forms around the items' own words."""
    i, word = F.col("block_idx") % 5, F.split_part("text", F.lit(" "), F.lit(1))
    plain = F.regexp_replace(word, "[^A-Za-z]", "")
    s = F.when(i == 0, F.concat(F.lit("Size: "), F.col("block_idx").cast("string"))).when(i == 1, F.col("text")).when(i == 2, F.concat(F.lit("A"), plain, F.lit(": 1 - B"), plain, F.lit(": x")))
    s = s.when(i == 3, F.concat(F.lit("Name: "), F.col("text"))).otherwise(F.concat(F.lit('Flag: "'), F.replace(word, F.lit('"'), F.lit("")), F.lit('"')))
    return items(t.documents).select("doc_id", "item_id", M.structured_block(s).alias("structured"))


@query("f27_deletable", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'P') OR o_orderkey % 10 = 0")
def deletable(t):
    """Jobs that are not open, or forced."""
    return t.orders.filter(~F.col("o_orderstatus").isin("O", "P") | (F.col("o_orderkey") % 10 == 0)).select("o_orderkey")


@query("f30_refilled_page", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 20")
def refilled_page(t):
    """The filter comes before paging, so pages are full."""
    return U.page(t.orders.filter("o_orderstatus = 'F' and o_orderpriority != ''"), [F.desc("o_orderdate"), "o_orderkey"], 20, 100).select("o_orderkey")


@query("j05_boundary_pairs", f"WITH {BLOCKS}, z AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY doc_id, page_idx, x0) AS n FROM blocks WINDOW w AS (PARTITION BY doc_id, page_idx, x0 ORDER BY y0)) SELECT a.doc_id, a.item_id AS prev_id, b.item_id AS next_id FROM z a JOIN z b ON a.doc_id = b.doc_id AND b.page_idx = a.page_idx + 1 AND a.x0 = b.x0 WHERE a.r = a.n AND b.r = 1 AND a.block_type = 'text' AND b.block_type = 'text'")
def boundary_pairs(t):
    """The last item of a zone with the first of the same zone on the next page."""
    from quillon.operators.windows import zones

    z = zones(blocks(t.documents).filter("1 = 1"), ["doc_id", "page_idx", "x0"], ["y0"])
    tail = z.filter("zone_rank = zone_size - 1 and block_type = 'text'").select("doc_id", (F.col("page_idx") + 1).alias("page_idx"), "x0", F.col("item_id").alias("prev_id"))
    head = z.filter("zone_rank = 0 and block_type = 'text'").select("doc_id", "page_idx", "x0", F.col("item_id").alias("next_id"))
    return tail.join(head, ["doc_id", "page_idx", "x0"]).select("doc_id", "prev_id", "next_id")


@query("j16_child_events", "SELECT c.o_custkey AS job_id, e.event_id, e.event_type AS event FROM events e JOIN (SELECT o_custkey, min(o_orderkey) AS child FROM orders GROUP BY 1) c ON e.event_id = c.child UNION ALL SELECT user_id, event_id, event_type FROM events WHERE event_id % 2 = 0")
def child_events(t):
    """A parent's events and those of its child."""
    c = t.orders.groupBy(F.col("o_custkey").alias("job_id")).agg(F.min("o_orderkey").alias("child"))
    child = t.events.join(c, F.col("event_id") == F.col("child")).select("job_id", "event_id", F.col("event_type").alias("event"))
    return child.unionByName(t.events.filter("event_id % 2 = 0").select(F.col("user_id").alias("job_id"), "event_id", F.col("event_type").alias("event")))


@query("a05_counter_totals", "SELECT user_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS kinds FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def counter_totals(t):
    """Counters as a map and their total."""
    n = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", M.map_total(F.col("m")).alias("total"), F.size("m").cast("long").alias("kinds"))


@query("w10_absorbed_rows", f"WITH {BLOCKS}, l AS (SELECT *, lead(x0) OVER w AS nx, lead(y0) OVER w AS ny0, lead(y1) OVER w AS ny1 FROM blocks WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY block_idx)) SELECT doc_id, item_id, coalesce(nx <> x0 AND least(y1, ny1) - greatest(y0, ny0) >= 0.25 * least(y1 - y0, ny1 - ny0), false) AS absorbed FROM l")
def absorbed_rows(t):
    """The next row stands in the other column at the same height."""
    w = Window.partitionBy("doc_id", "page_idx").orderBy("block_idx")
    nx, n0, n1 = (F.lead(c).over(w) for c in ("x0", "y0", "y1"))
    hit = (nx != F.col("x0")) & (F.least(F.col("y1"), n1) - F.greatest(F.col("y0"), n0) >= 0.25 * F.least(F.col("y1") - F.col("y0"), n1 - n0))
    return blocks(t.documents).select("doc_id", "item_id", F.coalesce(hit, F.lit(False)).alias("absorbed"))


@query("w24_next_in_column", f"WITH {BLOCKS} SELECT doc_id, item_id, lead(item_id) OVER (PARTITION BY doc_id, page_idx, x0 ORDER BY y0) AS next_id FROM blocks")
def next_in_column(t):
    return blocks(t.documents).select("doc_id", "item_id", F.lead("item_id").over(Window.partitionBy("doc_id", "page_idx", "x0").orderBy("y0")).alias("next_id"))


@query("l04_glossary_order", "SELECT p_partkey FROM part ORDER BY p_partkey % 97 DESC, p_partkey LIMIT 50")
def glossary_order(t):
    return t.part.orderBy(F.desc(F.col("p_partkey") % 97), "p_partkey").limit(50).select("p_partkey")


@query("l06_memory_trim", "SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, user_id DESC LIMIT 160")
def memory_trim(t):
    """The 160 terms with most hits."""
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("user_id")).limit(160)


_LOGS = ["Failed to resolve host", "request timed out", "HTTP rate limit", "401 unauthorized", "placeholder inventory mismatch", "typst error: x", "JSONDecodeError: x", "source PDF not found", "something else"]


def _failure_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(log), '{p}')" + (" OR status = 429" if n == "upstream_rate_limited" else " OR status IN (401, 403)" if n == "auth_failed" else "") + f" THEN '{n}'" + (" WHEN status = 400 THEN 'upstream_bad_request'" if n == "auth_failed" else "") for n, p in M.FAILURES) + " ELSE 'python_unhandled_exception' END"


@query("c21_failures", f"WITH e AS (SELECT event_id, ({_ARRAY(_LOGS)})[event_id % 9 + 1] AS log, CASE event_id % 17 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 400 END AS status FROM events) SELECT event_id, {_failure_sql()} AS failure FROM e")
def failures(t):
    i = F.col("event_id")
    return t.events.select("event_id", M.failure(_PICK(_LOGS, i), F.when(i % 17 == 0, 429).when(i % 17 == 1, 403).when(i % 17 == 2, 400)).alias("failure"))


@query("c28_result_union", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN event_type ELSE 'text' END AS decision, CASE event_id % 3 WHEN 0 THEN event_type || ' ' || user_id WHEN 1 THEN '' ELSE user_id || ':' || event_id END AS output FROM events")
def result_union(t):
    """A result is a text, or an object with a decision, a text or both."""
    i, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    text = F.when(i == 0, F.concat_ws(" ", "event_type", user)).when(i == 1, F.to_json(F.struct(F.col("event_type").alias("decision")))).otherwise(F.to_json(F.struct(F.concat_ws(":", user, "event_id").alias("translated_text"))))
    parsed = F.when(text.startswith("{"), F.from_json(text, "decision string, translated_text string"))
    output = F.when(parsed.isNotNull(), F.coalesce(parsed["translated_text"], F.lit(""))).otherwise(text)
    return t.events.select("event_id", F.coalesce(parsed["decision"], F.lit("text")).alias("decision"), output.alias("output"))


@query("m04_fit", f"WITH {BLOCKS} SELECT doc_id, item_id, round_even(greatest(1, floor(greatest(8.0, y1 - y0) / greatest(10 * 1.02, 10 * (1.0 + 0.2)))) * greatest(4.0, greatest(8.0, x1 - x0) / greatest(10 * 0.92, 1.0)) * 0.98, 6) AS capacity, CAST(greatest(1, ceil(length(text) / greatest(greatest(4.0, greatest(8.0, x1 - x0) / 9.2) * 0.98, 1.0))) AS BIGINT) AS lines FROM blocks")
def fit(t):
    e, font = [F.col(c) for c in ("x0", "y0", "x1", "y1")], F.lit(10.0)
    return blocks(t.documents).select("doc_id", "item_id", F.bround(M.box_capacity(*e, font, F.lit(0.2)), 6).alias("capacity"), M.required_lines(e[0], e[2], F.length("text"), font).cast("long").alias("lines"))


_COVERED = "greatest(0, least(x1, {0}) - greatest(x0, {1})) * greatest(0, least(y1, {2}) - greatest(y0, {3}))"


@query("m07_box_difference", f"WITH {BLOCKS}, h AS (SELECT *, x0 + 60 * (block_idx % 6) - 80 AS hx, x0 + 50 * (doc_id % 5) - 30 AS kx FROM blocks) SELECT doc_id, item_id, (x1 - x0) * (y1 - y0) - {_COVERED.format('hx + 70', 'hx', 'y0 + 9', 'y0 - 5')} - {_COVERED.format('kx + 40', 'kx', 'y1 + 10', 'y1 - 6')} AS outside FROM h")
def box_difference(t):
    """Area of a box outside two holes, which may lie in it, across its edges or beside it."""
    hx, kx = F.col("x0") + 60 * (F.col("block_idx") % 6) - 80, F.col("x0") + 50 * (F.col("doc_id") % 5) - 30
    hole = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    holes = F.array(hole(hx, F.col("y0") - 5, hx + 70, F.col("y0") + 9), hole(kx, F.col("y1") - 6, kx + 40, F.col("y1") + 10))
    pieces = M.subtract_boxes(F.struct("x0", "y0", "x1", "y1"), holes)
    total = F.aggregate(pieces, F.lit(0.0), lambda a, p: a + (p["x1"] - p["x0"]) * (p["y1"] - p["y0"]))
    return blocks(t.documents).select("doc_id", "item_id", total.alias("outside"))


@query("m09_box_gaps", f"WITH {BLOCKS} SELECT doc_id, item_id, x1 - x0 AS width, coalesce(lead(x0) OVER w - x1, 0.0) AS column_gap, coalesce(lead(y0) OVER w - y1, 0.0) AS vertical_gap, coalesce(abs(lead(x0) OVER w - x0) <= 28, false) AS same_column FROM blocks WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY block_idx)")
def box_gaps(t):
    w = Window.partitionBy("doc_id", "page_idx").orderBy("block_idx")
    nx, ny = F.lead("x0").over(w), F.lead("y0").over(w)
    return blocks(t.documents).select("doc_id", "item_id", (F.col("x1") - F.col("x0")).alias("width"), F.coalesce(nx - F.col("x1"), F.lit(0.0)).alias("column_gap"), F.coalesce(ny - F.col("y1"), F.lit(0.0)).alias("vertical_gap"), F.coalesce(F.abs(nx - F.col("x0")) <= 28, F.lit(False)).alias("same_column"))


@query("g02_segments", f"WITH {ITEMS}, s AS (SELECT doc_id, item_id, list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '') AS seg FROM items) SELECT doc_id, item_id, array_to_string(seg, ' + ') AS merged, len(seg) AS n FROM s")
def segments(t):
    """Spans flattened, blanks dropped, texts joined."""
    spans = F.transform(F.split("text", ","), lambda x: F.struct(F.lit("text").alias("type"), F.trim(x).alias("content")))
    seg = F.filter(F.flatten(F.array(spans)), lambda s: s["content"] != "")
    return items(t.documents).select("doc_id", "item_id", F.array_join(F.transform(seg, lambda s: s["content"]), " + ").alias("merged"), F.size(seg).cast("long").alias("n"))


@query("g07_redact_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS name, CASE WHEN event_id % 3 <> 0 THEN '[REDACTED]' END AS token, CASE WHEN event_id % 4 = 1 THEN '[REDACTED]' END AS password FROM events")
def redact_json(t):
    """Secret keys that are there are masked, other keys stay."""
    i = F.col("event_id")
    raw = F.to_json(F.struct(F.from_json("props", "k long")["k"].alias("k"), F.col("event_type").alias("name"), F.when(i % 3 != 0, F.concat("event_type", F.lit("-key"))).alias("token"), F.when(i % 4 == 1, F.col("user_id").cast("string")).alias("password")))
    clean = F.transform_values(F.from_json(raw, "map<string,string>"), lambda k, v: F.when(k.isin("token", "api_key", "password"), F.lit("[REDACTED]")).otherwise(v))
    return t.events.select("event_id", clean["k"].cast("long").alias("k"), clean["name"].alias("name"), clean["token"].alias("token"), clean["password"].alias("password"))


@query("g08_pick_by_id", "WITH e AS (SELECT event_id, event_id % 5 AS n, event_id + event_id % 4 - 1 AS wanted, [event_id - 1, event_id, event_id + 1] AS ids, [event_type || 1, event_type || 2, 'u' || user_id] AS texts FROM events), c AS (SELECT event_id, wanted, ids[1:least(n, 3)] AS ids, texts[1:least(n, 3)] AS texts FROM e) SELECT event_id, CASE WHEN list_contains(ids, wanted) THEN texts[list_position(ids, wanted)] WHEN len(ids) = 1 THEN texts[1] END AS picked FROM c")
def pick_by_id(t):
    """The entry of the id that is asked for, the only entry, or none."""
    i = F.col("event_id")
    entry = lambda n, x: F.struct(n.cast("string").alias("item_id"), x.alias("text"))
    every = F.array(entry(i - 1, F.concat("event_type", F.lit("1"))), entry(i, F.concat("event_type", F.lit("2"))), entry(i + 1, F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    entries = F.slice(every, F.lit(1), F.least(i % 5, F.lit(3)).cast("int"))
    return t.events.select("event_id", M.pick_by_id(entries, (i + i % 4 - 1).cast("string")).alias("picked"))


@query("g09_normal_box", f"WITH {BLOCKS} SELECT doc_id, item_id, CASE WHEN block_idx % 4 = 0 THEN 0.0 WHEN block_idx % 4 = 1 THEN 0.0 ELSE x1 END AS right_edge FROM blocks")
def normal_box(t):
    from quillon.functions.geometry import normal_box as normal

    b = F.col("block_idx")
    box = F.when(b % 4 == 0, F.array("x0", "y0", "x1")).otherwise(F.array(F.col("x0"), F.col("y0"), F.when(b % 4 != 1, F.col("x1")), F.col("y1")))
    return blocks(t.documents).select("doc_id", "item_id", F.get(normal(box), F.lit(2)).alias("right_edge"))


@query("x07_page_features", f"WITH {BLOCKS} SELECT doc_id, page_idx, count(*) AS n_items, count(*) FILTER (block_type = 'table') AS n_tables, CAST(sum(length(text)) AS BIGINT) AS chars, max(y1) AS bottom FROM blocks GROUP BY doc_id, page_idx")
def page_features(t):
    """A registry of named page collectors, all in one aggregation."""
    collectors = {"n_items": F.count(F.lit(1)), "n_tables": F.count_if(F.col("block_type") == "table"), "chars": F.sum(F.length("text")), "bottom": F.max("y1")}
    return blocks(t.documents).groupBy("doc_id", "page_idx").agg(*[c.alias(n) for n, c in collectors.items()])


@query("k13_retention", "SELECT o_orderkey AS name FROM orders WHERE o_orderkey % 6 <> 0")
def retention(t):
    files = t.orders.select(F.col("o_orderkey").alias("name"))
    return sinks.to_delete(files, files.filter("name % 6 = 0"))


@query("u09_valid_ids", f"WITH {_G}, {_DEDUP} SELECT key FROM d WHERE position % 2 = 0 INTERSECT SELECT key FROM d WHERE position % 3 = 0")
def valid_ids(t):
    d = unique_glossary(t)
    return d.filter("position % 2 = 0").select("key").intersect(d.filter("position % 3 = 0").select("key"))
