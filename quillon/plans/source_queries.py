"""Queries of sources (S), sinks (K), page tools (D) and streams (T)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillon.operators import sets as U
from quillon.operators import windows as W
from quillon.plans.items import BLOCKS, ITEMS, blocks, cycle, items
from quillon.plans.registry import query
from quillon.sources import documents as D
from quillon.sources import files, sinks
from quillon.sources.shared import shared_folder, track
from quillon.streaming import events as E


def raw_documents(t):
    """Every document as JSON in one of four raw formats, by its id."""
    b = blocks(t.documents).groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(F.struct("block_idx", "block_type", "sub_type", "derived_role", "x0", "y0", "x1", "y1", F.col("text").alias("s")))).alias("b"))
    box = lambda x: F.array(x["x0"], x["y0"], x["x1"], x["y1"])
    p = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", "b"))).alias("p"))
    flat = lambda x: F.struct(x["block_type"].alias("type"), x["sub_type"].alias("sub_type"), F.struct(x["derived_role"].alias("role")).alias("derived"), box(x).alias("bbox"), x["s"].alias("text"))
    generic = F.to_json(F.struct(F.lit("flat").alias("provider"), F.transform("p", lambda g: F.struct(F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.transform(g["b"], flat).alias("blocks"))).alias("pages")))
    cut = lambda x: F.floor(F.length(x["s"]) / 2).cast("int")
    segment = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    halves = lambda x: F.array(segment(F.substr(x["s"], F.lit(1), cut(x))), segment(F.substr(x["s"], cut(x) + 1)))
    lists = F.to_json(F.transform("p", lambda g: F.transform(g["b"], lambda x: F.struct(x["block_type"].alias("type"), box(x).alias("bbox"), halves(x).alias("content")))))
    span = lambda c: F.struct(F.lit("text").alias("type"), c.alias("content"))
    para = lambda x: F.struct(x["block_type"].alias("type"), box(x).alias("bbox"), F.array(F.struct(F.array(span(x["s"]), span(F.lit("and"))).alias("spans")), F.struct(F.array(span(F.lit("more"))).alias("spans"))).alias("lines"))
    paras = F.to_json(F.struct(F.transform("p", lambda g, i: F.struct(i.cast("long").alias("page_idx"), F.array(F.lit(610.0), F.lit(790.0)).alias("page_size"), F.transform(g["b"], para).alias("para_blocks"))).alias("pdf_info")))
    layout = F.to_json(F.struct(F.transform("p", lambda g: F.struct(F.struct(F.lit(620.0).alias("width"), F.lit(780.0).alias("height"), F.transform(g["b"], lambda x: F.struct(x["block_type"].alias("block_label"), x["s"].alias("block_content"), box(x).alias("block_bbox"))).alias("parsing_res_list")).alias("prunedResult"))).alias("layoutParsingResults")))
    kind = F.col("doc_id") % 4
    return p.select(F.col("doc_id").cast("string").alias("document_id"), F.when(kind == 0, generic).when(kind == 1, lists).when(kind == 2, paras).otherwise(layout).alias("raw"))


@query("s03_detect_format", "SELECT CAST(doc_id AS VARCHAR) AS document_id, (['generic_flat_ocr', 'content_list_v2', 'para_blocks', 'layout_parsing'])[doc_id % 4 + 1] AS provider FROM documents WHERE regexp_matches(text, '[^ \\n]')")
def detect_format(t):
    return raw_documents(t).select("document_id", D.default_adapters().detect(F.col("raw")).alias("provider"))


_RANKED = "r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_idx) - 1 AS p, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY block_idx) - 1 AS o, coalesce(nullif(derived_role, ''), nullif(sub_type, ''), 'body') AS explicit, max(x1) OVER (PARTITION BY doc_id, page_idx) AS far_x, max(y1) OVER (PARTITION BY doc_id, page_idx) AS far_y FROM blocks)"


@query(
    "s04_normalize_raw",
    f"""WITH {BLOCKS}, {_RANKED}, z AS (SELECT *, lag(explicit) OVER w AS before, lead(explicit) OVER w AS after FROM r WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY block_idx))
SELECT CAST(doc_id AS VARCHAR) AS document_id, p AS page_index, o AS block_order, block_type AS type, text || CASE WHEN doc_id % 4 = 2 THEN ' and' || chr(10) || 'more' ELSE '' END AS text, x1 AS right_edge,
 CASE doc_id % 4 WHEN 0 THEN 600.0 WHEN 1 THEN far_x WHEN 2 THEN 610.0 ELSE 620.0 END AS page_width, CASE doc_id % 4 WHEN 0 THEN 800.0 WHEN 1 THEN far_y WHEN 2 THEN 790.0 ELSE 780.0 END AS page_height,
 CASE WHEN doc_id % 4 <> 0 THEN '' WHEN block_type = 'text' AND coalesce(nullif(sub_type, ''), 'body') = 'body' AND before = 'title' AND after IN ('abstract', 'heading') THEN 'metadata' ELSE sub_type END AS sub_type FROM z""",
)
def normalize_raw(t):
    """Raw JSON of all formats to one block table."""
    flat = D.default_adapters().normalize(raw_documents(t))
    return flat.select("document_id", "page_index", "block_order", "type", "text", F.get("bbox", F.lit(2)).alias("right_edge"), "page_width", "page_height", "sub_type")


_LABELS = ["text", "text", "paragraph_title", "text", "footnote", "image", "text"]


def layout_blocks(t):
    """Blocks with layout labels, some without text and one in eleven without a box."""
    b, d = F.col("block_idx"), F.col("doc_id")
    box = F.when((d + b) % 11 != 0, F.array("x0", "y0", "x1", "y1"))
    return blocks(t.documents).select(d.cast("string").alias("document_id"), F.col("page_idx").alias("page_index"), F.when(d % 9 == 0, 0.0).otherwise(600.0).alias("page_width"), b.alias("block_order"), cycle(_LABELS, d + b).alias("type"), box.alias("bbox"), F.when((d + 3 * b) % 5 == 0, " ").otherwise(F.col("text")).alias("text"))


_SIGNALS = f"""{BLOCKS}, v AS (SELECT doc_id, page_idx, block_idx, CASE WHEN doc_id % 9 = 0 THEN 0.0 ELSE 600.0 END AS w, ([{", ".join(f"'{x}'" for x in _LABELS)}])[(doc_id + block_idx) % 7 + 1] AS label, (doc_id + block_idx) % 11 <> 0 AS valid, x0, y0, x1, y1, CASE WHEN (doc_id + 3 * block_idx) % 5 = 0 THEN '' ELSE trim(text) END AS s FROM blocks),
c AS (SELECT *, CASE WHEN NOT valid OR w <= 0 THEN 'unknown' WHEN x1 - x0 >= 0.62 * w THEN 'full' WHEN (x0 + x1) / 2 <= w / 2 THEN 'left' ELSE 'right' END AS col, valid AND length(s) < 2 AS hollow, coalesce(valid AND label IN ('text', 'paragraph_title', 'footnote') AND (x1 - x0) / nullif(w, 0) BETWEEN 0.18 AND 0.48, false) AS sized, label = 'footnote' AS side FROM v),
m AS (SELECT doc_id, page_idx, any_value(w) AS pw, count(*) FILTER (sized AND col = 'left') AS sl, count(*) FILTER (sized AND col = 'right') AS sr, count(*) FILTER (sized AND col = 'left' AND s <> '') AS tl, count(*) FILTER (sized AND col = 'right' AND s <> '') AS tr, bool_or(hollow AND col IN ('left', 'right')) AS any_hollow,
 median((x0 + x1) / 2) FILTER (sized AND col = 'left' AND s <> '') AS ml, median((x0 + x1) / 2) FILTER (sized AND col = 'right' AND s <> '') AS mr FROM c GROUP BY ALL),
k AS (SELECT *, pw > 0 AND ((tl >= 2 AND tr >= 2) OR (sl >= 2 AND sr >= 2) OR (sl >= 1 AND sr >= 1 AND any_hollow)) AS double FROM m),
j AS (SELECT c.*, double, CASE WHEN pw <= 0 THEN 'unknown' WHEN double THEN 'double' ELSE 'single' END AS mode, round_even(CASE WHEN double THEN coalesce((ml + mr) / 2, pw / 2) WHEN pw > 0 THEN pw / 2 ELSE 0 END, 3) AS split_x, double AND valid AND NOT side AND col IN ('left', 'right') AS ok FROM c JOIN k USING (doc_id, page_idx)),
n AS (SELECT *, lag((ok, col, hollow, y0, y1)) OVER o AS b, lead((ok, col, hollow, y0, y1)) OVER o AS a FROM (SELECT *, row(ok, col, hollow, y0, y1) AS me FROM j) WINDOW o AS (PARTITION BY doc_id, page_idx ORDER BY block_idx)),
signals AS (SELECT *, before OR after AS suspected, (before OR after) AND hollow AS text_missing, (before OR after) AND NOT hollow AS absorbed, CASE WHEN after THEN block_idx + 1 WHEN before THEN block_idx - 1 END AS peer FROM (SELECT *,
 coalesce(ok AND b[1] AND b[2] <> col AND b[3] <> hollow AND least(y1, b[5]) - greatest(y0, b[4]) >= 0.25 * least(greatest(1, y1 - y0), greatest(1, b[5] - b[4])), false) AS before,
 coalesce(ok AND a[1] AND a[2] <> col AND a[3] <> hollow AND least(y1, a[5]) - greatest(y0, a[4]) >= 0.25 * least(greatest(1, y1 - y0), greatest(1, a[5] - a[4])), false) AS after FROM n))"""


@query("s08_column_signals", f"WITH {_SIGNALS} SELECT CAST(doc_id AS VARCHAR) AS document_id, page_idx AS page_index, block_idx AS block_order, col AS column, mode, split_x, suspected, text_missing, absorbed, peer AS peer_order FROM signals".replace("AS column", 'AS "column"'))
def column_signals(t):
    return D.column_signals(layout_blocks(t)).select("document_id", "page_index", "block_order", "column", "mode", "split_x", "suspected", "text_missing", "absorbed", "peer_order")


@query("a04_signal_summary", f"WITH {_SIGNALS}, p AS (SELECT doc_id, page_idx, any_value(mode) AS mode, count(*) FILTER (suspected) AS s, count(*) FILTER (text_missing) AS m, count(*) FILTER (absorbed) AS b FROM signals GROUP BY ALL) SELECT CAST(doc_id AS VARCHAR) AS document_id, count(*) FILTER (s > 0) AS suspicious_pages, CAST(sum(s) AS BIGINT) AS suspicious_blocks, string_agg(concat_ws('/', page_idx, mode, s, m, b), ',' ORDER BY page_idx) AS pages FROM p GROUP BY doc_id")
def signal_summary(t):
    pages = F.array_join(F.transform("pages", lambda p: F.concat_ws("/", p["page_index"], p["mode"], p["suspected"], p["missing"], p["absorbed"])), ",")
    return D.signal_summary(D.column_signals(layout_blocks(t))).withColumn("pages", pages)


def block_trees(t):
    """Each page's lines as trees: every third is a top block, the next its child, the one after that child's child."""
    i = items(t.documents).select("doc_id", "page_idx", "block_idx", "text", F.expr("block_idx div 3").alias("top"), (F.col("block_idx") % 3).alias("level"))
    block = lambda level, below: F.struct(F.max(F.when(F.col("level") == level, F.col("text"))).alias("text"), F.when(F.max(F.col("level") >= level + 1), F.array(below)).alias("children")) if below is not None else F.struct(F.max(F.when(F.col("level") == level, F.col("text"))).alias("text"))
    kind = F.when(F.col("top") % 4 == 0, "algorithm").otherwise("body")
    tree = block(0, block(1, block(2, None)))
    tops = i.groupBy("doc_id", "page_idx", "top").agg(tree.alias("b")).withColumn("b", F.struct(kind.alias("sub_type"), F.col("b.text").alias("text"), F.col("b.children").alias("children")))
    pages = tops.groupBy("doc_id", "page_idx").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("top", "b"))), lambda x: x["b"])).alias("blocks"))
    return pages.select(F.col("doc_id").cast("string").alias("document_id"), F.col("page_idx").alias("page_index"), "blocks")


@query(
    "p10_block_tree",
    f"WITH {ITEMS}, l AS (SELECT *, block_idx // 3 AS top, block_idx % 3 AS level FROM items), k AS (SELECT doc_id, page_idx, top, max(level) AS deepest FROM l GROUP BY doc_id, page_idx, top), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY top) - 1 AS b FROM k), r AS (SELECT *, unnest(range(deepest + 1)) AS depth FROM g) "
    "SELECT CAST(r.doc_id AS VARCHAR) AS document_id, printf('p%03d-b%03d', r.page_idx + 1, b) || repeat('-i000', depth) AS item_id, r.top % 4 = 0 AS inside, depth, coalesce(text, '') AS text FROM r LEFT JOIN l ON l.doc_id = r.doc_id AND l.page_idx = r.page_idx AND l.top = r.top AND l.level = r.depth",
)
def block_tree(t):
    flat = D.tree_items(block_trees(t), inherits=F.get_json_object("block", "$.sub_type") == "algorithm")
    return flat.select("document_id", "item_id", "inside", F.col("depth").cast("long").alias("depth"), F.coalesce(F.get_json_object("block", "$.text"), F.lit("")).alias("text"))


def normalized(t):
    """Documents in the normalized schema, as structs."""
    b = blocks(t.documents).groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list(F.struct("block_idx", "block_type", "sub_type", "text"))).alias("b"))
    page = lambda g, i: F.struct((i + F.when(F.col("doc_id") % 50 == 0, 1).otherwise(0)).cast("long").alias("page_index"), F.transform(g["b"], lambda x: F.struct(x["block_type"].alias("type"), x["sub_type"].alias("sub_type"), x["text"].alias("text"))).alias("blocks"))
    p = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", "b"))).alias("p"))
    js = F.to_json(F.struct(F.lit(D.SCHEMA_NAME).alias("schema"), F.col("doc_id").cast("string").alias("document_id"), (F.size("p") + (F.col("doc_id") % 40 == 1).cast("int")).cast("long").alias("page_count"), F.transform("p", page).alias("pages")))
    return p.select(F.from_json(js, D.DOCUMENT).alias("d")).select("d.*")


@query("s02_unnest_blocks", f"WITH {ITEMS} SELECT CAST(doc_id AS VARCHAR) AS document_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_idx) - 1 AS page_index, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY block_idx) - 1 AS block_order, text FROM items")
def unnest_blocks(t):
    return D.flatten(normalized(t)).select("document_id", "page_index", "block_order", "text")


@query("f20_document_problems", f"WITH {ITEMS}, p AS (SELECT DISTINCT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_idx) - 1 AS i FROM items) SELECT CAST(doc_id AS VARCHAR) AS document_id, 'pages[' || i || '].page_index: not its position' AS problem FROM p WHERE doc_id % 50 = 0 UNION ALL SELECT DISTINCT CAST(doc_id AS VARCHAR), 'page_count: differs from pages' FROM items WHERE doc_id % 40 = 1")
def document_problems(t):
    return D.problems(normalized(t))


@query("s09_json_lines", "SELECT user_id, count(*) AS lines, string_agg(event_id, ',' ORDER BY event_id) AS results FROM events GROUP BY user_id")
def json_lines(t):
    e = t.events
    js = F.to_json(F.struct(F.struct(F.array(F.col("event_id").cast("string")).alias("layoutParsingResults")).alias("result")))
    return files.json_lines_results(e.select("user_id", "event_id", js.alias("line")), "line", "user_id", "event_id").select("user_id", "lines", F.array_join("results", ",").alias("results"))


@query("s14_glossary_json", "SELECT item_id, split_part(text, ' ', 1) AS source, CASE WHEN item_id % 2 = 0 THEN split_part(text, ' ', 1) ELSE 'x' END AS target FROM benchmark")
def glossary_json(t):
    entry = F.struct(F.split_part("text", F.lit(" "), F.lit(1)).alias("source"), F.when(F.col("item_id") % 2 == 0, "").otherwise("x").alias("target"), F.when(F.col("item_id") % 2 == 0, "keep").otherwise("").alias("level"), F.col("item_id").cast("string").alias("note"))
    g = files.glossary_json(t.benchmark.select(F.to_json(F.array(entry)).alias("j")), "j")
    return g.select(F.col("note").cast("long").alias("item_id"), "source", "target")


@query("s15_point_lookup", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_lookup(t):
    return t.orders.filter("o_orderkey = 77").select("o_orderkey", "o_orderstatus", "o_totalprice").limit(1)


@query("s16_artifact_entries", "SELECT l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 100")
def artifact_entries(t):
    return t.lineitem.filter("l_orderkey = 100").orderBy("l_linenumber").select("l_linenumber", "l_partkey")


@query("s17_running_jobs", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P'")
def running_jobs(t):
    return t.orders.filter("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")


@query("s20_head_text", f"WITH {ITEMS} SELECT doc_id, string_agg(text, chr(10) ORDER BY block_idx) AS head FROM items WHERE page_idx < 1 GROUP BY doc_id")
def head_text(t):
    head = items(t.documents).filter("page_idx < 1").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "text"))).alias("m"))
    return head.select("doc_id", F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("head"))


@query("k03_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS version FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 3 <> 0")
def upsert(t):
    old = t.customer.filter("c_custkey % 3 != 0").select("c_custkey", F.lit("old").alias("version"))
    return sinks.merged(old, t.customer.filter("c_custkey % 4 = 0").select("c_custkey", F.lit("new").alias("version")), ["c_custkey"])


@query("k04_append_seq", "WITH o AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT e.user_id, event_id, coalesce(n, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) AS seq FROM events e LEFT JOIN o USING (user_id) WHERE event_id % 2 = 1")
def append_seq(t):
    e = t.events.select("user_id", "event_id")
    none = e.limit(0).withColumn("seq", F.lit(0).cast("long"))
    old = sinks.numbered(none, e.filter("event_id % 2 = 0"), "user_id", ["event_id"])
    return sinks.numbered(old.select("user_id", "seq"), e.filter("event_id % 2 = 1"), "user_id", ["event_id"]).select("user_id", "event_id", "seq")


@query("k10_delete", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def delete(t):
    return sinks.without(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer.filter("c_custkey % 3 = 0"), ["c_custkey"]).select("o_orderkey")


@query("k11_bulk_replace", "SELECT o_orderkey, replace(o_orderpriority, 'URGENT', 'HIGH') AS priority FROM orders")
def bulk_replace(t):
    return sinks.replaced(t.orders.select("o_orderkey", F.col("o_orderpriority").alias("priority")), "priority", "URGENT", "HIGH")


@query("k12_recover_stale", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'failed' ELSE o_orderstatus END AS status FROM orders")
def recover_stale(t):
    stale = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 5 == 0)
    return t.orders.select("o_orderkey", F.when(stale, "failed").otherwise(F.col("o_orderstatus")).alias("status"))


@query("d01_concatenate", f"WITH {ITEMS}, p AS (SELECT DISTINCT source, doc_id, page_idx FROM items) SELECT source, doc_id, page_idx, row_number() OVER (PARTITION BY source ORDER BY doc_id, page_idx) AS page_number FROM p")
def concatenate(t):
    """Pages of all documents of a source as one book; a source may be large, so its pages are numbered in runs of documents."""
    p = items(t.documents).select("source", "doc_id", "page_idx").distinct()
    return W.numbered(p, ["source"], F.expr("doc_id div 1000"), ["doc_id", "page_idx"], "page_number")


@query("d02_split_ranges", f"WITH {ITEMS}, p AS (SELECT DISTINCT doc_id, page_idx + 1 AS page FROM items) SELECT doc_id, page, 'part-' || k AS part FROM p JOIN (VALUES (1, 1, 2), (2, 3, 99)) AS r(k, lo, hi) ON page BETWEEN lo AND hi")
def split_ranges(t):
    p = items(t.documents).select("doc_id", (F.col("page_idx") + 1).alias("page")).distinct()
    ranges = [(1, 1, 2), (2, 3, 99)]
    part = F.array_compact(F.array(*[F.when(F.col("page").between(lo, hi), F.lit(f"part-{k}")) for k, lo, hi in ranges]))
    return p.select("doc_id", "page", F.explode(part).alias("part"))


@query("d03_rotate", f"WITH {ITEMS}, p AS (SELECT DISTINCT doc_id, page_idx FROM items) SELECT doc_id, page_idx, CASE WHEN page_idx % 2 = 0 THEN ((page_idx * 90 - 270) % 360 + 360) % 360 ELSE (page_idx * 90) % 360 END AS rotation FROM p")
def rotate(t):
    p = items(t.documents).select("doc_id", "page_idx").distinct()
    turned = F.when(F.col("page_idx") % 2 == 0, F.pmod(F.col("page_idx") * 90 - 270, F.lit(360))).otherwise(F.pmod(F.col("page_idx") * 90, F.lit(360)))
    return p.select("doc_id", "page_idx", turned.alias("rotation"))


@query("d05_metadata_update", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE source END AS title, lang FROM documents")
def metadata_update(t):
    old = F.create_map(F.lit("title"), F.col("source"), F.lit("lang"), F.col("lang"))
    m = F.when(F.col("doc_id") % 2 == 0, F.map_from_entries(F.map_entries(F.map_concat(F.map_filter(old, lambda k, v: k != "title"), F.create_map(F.lit("title"), F.lit("new")))))).otherwise(old)
    return t.documents.select("doc_id", m["title"].alias("title"), m["lang"].alias("lang"))


@query("d07_expired", "SELECT event_id FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 20 DAYS")
def expired(t):
    top = t.events.agg(F.max("ts").alias("now"))
    return sinks.expired(t.events.join(F.broadcast(top)), "ts", 20 * 86400, F.col("now")).select("event_id")  # one row


@query("d11_probe_ratio", f"WITH {BLOCKS}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY block_idx) AS r FROM blocks WHERE page_idx < 3) SELECT doc_id, CASE WHEN avg(CASE WHEN block_type = 'text' THEN 1.0 ELSE 0.0 END) >= 0.6 THEN 'overlay' ELSE 'direct' END AS mode FROM s WHERE r <= 24 GROUP BY doc_id")
def probe_ratio(t):
    s = U.top_k(blocks(t.documents).filter("page_idx < 3"), ["doc_id", "page_idx"], ["block_idx"], 24)
    return s.groupBy("doc_id").agg(F.when(F.avg((F.col("block_type") == "text").cast("double")) >= 0.6, "overlay").otherwise("direct").alias("mode"))


def _event_stream(t):
    """The events table as a stream of one file."""
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet*").parquet(t.folder)


def _run(t, stream, mode, keys=()):
    name = f"q{uuid.uuid4().hex}"
    checkpoint = track(f"{shared_folder(t.spark)}/{name}")
    track(f"{checkpoint}-{name}")  # where run_once writes
    return E.run_once(stream, name, mode, checkpoint, keys)


@query("t02_latest_state", "SELECT user_id, arg_max(event_type, (CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 0 END, ts, event_id)) AS stage, count(*) AS n FROM events GROUP BY user_id")
def latest_state(t):
    return _run(t, E.latest_state(_event_stream(t), rank={"purchase": 3, "click": 2}), "complete").select("user_id", "stage", "n")


@query("t03_stream_gauge", "WITH r AS (SELECT event_type, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS d FROM events) SELECT event_type, CAST(sum(d) AS BIGINT) AS running, CAST(greatest(0, max(run)) AS BIGINT) AS peak FROM r GROUP BY event_type")
def stream_gauge(t):
    return _run(t, E.gauge(_event_stream(t)), "update", ("event_type",))


@query("t06_stream_memory", "SELECT event_type AS term, count(*) AS hits, arg_max(value, event_id) AS latest, max(event_id) AS at FROM events GROUP BY event_type".replace("AS at", 'AS "at"'))
def stream_memory(t):
    return _run(t, E.term_memory(_event_stream(t)), "update", ("term",))


@query("t08_log_lines", "SELECT event_id, event_type AS stage, event_id % 7 AS current, CAST(7 AS BIGINT) AS total FROM events")
def log_lines(t):
    lines = t.events.select("event_id", F.format_string("[%s] item %d/%d", "event_type", F.col("event_id") % 7, F.lit(7)).alias("value"))
    return E.parse_log(lines).select("event_id", "stage", "current", "total")
