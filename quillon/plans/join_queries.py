"""Queries of joins (J) and box operators (M) over items, pages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import geometry as G
from quillon.functions import text as X
from quillon.operators import joins as J
from quillon.plans.items import BLOCKS, ITEMS, blocks, items
from quillon.plans.registry import query
from quillon.plans.text_queries import _ARRAY, _LEVEL_NAMES, glossary, listed
from quillon.functions import catalog as K


@query("j01_jobs_artifacts", "SELECT c_custkey, count(o_orderkey) AS orders, coalesce(max(o_orderkey), -1) AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def jobs_artifacts(t):
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderkey").alias("last_order"))
    return t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("last_order", F.lit(-1)).alias("last_order"))


@query("j02_source_file_name", "SELECT p.page_id, coalesce(nullif(trim(d.source), ''), nullif(string_split(string_split(string_split(url, '#')[1], '?')[1], '/')[-1], '')) AS name FROM pages p LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) d ON p.page_id = d.doc_id")
def source_file_name(t):
    d = t.documents.filter("doc_id % 2 = 0").select("doc_id", "source")
    return t.pages.join(d, F.col("page_id") == F.col("doc_id"), "left").select("page_id", F.coalesce(X.first_non_blank(F.col("source")), X.url_file_name(F.col("url"))).alias("name"))


@query("j03_region_fallback", f"WITH {ITEMS} SELECT doc_id, item_id, CASE WHEN block_idx % 3 = 0 THEN 'exact' WHEN block_idx % 3 = 1 THEN 'canonical' END AS region FROM items")
def region_fallback(t):
    """A region by the item's own id, else by its canonical one."""
    i = items(t.documents).select("doc_id", "item_id", "block_idx", F.concat_ws("/", "doc_id", "item_id").alias("key"), F.concat_ws("/", "doc_id", F.lpad("block_idx", 4, "0")).alias("canonical"))
    regions = i.filter("block_idx % 3 = 0").select(F.col("key").alias("k"), F.lit("exact").alias("v")).union(i.filter("block_idx % 3 < 2").select("canonical", F.lit("canonical")))
    return J.lookup_with_fallback(i, regions, ["key", "canonical"], "k", "v", "region").select("doc_id", "item_id", "region")


@query("j04_candidate_pairs", f"WITH {ITEMS}, n AS (SELECT doc_id, item_id, lead(item_id) OVER (PARTITION BY doc_id ORDER BY block_idx) AS next_id, block_idx FROM items) SELECT DISTINCT a.doc_id, a.item_id AS prev_id, b.item_id AS next_id FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.next_id = b.item_id WHERE a.block_idx % 2 = 0")
def candidate_pairs(t):
    from pyspark.sql import Window

    n = items(t.documents).select("doc_id", "item_id", "block_idx", F.lead("item_id").over(Window.partitionBy("doc_id").orderBy("block_idx")).alias("want"))
    b = n.select(F.col("doc_id").alias("d2"), F.col("item_id").alias("next_id"))
    return n.filter("block_idx % 2 = 0").join(b, (F.col("doc_id") == F.col("d2")) & (F.col("want") == F.col("next_id"))).select("doc_id", F.col("item_id").alias("prev_id"), "next_id").dropDuplicates()


@query("j07_apply_results", f"WITH {BLOCKS}, r AS (SELECT doc_id, item_id, lower(text) AS translated FROM blocks WHERE block_idx % 2 = 0) SELECT doc_id, item_id, coalesce(translated, text) AS output FROM blocks LEFT JOIN r USING (doc_id, item_id)")
def apply_results(t):
    b = blocks(t.documents)
    r = b.filter("block_idx % 2 = 0").select("doc_id", "item_id", F.lower("text").alias("translated"))
    return b.join(r, ["doc_id", "item_id"], "left").select("doc_id", "item_id", F.coalesce("translated", "text").alias("output"))


@query("j08_expand_duplicates", "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY lang, text ORDER BY doc_id) AS rep_id FROM documents")
def expand_duplicates(t):
    """The representative's result fanned out to its copies."""
    reps = t.documents.groupBy(F.col("lang").alias("l"), F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("rep_id"))
    d = t.documents.withColumn("hash", F.sha2("text", 256))
    return d.join(reps, (F.col("lang") == F.col("l")) & (F.col("hash") == F.col("h"))).select("doc_id", "rep_id")


@query("j09_labels_default", "SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'skip' WHEN quality = 0 THEN 'review' ELSE 'translate' END AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def labels_default(t):
    label = F.when(F.col("toxic") == 1, "skip").when(F.col("quality") == 0, "review")
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce(label, F.lit("translate")).alias("label"))


@query("j10_cache_split", f"WITH {ITEMS}, c AS (SELECT DISTINCT sha256(text) AS key FROM items WHERE doc_id % 2 = 0) SELECT doc_id, item_id, sha256(text) IN (SELECT key FROM c) AS hit FROM items")
def cache_split(t):
    keyed = items(t.documents).select("doc_id", "item_id", F.sha2("text", 256).alias("key"))
    cache = keyed.filter("doc_id % 2 = 0").select("key").distinct()
    hits, misses = J.split_cached(keyed, cache, "key")
    return hits.select("doc_id", "item_id", F.lit(True).alias("hit")).union(misses.select("doc_id", "item_id", F.lit(False)))


_G = f"g AS (SELECT item_id, trim(split_part(text, ' ', 1)) AS source, CASE WHEN lower(({_ARRAY(_LEVEL_NAMES)})[item_id % 8 + 1]) IN {listed(K.LEVELS['preserve'])} THEN 'preserve' WHEN lower(({_ARRAY(_LEVEL_NAMES)})[item_id % 8 + 1]) IN {listed(K.LEVELS['canonical'])} THEN 'canonical' ELSE 'preferred' END AS level FROM benchmark)"
_DEDUP = "d AS (SELECT lower(source) AS key, max_by(level, item_id) AS level, min(item_id) AS position FROM g GROUP BY 1)"


@query("j11_overlay_merge", f"WITH {_G}, {_DEDUP}, base AS (SELECT * FROM d WHERE position % 3 <> 0), top AS (SELECT key, 'top' AS level, position FROM d WHERE position % 2 = 0) SELECT coalesce(b.key, t.key) AS key, coalesce(t.level, b.level) AS level, CAST(b.key IS NULL AS INTEGER) AS block, coalesce(b.position, t.position) AS position FROM base b FULL JOIN top t USING (key)")
def overlay_merge(t):
    d = unique_glossary(t)
    return J.overlay(d.filter("position % 3 != 0"), d.filter("position % 2 = 0").withColumn("level", F.lit("top")), "key", ["level"], "position")


def unique_glossary(t):
    """The last value of each term at its first position."""
    g = glossary(t)
    return g.groupBy(F.lower("source").alias("key")).agg(F.max_by("level", "item_id").alias("level"), F.min("item_id").alias("position"))


@query("j12_overridden", f"WITH {_G}, {_DEDUP} SELECT count(*) AS overridden FROM d WHERE position % 2 = 0 AND key IN (SELECT key FROM d WHERE position % 3 <> 0)")
def overridden(t):
    d = unique_glossary(t)
    return d.filter("position % 2 = 0").join(d.filter("position % 3 != 0"), "key", "left_semi").agg(F.count(F.lit(1)).alias("overridden"))


@query("j13_glossary_hits", f"WITH {ITEMS}, {_G}, {_DEDUP} SELECT key, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM d JOIN items ON contains(lower(text), key) WHERE length(key) >= 5 GROUP BY key")
def glossary_hits(t):
    terms = unique_glossary(t).filter("length(key) >= 5").select("key")
    return J.term_matches(items(t.documents).select("doc_id", "text"), "text", terms, "key", whole_words=False).groupBy("key").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("docs"))


@query("j14_term_boundaries", f"WITH {ITEMS}, {_G}, {_DEDUP} SELECT key, count(*) AS hits FROM d JOIN items ON regexp_matches(lower(text), '(^|[^a-z0-9])' || key || '($|[^a-z0-9])') WHERE regexp_matches(key, '^[a-z]{{3,}}$') GROUP BY key")
def term_boundaries(t):
    """Whole-word hits; letters outside A-Z count as edges."""
    terms = unique_glossary(t).filter(F.col("key").rlike("^[a-z]{3,}$")).select("key")
    texts = items(t.documents).select("doc_id", "item_id", "text")
    words = texts.withColumn("w", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))))
    return words.join(terms, F.col("w") == F.col("key")).groupBy("key").agg(F.count(F.lit(1)).alias("hits"))


_BOX = "box AS (SELECT doc_id, page_idx, item_id AS box_id, x0, y0, x1, y1 + 40 AS y1, block_idx FROM blocks)"


def boxes(t):
    """Item boxes made taller, so that neighbours of a column overlap."""
    return blocks(t.documents).select("doc_id", "page_idx", F.col("item_id").alias("box_id"), "x0", "y0", "x1", (F.col("y1") + 40).alias("y1"), "block_idx")


@query("j17_word_owner", f"WITH {BLOCKS}, {_BOX}, p AS (SELECT doc_id, page_idx, item_id AS point_id, x0 + 17 AS px, y0 + 75.5 AS py FROM blocks), m AS (SELECT p.*, box_id, row_number() OVER (PARTITION BY p.doc_id, p.page_idx, point_id ORDER BY pow((x0 + x1) / 2 - px, 2) + pow((y0 + y1) / 2 - py, 2), box_id) AS rn FROM p JOIN box USING (doc_id, page_idx) WHERE px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1) SELECT doc_id, page_idx, point_id, box_id FROM m WHERE rn = 1")
def word_owner(t):
    points = blocks(t.documents).select("doc_id", "page_idx", F.col("item_id").alias("point_id"), (F.col("x0") + 17).alias("px"), (F.col("y0") + 75.5).alias("py"))
    return J.containing_box(points, boxes(t), ["doc_id", "page_idx"], "px", "py").select("doc_id", "page_idx", "point_id", "box_id")


_SHARED = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@query("j18_iou_pairs", f"WITH {BLOCKS}, {_BOX}, big AS (SELECT doc_id, page_idx, box_id, x0 + 30 AS x0, y0 + 90 AS y0, x1, y1 + 90 AS y1 FROM box), m AS (SELECT a.doc_id, a.page_idx, a.box_id, b.box_id AS other_id, {_SHARED} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_SHARED}) AS iou FROM box a JOIN big b USING (doc_id, page_idx) WHERE a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1) SELECT doc_id, page_idx, box_id, other_id, round_even(iou, 6) AS iou FROM m QUALIFY count(*) OVER (PARTITION BY doc_id, page_idx, box_id) = 1")
def iou_pairs(t):
    """Overlapping pairs, kept where a box has exactly one partner."""
    big = boxes(t).select("doc_id", "page_idx", "box_id", (F.col("x0") + 30).alias("x0"), (F.col("y0") + 90).alias("y0"), "x1", (F.col("y1") + 90).alias("y1"))
    pairs = J.overlapping(boxes(t), big, ["doc_id", "page_idx"]).withColumn("key", F.struct("doc_id", "page_idx", "box_id"))
    return J.exactly_one(pairs, "key").select("doc_id", "page_idx", "box_id", "other_id", F.bround("iou", 6).alias("iou"))


@query("j19_nearest_below", f"WITH {BLOCKS}, m AS (SELECT a.doc_id, a.page_idx, a.item_id AS box_id, b.item_id AS below_id, b.y0 - a.y1 AS gap, row_number() OVER (PARTITION BY a.doc_id, a.page_idx, a.item_id ORDER BY b.y0 - a.y1, b.item_id) AS rn FROM blocks a JOIN blocks b USING (doc_id, page_idx) WHERE b.y0 >= a.y1 AND b.y0 - a.y1 <= 130 AND a.x0 < b.x1 AND b.x0 < a.x1) SELECT doc_id, page_idx, box_id, below_id, gap FROM m WHERE rn = 1")
def nearest_below(t):
    b = blocks(t.documents).withColumnRenamed("item_id", "box_id")
    return J.nearest_below(b, b, ["doc_id", "page_idx"], 130.0)


@query("j20_largest_donor", f"WITH {BLOCKS}, {_BOX}, s AS (SELECT * FROM box WHERE block_idx % 4 = 0), m AS (SELECT s.doc_id, s.page_idx, s.box_id, d.box_id AS donor, row_number() OVER (PARTITION BY s.doc_id, s.page_idx, s.box_id ORDER BY (d.x1 - d.x0) * (d.y1 - d.y0) DESC, d.box_id) AS rn FROM s JOIN box d USING (doc_id, page_idx) WHERE d.box_id <> s.box_id AND d.y0 < s.y1 AND s.y0 < d.y1) SELECT doc_id, page_idx, box_id, donor FROM m WHERE rn = 1")
def largest_donor(t):
    """Every fourth box takes the largest other box of its band."""
    slot = boxes(t).filter("block_idx % 4 = 0").select("doc_id", "page_idx", "box_id", F.col("y0").alias("sy0"), F.col("y1").alias("sy1"))
    donor = boxes(t).select("doc_id", "page_idx", F.col("box_id").alias("donor"), "x0", "y0", "x1", "y1")
    m = slot.join(donor, ["doc_id", "page_idx"]).filter("donor != box_id and y0 < sy1 and sy0 < y1")
    return m.groupBy("doc_id", "page_idx", "box_id").agg(F.min_by("donor", F.struct(-G.area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), F.col("donor"))).alias("donor"))


@query("j22_child_jobs", "SELECT a.o_orderkey AS job_id, b.o_orderkey AS child FROM orders a LEFT JOIN orders b ON b.o_orderkey || '' = a.o_orderkey || '0'")
def child_jobs(t):
    """A child is named by its parent's id and a suffix."""
    o = t.orders.select(F.col("o_orderkey").alias("child"))
    a = t.orders.select(F.col("o_orderkey").alias("job_id"))
    return a.join(o, F.concat(F.col("job_id").cast("string"), F.lit("0")) == F.col("child").cast("string"), "left")


@query("m02_duration_ms", "SELECT user_id, event_id, greatest(0, date_sub('millisecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts)) AS ms FROM events")
def duration_ms(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.timestamp_diff("MILLISECOND", F.lag("ts").over(w), F.col("ts"))
    return t.events.select("user_id", "event_id", F.when(gap.isNotNull(), F.greatest(F.lit(0), gap)).otherwise(F.when(F.lag("ts").over(w).isNull(), F.lit(0))).cast("long").alias("ms"))


@query("m03_squash", "SELECT event_id, least(80.0, greatest(20.0, value)) AS clamped, round_even(1 / (1 + exp(-0.1 * (value - 50))), 6) AS squashed FROM events")
def squash(t):
    return t.events.select("event_id", G.clamp(F.col("value"), 20.0, 80.0).alias("clamped"), F.bround(G.sigmoid(F.col("value") - 50, 0.1), 6).alias("squashed"))


@query("m08_rect_keys", f"WITH {BLOCKS} SELECT doc_id, item_id, (x1 - x0) * (y1 - y0) AS area, concat_ws(',', CAST(x0 * 10 AS BIGINT), CAST(y0 * 10 AS BIGINT), CAST(x1 * 10 AS BIGINT), CAST(y1 * 10 AS BIGINT)) AS key FROM blocks")
def rect_keys(t):
    e = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return blocks(t.documents).select("doc_id", "item_id", G.area(*e).alias("area"), G.rect_key(*e).alias("key"))


@query("m10_line_pitch", f"WITH {BLOCKS}, g AS (SELECT doc_id, page_idx, y0 - lag(y0) OVER (PARTITION BY doc_id, page_idx ORDER BY y0, x0) AS d FROM blocks) SELECT doc_id, page_idx, median(d) FILTER (d > 0) AS pitch FROM g GROUP BY doc_id, page_idx")
def line_pitch(t):
    """Median of the positive distances of neighbouring lines of a page."""
    y = blocks(t.documents).groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list("y0")).alias("y"))
    d = F.filter(F.zip_with(F.slice("y", F.lit(2), F.greatest(F.lit(0), F.size("y") - 1)), F.slice("y", F.lit(1), F.greatest(F.lit(0), F.size("y") - 1)), lambda a, b: a - b), lambda x: x > 0)
    return y.select("doc_id", "page_idx", G.array_median(d).alias("pitch"))


@query("m13_page_profile", f"WITH {BLOCKS}, p AS (SELECT doc_id, page_idx, count(*) AS n, avg(CASE WHEN block_type = 'table' THEN 1.0 ELSE 0.0 END) AS tables FROM blocks GROUP BY ALL) SELECT doc_id, page_idx, CASE WHEN tables >= 0.5 THEN 'tabular' WHEN n >= 8 THEN 'dense' WHEN n <= 2 THEN 'sparse' ELSE 'plain' END AS profile FROM p")
def page_profile(t):
    p = blocks(t.documents).groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("block_type") == "table").cast("double")).alias("tables"))
    return p.select("doc_id", "page_idx", F.when(F.col("tables") >= 0.5, "tabular").when(F.col("n") >= 8, "dense").when(F.col("n") <= 2, "sparse").otherwise("plain").alias("profile"))
