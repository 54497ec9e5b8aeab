"""Queries of aggregations (A), windows (W), top-k (L), sets (U) and sequential operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import sequential as S
from quillon.operators import sets as U
from quillon.operators import windows as W
from quillon.plans.items import BLOCKS, ITEMS, blocks, items
from quillon.plans.join_queries import _DEDUP, _G, boxes, unique_glossary
from quillon.plans.registry import query
from quillon.plans.rule_queries import ROLES_SQL, roled
from quillon.plans.text_queries import ends, glossary, last, listed, norm, starts


@query("a01_status_summary", f"WITH {ROLES_SQL}, n AS (SELECT *, {norm('text')} AS s FROM roles), k AS (SELECT * EXCLUDE (reason), CASE WHEN s = '' THEN 'empty' WHEN regexp_matches(s, '{X.SHORT_FRAGMENT}') THEN 'short_label' ELSE 'open' END AS reason, min(doc_id * 100000 + block_idx) OVER (PARTITION BY sha256(text)) = doc_id * 100000 + block_idx AS first_one FROM n) SELECT route, reason, count(*) AS n, round_even(CAST(count(*) FILTER (final_status IN ('translated', 'partially_translated')) AS DOUBLE) / count(*), 4) AS success_rate FROM (SELECT *, unnest(route_path) AS route FROM k WHERE first_one) GROUP BY route, reason")
def status_summary(t):
    """Distinct items by route and reason with the share that succeeded."""
    s = X.normalize_space(F.col("text"))
    b = blocks(t.documents).withColumn("reason", F.when(s == "", "empty").when(X.short_fragment(s), "short_label").otherwise("open")).withColumn("at", F.col("doc_id") * 100000 + F.col("block_idx"))
    b = U.first_wins(b, F.sha2("text", 256), ["at"], "rep", "at").filter("rep = at")
    ok = F.count_if(F.col("final_status").isin("translated", "partially_translated"))
    return b.select("reason", "final_status", F.explode("route_path").alias("route")).groupBy("route", "reason").agg(F.count(F.lit(1)).alias("n"), F.bround(ok / F.count(F.lit(1)), 4).alias("success_rate"))


@query("a01_slow_items", f"WITH {BLOCKS}, m AS (SELECT doc_id, item_id, latency_ms * latency_ms // 60000 AS ms FROM blocks), s AS (SELECT greatest(30000, CAST(floor(avg(ms) + 2 * stddev_pop(ms)) AS BIGINT)) AS most FROM m WHERE ms > 0) SELECT doc_id, item_id, ms FROM m, s WHERE ms > most")
def slow_items(t):
    """Few slow items among many fast ones."""
    b = blocks(t.documents).select("doc_id", "item_id", F.expr("latency_ms * latency_ms div 60000").alias("ms"))
    limit = b.filter("ms > 0").agg(F.greatest(F.lit(30000), F.floor(F.avg("ms") + 2 * F.stddev_pop("ms"))).alias("most"))
    return b.join(F.broadcast(limit), F.col("ms") > F.col("most")).select("doc_id", "item_id", "ms")  # one row


@query("a01_error_taxonomy", f"WITH {BLOCKS} SELECT e AS error, count(*) AS n FROM (SELECT unnest(error_types) AS e FROM blocks) GROUP BY e")
def error_counts(t):
    return blocks(t.documents).select(F.explode("error_types").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("a02_page_counts", f"WITH {BLOCKS} SELECT doc_id, page_idx, count(*) AS total, count(*) FILTER (final_status = 'translated') AS translated, count(*) FILTER (final_status = 'failed') AS failed FROM blocks GROUP BY ALL")
def page_counts(t):
    return blocks(t.documents).groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("final_status") == "translated").alias("translated"), F.count_if(F.col("final_status") == "failed").alias("failed"))


@query("a07_status_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def status_count(t):
    return t.orders.filter("o_orderstatus = 'F'").agg(F.count(F.lit(1)).alias("n"))


@query("a08_latency_summary", "SELECT event_type, count(*) AS n, round_even(quantile_cont(value, 0.5), 6) AS p50, round_even(quantile_cont(value, 0.9), 6) AS p90, round_even(quantile_cont(value, 0.95), 6) AS p95, max(value) AS top, round_even(avg(value), 2) AS mean FROM events GROUP BY event_type")
def latency_summary(t):
    p = lambda q: F.bround(F.percentile("value", F.lit(q)), 6)
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), F.max("value").alias("top"), F.bround(F.avg("value"), 2).alias("mean"))


@query("a09_rounded_percentile", f"WITH {BLOCKS} SELECT source, CAST(round_even(quantile_cont(latency_ms, 0.9), 0) AS BIGINT) AS p90 FROM blocks GROUP BY source")
def rounded_percentile(t):
    return blocks(t.documents).groupBy("source").agg(F.bround(F.percentile("latency_ms", F.lit(0.9))).cast("long").alias("p90"))


@query("a10_positive_percentile", "SELECT user_id, coalesce(quantile_cont(value, 0.75) FILTER (value > 90), 0.0) AS p75 FROM events GROUP BY user_id")
def positive_percentile(t):
    return t.events.groupBy("user_id").agg(F.coalesce(F.percentile(F.when(F.col("value") > 90, F.col("value")), F.lit(0.75)), F.lit(0.0)).alias("p75"))


@query("a14_low_quantile", f"WITH {BLOCKS} SELECT doc_id, list_sort(list(y1 - y0))[CAST(floor((count(*) - 1) * 0.25) AS BIGINT) + 1] AS target FROM blocks GROUP BY doc_id")
def low_quantile(t):
    """The value at a quarter of the sorted heights, without interpolation."""
    b = blocks(t.documents).withColumn("h", F.col("y1") - F.col("y0"))
    w = Window.partitionBy("doc_id")
    ranked = b.withColumn("i", F.row_number().over(w.orderBy("h")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("i") == F.floor((F.col("n") - 1) * 0.25)).select("doc_id", F.col("h").alias("target"))


@query("a16_auto_terms", f"WITH {ITEMS}, {_G}, {_DEDUP}, m AS (SELECT doc_id * 100000 + block_idx AS at, unnest(regexp_extract_all(text, '[A-Z]{{2,12}}')) AS term FROM items) SELECT lower(term) AS term, count(*) AS hits FROM m WHERE lower(term) NOT IN (SELECT key FROM d) GROUP BY 1 HAVING count(*) >= 3")
def auto_terms(t):
    """Terms in capitals by hits, without those that the glossary has."""
    m = items(t.documents).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z]{2,12}"), F.lit(0))).alias("term"))
    counted = m.groupBy(F.lower("term").alias("term")).agg(F.count(F.lit(1)).alias("hits")).filter("hits >= 3")
    return counted.join(unique_glossary(t).select(F.col("key").alias("term")), "term", "left_anti")


@query("a17_term_memory", "SELECT event_type || '/' || user_id % 7 AS term, count(*) AS hits, max_by(value, event_id) AS latest, array_to_string(list_sort(list_distinct(list(user_id)))[1:8], ',') AS sources FROM events GROUP BY 1")
def term_memory(t):
    """Hits, latest value and first eight sources of each term."""
    e = t.events.withColumn("term", F.concat(F.col("event_type"), F.lit("/"), (F.col("user_id") % 7).cast("string")))
    return e.groupBy("term").agg(F.count(F.lit(1)).alias("hits"), F.max_by("value", "event_id").alias("latest"), F.array_join(F.slice(F.array_sort(F.collect_set("user_id")), 1, 8), ",").alias("sources"))


@query("a18_glossary_usage", f"WITH {ITEMS}, {_G}, {_DEDUP}, h AS (SELECT DISTINCT key, level FROM d JOIN items ON contains(lower(text), key) WHERE length(key) >= 5) SELECT (SELECT count(*) FROM d) AS entries, count(*) AS source_hits, (SELECT count(*) FROM d) - count(*) AS unused, count(*) FILTER (level = 'preferred') AS preferred_hits FROM h")
def glossary_usage(t):
    from quillon.operators.joins import term_matches

    terms = unique_glossary(t)
    hits = term_matches(items(t.documents).select("text"), "text", terms.filter("length(key) >= 5").select("key", "level"), "key", whole_words=False).select("key", "level").distinct()
    found = hits.agg(F.count(F.lit(1)).alias("source_hits"), F.count_if(F.col("level") == "preferred").alias("preferred_hits"))
    total = terms.agg(F.count(F.lit(1)).alias("entries"))
    return total.join(found).select("entries", "source_hits", (F.col("entries") - F.col("source_hits")).alias("unused"), "preferred_hits")  # one row each


@query("a21_pages_of_unit", f"WITH {BLOCKS} SELECT doc_id, sub_type, array_to_string(list_sort(list_distinct(list(page_idx))), ',') AS pages FROM blocks GROUP BY doc_id, sub_type")
def pages_of_unit(t):
    return blocks(t.documents).groupBy("doc_id", "sub_type").agg(F.array_join(F.array_sort(F.collect_set("page_idx")), ",").alias("pages"))


@query("a22_units", f"WITH {BLOCKS} SELECT doc_id, item_id, CASE WHEN count(*) OVER w >= 2 THEN 'unit-' || sub_type ELSE item_id END AS unit_id, count(*) OVER w AS members FROM blocks WINDOW w AS (PARTITION BY doc_id, sub_type)")
def units(t):
    w = Window.partitionBy("doc_id", "sub_type")
    n = F.count(F.lit(1)).over(w)
    return blocks(t.documents).select("doc_id", "item_id", F.when(n >= 2, F.concat(F.lit("unit-"), "sub_type")).otherwise(F.col("item_id")).alias("unit_id"), n.alias("members"))


@query("a23_group_text", f"WITH {BLOCKS} SELECT doc_id, sub_type, string_agg(text, ' ' ORDER BY block_idx) AS merged FROM blocks GROUP BY doc_id, sub_type HAVING count(*) >= 2 AND sum(length(text)) <= 4000")
def group_text(t):
    """Members in order as one text, for groups that are not too heavy."""
    g = blocks(t.documents).groupBy("doc_id", "sub_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.array_sort(F.collect_list(F.struct("block_idx", F.col("text").alias("s")))).alias("m"))
    return g.filter("n >= 2 and chars <= 4000").select("doc_id", "sub_type", F.array_join(F.transform("m", lambda x: x["s"]), " ").alias("merged"))


@query("a25_overlap_stats", f"WITH {BLOCKS}, box AS (SELECT doc_id, page_idx, item_id AS box_id, x0, y0, x1, y1 + 90 AS y1 FROM blocks) SELECT a.doc_id, a.page_idx, a.box_id, count(*) AS n, sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS shared FROM box a JOIN box b USING (doc_id, page_idx) WHERE a.box_id <> b.box_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY ALL")
def overlap_stats(t):
    from quillon.operators.joins import overlapping

    tall = boxes(t).withColumn("y1", F.col("y1") + 50)  # down into the next box of the column
    p = overlapping(tall, tall, ["doc_id", "page_idx"], -1.0).filter("box_id != other_id")
    return p.groupBy("doc_id", "page_idx", "box_id").agg(F.count(F.lit(1)).alias("n"), F.sum("shared").alias("shared"))


@query("a27_book_summary", f"WITH {BLOCKS}, p AS (SELECT doc_id, page_idx, count(*) AS n, count(*) FILTER (final_status = 'translated') AS ok FROM blocks GROUP BY ALL) SELECT doc_id, count(*) AS pages, CAST(sum(n) AS BIGINT) AS items, CAST(sum(ok) AS BIGINT) AS translated, max(n) AS fullest FROM p GROUP BY doc_id")
def book_summary(t):
    p = blocks(t.documents).groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("final_status") == "translated").alias("ok"))
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("items"), F.sum("ok").alias("translated"), F.max("n").alias("fullest"))


_NB = "coalesce(string_agg({0}, ' / ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {1}), '')"


def _cut(c: str) -> str:
    return f"CASE WHEN length({c}) <= 360 THEN {c} ELSE rtrim(left({c}, 359)) || '...' END"


@query("w01_context", f"WITH c AS (SELECT conv_id, turn, {_NB.format('text', '2 PRECEDING AND 1 PRECEDING')} AS b, {_NB.format('text', '1 FOLLOWING AND 2 FOLLOWING')} AS a FROM conversations) SELECT conv_id, turn, {_cut('b')} AS before, {_cut('a')} AS after FROM c")
def context(t):
    return W.neighbours(t.conversations, ["conv_id"], ["turn"], "text").select("conv_id", "turn", "before", "after")


@query("w02_zones", f"WITH {BLOCKS} SELECT doc_id, item_id, row_number() OVER w - 1 AS zone_rank, count(*) OVER z AS zone_size, CASE WHEN count(*) OVER z = 1 THEN 'single' WHEN row_number() OVER w = 1 THEN 'head' WHEN row_number() OVER w = count(*) OVER z THEN 'tail' ELSE 'middle' END AS zone_role FROM blocks WINDOW w AS (PARTITION BY doc_id, page_idx, x0 ORDER BY y0, block_idx), z AS (PARTITION BY doc_id, page_idx, x0)")
def zones(t):
    return W.zones(blocks(t.documents), ["doc_id", "page_idx", "x0"], ["y0", "block_idx"]).select("doc_id", "item_id", "zone_rank", "zone_size", "zone_role")


@query("w03_columns", f"WITH {BLOCKS}, c AS (SELECT doc_id, page_idx, (x0 + x1) / 2 + block_idx / 1000.0 AS cx, x0, x1 FROM blocks), g AS (SELECT *, lead(cx) OVER w - cx AS gap, (lead(cx) OVER w + cx) / 2 AS mid, row_number() OVER w AS i FROM c WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY cx)), m AS (SELECT doc_id, page_idx, count(*) AS n, max(x1) - min(x0) AS width, max(gap) AS gap, arg_max(mid, gap) AS mid, arg_max(i, gap) AS i FROM g GROUP BY ALL), f AS (SELECT *, coalesce(n >= 6 AND width > 0 AND gap >= width * 0.18 AND i >= 3 AND n - i >= 3, false) AS ok FROM m) SELECT doc_id, page_idx, CASE WHEN ok THEN 'double' ELSE 'single' END AS mode, CASE WHEN ok THEN round_even(mid, 6) ELSE 0.0 END AS split_x FROM f")
def columns(t):
    b = blocks(t.documents).withColumn("cx", (F.col("x0") + F.col("x1")) / 2 + F.col("block_idx") / 1000.0)
    return W.column_split(b, ["doc_id", "page_idx"], "cx", "x0", "x1").withColumn("split_x", F.bround("split_x", 6))


def scored(t):
    return W.join_score(blocks(t.documents), ["doc_id"], ["block_idx"], "text")


_SCORE = f"""{BLOCKS}, l AS (SELECT *, lead(text) OVER w AS nt, lead(page_idx) OVER w AS np, lead(x0) OVER w AS nx0, lead(y0) OVER w AS ny0 FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx)),
n AS (SELECT *, {norm('text')} AS a, {norm("coalesce(nt, '')")} AS b, page_idx = np AS same, nx0 > x1 + 8 AND nx0 - x1 <= 96 AS crosses, CASE WHEN nx0 > x1 + 8 THEN nx0 - x1 <= 96 ELSE abs(nx0 - x0) <= 28 AND ny0 - y1 <= 40 END AS likely FROM l),
f AS (SELECT *, {starts('b')} AS st, regexp_matches(a, '[.!?:;]$') AS te, {ends('a')} AS en, {last('a')} IN {listed(X.SUSPICIOUS_ENDS)} AS su, regexp_matches(b, '^(?:\\(?\\d+(?:\\.\\d+)*\\)?[.)]?\\s+|[A-Z][A-Z\\s\\-]{{3,}}|[•\\-*]\\s+)') AS he, length(a) - length(replace(a, '$', '')) AS da, length(b) - length(replace(b, '$', '')) AS db FROM n),
g AS (SELECT *, CASE WHEN nt IS NULL THEN NULL WHEN da % 2 = 0 AND db % 2 = 0 AND a <> '' AND b <> '' AND CASE WHEN same THEN likely AND (crosses OR a LIKE '%-') ELSE np - page_idx = 1 END THEN st::INT * 3 + (te AND st)::INT * 3 + en::INT * 3 + (a LIKE '%-')::INT * 4 + (a LIKE '%,')::INT + su::INT + CASE WHEN same THEN crosses::INT * 2 ELSE (NOT te)::INT * 2 END ELSE -999 END AS j,
 greatest(0, CASE WHEN regexp_matches(a, '[.!?]$') THEN 4 WHEN te THEN 2 ELSE 0 END - st::INT * 3 + he::INT * 3 + (regexp_matches(b, '^[A-Z]') AND NOT st)::INT + (same AND NOT likely)::INT * 2) AS k FROM f),
scored AS (SELECT doc_id, block_idx, item_id, page_idx, j AS join_score, k AS break_score, CASE WHEN j < 0 THEN 'break' WHEN j >= 4 AND j >= k + 2 THEN 'join' WHEN k >= 4 AND k >= j + 1 THEN 'break' ELSE 'candidate' END AS decision FROM g WHERE nt IS NOT NULL)"""


@query("w05_pair_decision", f"WITH {_SCORE} SELECT doc_id, item_id, join_score, break_score, decision FROM scored")
def pair_decision(t):
    return scored(t).filter("decision is not null").select("doc_id", "item_id", "join_score", "break_score", "decision")


@query("j06_review_route", f"WITH {_SCORE} SELECT doc_id, item_id, CASE WHEN join_score >= 7 AND join_score >= break_score + 4 THEN 'auto_join' WHEN break_score >= 6 AND break_score >= join_score + 3 THEN 'drop' ELSE 'review' END AS route FROM scored WHERE decision = 'candidate' OR decision = 'join'")
def review_route(t):
    j, k = F.col("join_score"), F.col("break_score")
    route = F.when((j >= 7) & (j >= k + 4), "auto_join").when((k >= 6) & (k >= j + 3), "drop").otherwise("review")
    return scored(t).filter(F.col("decision").isin("candidate", "join")).select("doc_id", "item_id", route.alias("route"))


@query("a03_decision_counts", f"WITH {_SCORE} SELECT decision, count(*) AS n, count(*) FILTER (decision = 'join') AS joined FROM scored GROUP BY decision")
def decision_counts(t):
    return scored(t).filter("decision is not null").groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("decision") == "join").alias("joined"))


@query("w04_continuation_groups")
def continuation_groups(t):
    return S.chain_ids(scored(t).select("doc_id", "block_idx", "item_id", "decision"), ["doc_id"], ["block_idx"], "decision").select("doc_id", "item_id", "group_no")


@query("w04_islands", f"WITH {_SCORE}, i AS (SELECT doc_id, item_id, CAST(sum(CASE WHEN prev = 'join' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block_idx) AS BIGINT) AS island FROM (SELECT b.doc_id, b.item_id, b.block_idx, lag(decision) OVER (PARTITION BY b.doc_id ORDER BY b.block_idx) AS prev FROM blocks b LEFT JOIN scored s USING (doc_id, item_id))) SELECT * FROM i")
def islands(t):
    return W.islands(scored(t), ["doc_id"], ["block_idx"], F.col("decision") == "join").select("doc_id", "item_id", "island")


@query("w07_group_roles", f"WITH {BLOCKS} SELECT doc_id, item_id, CASE WHEN n = 1 THEN 'single' WHEN r = 1 THEN 'first' WHEN r = n THEN 'last' ELSE 'middle' END AS role, CASE WHEN p > 1 THEN 'cross_page' ELSE 'intra_page' END AS scope FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sub_type ORDER BY block_idx) AS r, count(*) OVER (PARTITION BY doc_id, sub_type) AS n, max(page_idx) OVER (PARTITION BY doc_id, sub_type) - min(page_idx) OVER (PARTITION BY doc_id, sub_type) + 1 AS p FROM blocks)")
def group_roles(t):
    g = Window.partitionBy("doc_id", "sub_type")
    r, n = F.row_number().over(g.orderBy("block_idx")), F.count(F.lit(1)).over(g)
    role = F.when(n == 1, "single").when(r == 1, "first").when(r == n, "last").otherwise("middle")
    scope = F.when(F.max("page_idx").over(g) > F.min("page_idx").over(g), "cross_page").otherwise("intra_page")
    return blocks(t.documents).select("doc_id", "item_id", role.alias("role"), scope.alias("scope"))


@query("w08_previous_anchor", f"WITH {BLOCKS} SELECT doc_id, item_id, last_value(CASE WHEN sub_type IN ('figure_caption', 'title') THEN sub_type END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM blocks")
def previous_anchor(t):
    return W.carry_anchor(blocks(t.documents), ["doc_id"], ["block_idx"], F.when(F.col("sub_type").isin("figure_caption", "title"), F.col("sub_type"))).select("doc_id", "item_id", "anchor")


@query("w09_front_matter", f"WITH {BLOCKS}, b AS (SELECT doc_id, min(block_idx) FILTER (sub_type = 'body') AS body FROM blocks GROUP BY doc_id) SELECT doc_id, item_id, coalesce(block_idx < body, false) AS front FROM blocks LEFT JOIN b USING (doc_id)")
def front_matter(t):
    first = F.min(F.when(F.col("sub_type") == "body", F.col("block_idx"))).over(Window.partitionBy("doc_id"))
    return blocks(t.documents).select("doc_id", "item_id", F.coalesce(F.col("block_idx") < first, F.lit(False)).alias("front"))


@query("w11_symbol_runs", "WITH r AS (SELECT conv_id, turn, role, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS island FROM conversations) SELECT conv_id, role, min(turn) AS first_turn, count(*) AS n FROM r GROUP BY conv_id, role, island")
def symbol_runs(t):
    """Runs of consecutive turns of one role."""
    i = F.col("turn") - F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return t.conversations.withColumn("i", i).groupBy("conv_id", "role", "i").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n")).drop("i")


@query("w12_reference_cutoff", f"WITH {ROLES_SQL}, c AS (SELECT doc_id, min(block_idx) AS cut FROM roles WHERE semantic_role = 'reference' AND page_idx > 0 GROUP BY doc_id) SELECT doc_id, item_id, page_idx FROM roles JOIN c USING (doc_id) WHERE block_idx >= cut")
def reference_cutoff(t):
    """Rows at or after the first reference of a later page."""
    r = roled(t.documents)
    cut = r.filter("semantic_role = 'reference' and page_idx > 0").groupBy("doc_id").agg(F.min(F.struct("page_idx", "block_idx")).alias("cut"))
    return r.join(cut, "doc_id").filter(F.struct("page_idx", "block_idx") >= F.col("cut")).select("doc_id", "item_id", "page_idx")


@query("w15_event_union", "WITH u AS (SELECT user_id AS job_id, ts, event_id AS seq, event_type AS event FROM events UNION ALL SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM orders) SELECT job_id, seq AS source_seq, event, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq, event) AS seq FROM u")
def event_union(t):
    """Events of all sources renumbered in order."""
    u = t.events.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp"), F.col("event_id").alias("source_seq"), F.col("event_type").alias("event"))
    o = t.orders.select(F.col("o_custkey").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderkey").alias("source_seq"), F.col("o_orderstatus").alias("event"))
    return u.unionByName(o).select("job_id", "source_seq", "event", F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "source_seq", "event")).alias("seq"))


@query("w16_live_stage", "SELECT user_id, arg_max(event_type, (CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END, ts, event_id)) AS stage FROM events WHERE event_type <> 'error' GROUP BY user_id")
def live_stage(t):
    """The stage of highest rank, then latest."""
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    e = t.events.filter("event_type != 'error'").withColumn("rank", rank).withColumn("stage", F.col("event_type"))
    return W.latest(e, "user_id", ["stage"], ["rank", "ts", "event_id"])


@query("w17_stage_history", "WITH l AS (SELECT *, lag(event_type) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT * FROM l WHERE prev IS DISTINCT FROM event_type) SELECT user_id, event_type AS stage, ts AS entered, greatest(0, date_sub('millisecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS d FROM r")
def stage_history(t):
    h = W.stage_history(t.events, "user_id", "ts", "event_type", "event_id")
    return h.select("user_id", "stage", "entered", F.coalesce("duration_ms", F.lit(0)).alias("d"))


@query("w18_change_events", "WITH l AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER w AS r, lag(o_orderstatus) OVER w AS ps, lag(o_orderpriority) OVER w AS pp FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_custkey, o_orderkey, 'created' AS change FROM l WHERE r = 1 UNION ALL SELECT o_custkey, o_orderkey, 'o_orderstatus_changed' FROM l WHERE r > 1 AND ps IS DISTINCT FROM o_orderstatus UNION ALL SELECT o_custkey, o_orderkey, 'o_orderpriority_changed' FROM l WHERE r > 1 AND pp IS DISTINCT FROM o_orderpriority")
def change_events(t):
    return W.changes(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"]).select("o_custkey", "o_orderkey", "change")


@query("w19_greedy_windows")
def greedy_windows(t):
    """Items of a document packed into windows of at most 8 items and 1200 characters."""
    i = items(t.documents).withColumn("n", F.length("text"))
    return S.pack(i.select("doc_id", "block_idx", "n"), ["doc_id"], ["block_idx"], "n", 8, 1200)


@query("w19_greedy_fold")
def greedy_fold(t):
    """The same packing by a fold inside the JVM."""
    g = items(t.documents).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", F.length("text").cast("long").alias("n")))).alias("m"))
    w = S.pack_array(F.transform("m", lambda x: x["n"]), 8, 1200)
    return g.select("doc_id", F.explode(F.arrays_zip(F.transform("m", lambda x: x["block_idx"]).alias("block_idx"), w.alias("window"))).alias("z")).select("doc_id", "z.block_idx", F.col("z.window").cast("long").alias("window"))


@query("w21_adjacent_risk", f"WITH {BLOCKS} SELECT doc_id, item_id, coalesce(lead(y0) OVER w < y1 + 65 AND lead(x0) OVER w < x1, false) AS risk FROM blocks WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY y0, x0)")
def adjacent_risk(t):
    w = Window.partitionBy("doc_id", "page_idx").orderBy("y0", "x0")
    return blocks(t.documents).select("doc_id", "item_id", F.coalesce((F.lead("y0").over(w) < F.col("y1") + 65) & (F.lead("x0").over(w) < F.col("x1")), F.lit(False)).alias("risk"))


@query("w22_smooth_column")
def smooth_column(t):
    b = blocks(t.documents).select("doc_id", "page_idx", "block_idx", (F.col("y1") - F.col("y0")).alias("h"))
    return S.smooth(b, ["doc_id", "page_idx"], ["block_idx"], "h", 10.0)


@query("w23_chains", f"WITH RECURSIVE {BLOCKS}, l AS (SELECT doc_id, block_idx, lead(block_idx) OVER (PARTITION BY doc_id ORDER BY block_idx) AS nx FROM blocks), e AS (SELECT doc_id * 1000000 + block_idx AS prev, doc_id * 1000000 + nx AS next FROM l WHERE nx IS NOT NULL AND (doc_id + block_idx) % 3 <> 0), c AS (SELECT prev AS chain, prev AS node, CAST(0 AS BIGINT) AS position FROM e WHERE prev NOT IN (SELECT next FROM e) UNION ALL SELECT c.chain, e.next, c.position + 1 FROM c JOIN e ON c.node = e.prev) SELECT chain, position, node FROM c")
def chains(t):
    from quillon.operators.joins import chains as walk

    w = Window.partitionBy("doc_id").orderBy("block_idx")
    e = items(t.documents).withColumn("nx", F.lead("block_idx").over(w)).filter("nx is not null and (doc_id + block_idx) % 3 != 0")
    return walk(e.select((F.col("doc_id") * 1000000 + F.col("block_idx")).alias("prev"), (F.col("doc_id") * 1000000 + F.col("nx")).alias("next")))


@query("w25_stage_order", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 50 THEN ts END ASC NULLS LAST, event_id) AS position FROM events")
def stage_order(t):
    return t.events.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.when(F.col("value") > 50, F.col("ts")).asc_nulls_last(), "event_id")).alias("position"))


@query("l01_page_of_jobs", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 25")
def page_of_jobs(t):
    return U.page(t.orders.filter("o_orderstatus = 'O'"), [F.desc("o_orderdate"), "o_orderkey"], 25, 50).select("o_orderkey", "o_orderstatus")


@query("l02_event_page", "SELECT event_id FROM events WHERE user_id = 1000 OR user_id < 30 ORDER BY event_id LIMIT 500")
def event_page(t):
    return U.page(t.events.filter("user_id = 1000 or user_id < 30"), ["event_id"], 0, 9999).select("event_id")


@query("l03_total_and_slice", f"WITH {BLOCKS}, f AS (SELECT doc_id, item_id, count(*) OVER () AS total FROM blocks WHERE final_status = 'failed') SELECT * FROM f ORDER BY doc_id, item_id LIMIT 100 OFFSET 50")
def total_and_slice(t):
    f = blocks(t.documents).filter("final_status = 'failed'").select("doc_id", "item_id")
    total = f.agg(F.count(F.lit(1)).alias("total"))
    return U.page(f, ["doc_id", "item_id"], 50, 100).join(F.broadcast(total))  # one row


@query("l05_slowest", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 12")
def slowest(t):
    return t.events.orderBy(F.desc("value"), "event_id").limit(12).select("event_id", "value")


@query("l07_top_per_source", "SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 8")
def top_per_source(t):
    return U.top_k(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 8)


@query("l08_term_order", f"WITH {_G}, {_DEDUP} SELECT key, row_number() OVER (ORDER BY length(key) DESC, CASE level WHEN 'preserve' THEN 0 ELSE 1 END, key) AS position FROM d")
def term_order(t):
    """A glossary's rows are few by its own limit, so one ordered pass numbers them."""
    return unique_glossary(t).select("key", F.row_number().over(Window.orderBy(F.desc(F.length("key")), F.when(F.col("level") == "preserve", 0).otherwise(1), "key")).alias("position"))


@query("l10_batches", f"WITH {BLOCKS}, b AS (SELECT doc_id, item_id, block_idx, length(text) BETWEEN 16 AND 1200 AS ok FROM blocks) SELECT doc_id, item_id, CASE WHEN ok THEN (row_number() OVER (PARTITION BY doc_id, ok ORDER BY block_idx) - 1) // 6 ELSE CAST(ceil(count(*) FILTER (ok) OVER (PARTITION BY doc_id) / 6.0) AS BIGINT) + row_number() OVER (PARTITION BY doc_id, ok ORDER BY block_idx) - 1 END AS batch FROM b")
def batches(t):
    return U.batches(blocks(t.documents), ["doc_id"], ["block_idx"], F.length("text").between(16, 1200), 6).select("doc_id", "item_id", "batch")


@query("l12_worker_shares", "WITH q AS (SELECT user_id % 3 AS queue, count(*) AS n FROM events GROUP BY 1), s AS (SELECT *, sum(n) OVER () AS total, row_number() OVER (ORDER BY queue) AS i, count(*) OVER () AS k FROM q), x AS (SELECT *, CAST(13 * n // total AS BIGINT) AS part FROM s) SELECT queue, CAST(1 + CASE WHEN i < k THEN part ELSE 13 - coalesce(sum(part) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS BIGINT) AS workers FROM x")
def worker_shares(t):
    """Sixteen workers: one for each queue, the rest by share, what is left to the last; one row per queue."""
    q = t.events.groupBy((F.col("user_id") % 3).alias("queue")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("queue")
    s = q.withColumns({"total": F.sum("n").over(Window.partitionBy()), "i": F.row_number().over(w), "k": F.count(F.lit(1)).over(Window.partitionBy())}).withColumn("part", F.expr("13 * n div total"))
    before = F.coalesce(F.sum("part").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.select("queue", (1 + F.when(F.col("i") < F.col("k"), F.col("part")).otherwise(13 - before)).alias("workers"))


@query("l13_custom_order", "SELECT event_type, row_number() OVER (ORDER BY coalesce(list_position(['purchase', 'click', 'view'], event_type), 999), event_type) AS position FROM (SELECT DISTINCT event_type FROM events)")
def custom_order(t):
    at = F.array_position(F.array(*map(F.lit, ("purchase", "click", "view"))), F.col("event_type"))
    e = t.events.select("event_type").distinct()
    return e.select("event_type", F.row_number().over(Window.orderBy(F.coalesce(F.nullif(at, F.lit(0)), F.lit(999)), "event_type")).alias("position"))


@query("u01_first_wins", f"WITH {BLOCKS}, s AS (SELECT *, CASE WHEN tag = '' THEN sha256(concat_ws(chr(31), block_type, sub_type, trim(text))) END AS sig, doc_id * 100000 + block_idx AS pos FROM blocks) SELECT doc_id, item_id, CASE WHEN sig IS NULL THEN pos ELSE min(pos) OVER (PARTITION BY sig) END AS rep FROM s")
def first_wins(t):
    b = blocks(t.documents).withColumn("at", F.col("doc_id") * 100000 + F.col("block_idx"))
    sig = F.when(F.col("tag") == "", X.signature(F.col("block_type"), F.col("sub_type"), F.trim("text")))
    return U.first_wins(b, sig, ["at"], "rep", "at").select("doc_id", "item_id", "rep")


@query("u02_last_wins", f"WITH {_G} SELECT lower(source) AS key, min(item_id) AS item_id, max_by(level, item_id) AS level FROM g GROUP BY 1")
def last_wins(t):
    return U.last_wins(glossary(t).select(F.lower("source").alias("key"), "item_id", "level"), "key", "item_id")


@query("u03_distinct_jobs", "SELECT trim(o_orderpriority) AS job, min(o_orderkey) AS first_key FROM orders WHERE trim(o_orderpriority) <> '' GROUP BY 1")
def distinct_jobs(t):
    return t.orders.groupBy(F.trim("o_orderpriority").alias("job")).agg(F.min("o_orderkey").alias("first_key")).filter("job != ''")


@query("u04_missing_extra", f"WITH {BLOCKS}, a AS (SELECT doc_id, item_id FROM blocks WHERE block_idx % 5 <> 0), b AS (SELECT doc_id, item_id FROM blocks WHERE block_idx % 7 <> 0) SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def missing_extra(t):
    b = blocks(t.documents)
    return U.differences(b.filter("block_idx % 5 != 0").select("doc_id", "item_id"), b.filter("block_idx % 7 != 0").select("doc_id", "item_id"))


@query("u05_subset", f"WITH {ITEMS}, n AS (SELECT doc_id, item_id, list_distinct(string_split({norm('text')}, ' ')) AS a, string_split(lower({norm('text')}), ' ') AS b FROM items) SELECT doc_id, item_id, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS missing FROM n")
def subset(t):
    s = X.normalize_space(F.col("text"))
    return items(t.documents).select("doc_id", "item_id", F.size(F.array_except(F.split(s, " "), F.split(F.lower(s), " "))).cast("long").alias("missing"))


@query("u06_rect_union", f"WITH {BLOCKS} SELECT doc_id, page_idx, count(DISTINCT (CAST(x0 * 10 AS BIGINT), CAST(x1 * 10 AS BIGINT))) AS n FROM (SELECT doc_id, page_idx, x0, x1 FROM blocks UNION ALL SELECT doc_id, page_idx, x0 + 0.01, x1 FROM blocks) GROUP BY doc_id, page_idx")
def rect_union(t):
    b = blocks(t.documents).select("doc_id", "page_idx", "x0", "x1")
    both = b.unionByName(b.withColumn("x0", F.col("x0") + 0.01))
    key = [F.bround(F.col(c) * 10).cast("long").alias(c) for c in ("x0", "x1")]
    return both.select("doc_id", "page_idx", *key).distinct().groupBy("doc_id", "page_idx").agg(F.count(F.lit(1)).alias("n"))


@query("u08_manual_and_auto", f"WITH {_G}, {_DEDUP} SELECT key, level FROM d WHERE position % 2 = 0 UNION ALL SELECT key, 'preserve' FROM d WHERE position % 3 = 0 AND key NOT IN (SELECT key FROM d WHERE position % 2 = 0)")
def manual_and_auto(t):
    d = unique_glossary(t)
    manual = d.filter("position % 2 = 0").select("key", "level")
    return manual.unionByName(d.filter("position % 3 = 0").select("key", F.lit("preserve").alias("level")).join(manual, "key", "left_anti"))


@query("u10_set_difference", "SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(t):
    return t.orders.select("o_custkey").subtract(t.orders.filter("o_orderstatus = 'F'").select("o_custkey"))


@query("t03_in_flight_peak", "WITH r AS (SELECT event_type, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS d FROM events) SELECT event_type, CAST(max(run) AS BIGINT) AS peak, CAST(sum(d) AS BIGINT) AS at_end FROM r GROUP BY event_type")
def in_flight_peak(t):
    return W.gauge(t.events, "event_type", "ts", F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1), "event_id")


@query("t04_adaptive_limit")
def adaptive_limit(t):
    e = t.events.select("user_id", "event_id", (F.col("value") * 500).alias("ms"), (F.col("event_type") == "error").alias("failed"))
    return S.adaptive_limit(e, "user_id", ["event_id"], "ms", "failed")


@query("t09_log_tail", "SELECT user_id, array_to_string(list(event_id ORDER BY event_id)[-40:], ',') AS tail FROM events GROUP BY user_id")
def log_tail(t):
    """The last 40 events of each user: ranked first, so that only those are gathered."""
    last = U.top_k(t.events.select("user_id", "event_id"), ["user_id"], [F.desc("event_id")], 40)
    return last.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("tail"))


@query("m06_merged_boxes")
def merged_boxes(t):
    return S.merge_boxes(boxes(t).select("doc_id", "page_idx", "x0", "y0", "x1", "y1"), ["doc_id", "page_idx"])


@query("c09_checksums")
def checksums(t):
    return items(t.documents).select("doc_id", "item_id", S.checksum(F.lit("formula"), F.col("text")).alias("checksum"))


@query("c12_lenient_json")
def lenient(t):
    """Replies with fences, bare names, curly quotes, commas too many, or nothing to read."""
    i, kind = F.col("event_id").cast("string"), F.col("event_type")
    forms = [F.concat(F.lit("```json\n{id: "), i, F.lit(', "k": “'), kind, F.lit("”,}\n```")), F.concat(F.lit('Here: {"k": ["'), kind, F.lit('", '), i, F.lit(",]} done")), kind, F.concat(F.lit('{"a": {"b": '), i, F.lit("}")), F.col("props")]
    raw = F.coalesce(*[F.when(F.col("event_id") % len(forms) == n, f) for n, f in enumerate(forms)])
    return t.events.select("event_id", S.lenient_json(raw).alias("json"))


@query("c13_copy_similarity")
def copy_similarity(t):
    """How like a conversation's turn is to the one before."""
    before = F.lag("text", 1, "").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.withColumn("before", before).select("conv_id", "turn", S.similarity(F.col("before"), F.col("text")).alias("ratio"))


@query("c14_weighted_split")
def weighted_split(t):
    return items(t.documents).select("doc_id", "item_id", F.array_join(S.split_by_weight(F.col("text"), F.array(F.lit(3.0), F.lit(2.0), F.lit(1.0))), "\n").alias("parts"))


@query("j15_term_spans")
def term_spans(t):
    words_ = F.array(*map(F.lit, ("the", "then", "heth", "ing", "enth")))
    spans = items(t.documents).select("doc_id", "item_id", F.explode(S.term_spans(F.col("text"), words_)).alias("s"))
    return spans.select("doc_id", "item_id", "s.start", "s.stop", "s.term")


