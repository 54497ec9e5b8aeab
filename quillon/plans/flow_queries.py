"""Queries of command prefixes, literal decisions, continuation groups, leaks, terms and page typography."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import terms as K
from quillon.operators import commands as C
from quillon.operators import continuation as N
from quillon.operators import typography as Y
from quillon.plans.items import BLOCKS, ITEMS, blocks, cycle, dealt, items
from quillon.plans.registry import query
from quillon.plans.rule_queries import _code
from quillon.plans.source_queries import _event_stream, _run
from quillon.plans.text_queries import norm
from quillon.streaming import job_logs as J

_COMMANDS = ["run --fast in.txt > out.txt ", "tool2 <input> -v 3 ", "Run the model ", "sort a.csv ", "x = 3 4 ", "make ", "solver.exe -n 4 --grid mesh_01.dat /tmp/out ", "DO10I = K(I,J)+2.5D0 ", ""]
_COMMAND_SQL = "([" + ", ".join(f"'{c}'" for c in _COMMANDS) + "])[(doc_id + block_idx) % 9 + 1]"


def _matches(token: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({token}, '{p}')" for p in patterns) + ")"


_OPERATOR = "list_contains([" + ", ".join(f"'{o}'" for o in C.COMMAND_OPERATORS) + "], {0})"
_LONG = "len(list_filter(regexp_extract_all({0}, '[A-Za-z]+(?:[-''][A-Za-z]+)?'), lambda w: length(w) >= 3))"
_HEADED = f"regexp_matches(ts[1], '{C.COMMAND_HEAD}') AND (lower(ts[1]) = ts[1] OR regexp_matches(ts[1], '[\\p{{N}}.-]'))"

#: from src (doc_id, item_id, ln, s): cut with the prefix, and whether a line is a command or prose
_PREFIXES = f"""split AS (SELECT doc_id, item_id, ln, s, list_filter(string_split_regex(s, '\\s+'), lambda x: x <> '') AS ts FROM src),
tok AS (SELECT doc_id, item_id, ln, i, ts[i] AS x, CASE WHEN i > 1 THEN ts[i - 1] END AS before FROM split, unnest(range(1, len(ts) + 1)) AS u(i)),
seen AS (SELECT *, {_matches("x", C.COMMAND_FLAG)} AS flag, {_matches("x", C.COMMAND_FILE)} AS file, {_matches("x", C.COMMAND_ARGUMENT)} AS arg, {_matches("x", C.COMMAND_NUMBER)} AS num, {_OPERATOR.format("x")} AS op, {_matches("x", "[/\\\\=]")} AS path,
 coalesce({_matches("before", C.COMMAND_FLAG)} OR {_OPERATOR.format("before")}, false) AS asked FROM tok),
stop AS (SELECT doc_id, item_id, ln, coalesce(min(i) FILTER (i > 1 AND NOT (flag OR file OR arg OR num OR op OR path OR contains(x, '_') OR asked)), max(i) + 1) - 1 AS n FROM seen GROUP BY ALL),
worth AS (SELECT doc_id, item_id, ln, n, 2 * max(CAST(flag AND i > 1 AND i <= n AS INT)) + 2 * max(CAST(file AND i > 1 AND i <= n AS INT)) + 2 * max(CAST(arg AND i > 1 AND i <= n AS INT)) + 2 * max(CAST(op AND i <= n AS INT))
 + CASE WHEN count(*) FILTER (num AND i > 1 AND i <= n) >= 2 THEN 1 ELSE 0 END + max(CAST(path AND i > 1 AND i <= n AS INT)) AS evidence, bool_or(flag) OR count(*) FILTER (file OR num) >= 2 OR bool_or(op) AS signs FROM seen JOIN stop USING (doc_id, item_id, ln) GROUP BY ALL),
cut AS (SELECT doc_id, item_id, ln, s, coalesce({_HEADED}, false) AS headed, coalesce(signs, false) AS signs,
 CASE WHEN len(ts) >= 3 AND {_HEADED} AND n >= 3 AND evidence + CAST(regexp_matches(ts[1], '[\\p{{N}}.-]') AS INT) >= 2 AND {_LONG.format("array_to_string(ts[n + 1:], ' ')")} >= 6 THEN array_to_string(ts[1:n], ' ') ELSE '' END AS prefix FROM split LEFT JOIN worth USING (doc_id, item_id, ln))"""


@query("f12_command_prefix", f"WITH {ITEMS}, src AS (SELECT doc_id, item_id, 0 AS ln, {_COMMAND_SQL} || text AS s FROM items), {_PREFIXES} SELECT doc_id, item_id, prefix FROM cut")
def command_prefix(t):
    text = F.concat(cycle(_COMMANDS, F.col("doc_id") + F.col("block_idx")), F.col("text"))
    return dealt(items(t.documents)).select("doc_id", "item_id", C.command_prefix(text).alias("prefix"))


_CODE_TOKENS = "len(list_filter(string_split(s, ' '), lambda x: regexp_matches(x, '[(){}\\[\\]=*<>+/,;:]|^[A-Z][A-Z0-9_.-]{3,}$|_|[A-Za-z].*\\d|\\d.*[A-Za-z]')))"
_LOOP = f"(length(s) >= 24 AND NOT regexp_matches(s, '[一-鿿]') AND len(string_split(s, ' ')) BETWEEN 2 AND 64 AND regexp_matches(s, '(?i)\\bDO\\d+[A-Z]\\s*=') AND {_CODE_TOKENS} >= 2)"
_PROSE_LINE = f"({_LONG.format('s')} >= 6 AND length(regexp_replace(s, '[^\\p{{L}}]', '', 'g')) >= 24)"


@query(
    "f33_mixed_decision",
    f"WITH {ITEMS}, made AS (SELECT *, {_COMMAND_SQL} AS cmd FROM items), src AS (SELECT doc_id, item_id, 0 AS ln, {norm('cmd || text')} AS s FROM made UNION ALL SELECT doc_id, item_id, 1, cmd FROM made WHERE block_idx % 3 = 0 UNION ALL SELECT doc_id, item_id, 2, text FROM made WHERE block_idx % 3 = 0 UNION ALL SELECT doc_id, item_id, 1, cmd || text FROM made WHERE block_idx % 3 <> 0), {_PREFIXES}, "
    f"mixed AS (SELECT doc_id, item_id, bool_or(prefix <> '' OR (headed AND signs)) AND bool_or({_PROSE_LINE}) AS mixed FROM cut WHERE ln > 0 GROUP BY ALL), "
    f"rule AS (SELECT doc_id, item_id, prefix, s = '' OR {_code('s')} OR {_LOOP} AS literal, NOT mixed AND {_LONG.format('s')} >= 8 AS plain, len(list_filter(string_split(s, ' '), lambda x: regexp_matches(x, '\\p{{L}}') AND length(x) >= 3)) >= 8 AS worded FROM cut JOIN mixed USING (doc_id, item_id) WHERE ln = 0) "
    "SELECT doc_id, item_id, CASE WHEN literal THEN 'keep_all' WHEN prefix <> '' THEN 'translate_tail' WHEN plain OR worded THEN 'translate_all' ELSE 'keep_all' END AS action, CASE WHEN literal THEN '' ELSE prefix END AS prefix, CASE WHEN literal OR prefix <> '' OR plain THEN 'local' ELSE 'fallback' END AS decided_by FROM rule",
)
def mixed_decision(t):
    """A command's line and a text, on one line or on two."""
    cmd = cycle(_COMMANDS, F.col("doc_id") + F.col("block_idx"))
    text = F.concat(cmd, F.col("text"))
    lines = F.when(F.col("block_idx") % 3 == 0, F.array(cmd, F.col("text"))).otherwise(F.array(text))
    found = dealt(items(t.documents)).select("doc_id", "item_id", C.local_decision(text, lines).alias("d"))
    return found.select("doc_id", "item_id", "d.action", "d.prefix", F.col("d.by").alias("decided_by"))


# A provider's groups over blocks, some suppressed by column signals, some without an order
_GLOBAL_ID = "CASE WHEN block_idx % 10 IN (7, 8, 9) THEN ' G#' || (block_idx // 10) || ' ' WHEN block_idx % 10 = 5 THEN '##' END"
_LOCAL_ID = "CASE WHEN block_idx % 10 IN (1, 2) THEN CAST(block_idx // 10 AS VARCHAR) WHEN block_idx % 10 = 4 THEN 'one/' || block_idx END"
_RAW_ORDER = "CASE WHEN (doc_id + block_idx) % 23 = 5 THEN 'none' WHEN (doc_id + block_idx) % 31 = 6 THEN NULL ELSE ' ' || (block_idx % 8) END"
_TOKEN = "trim(regexp_replace(trim({0}), '[^A-Za-z0-9_.-]+', '-', 'g'), '-')"


def _raw_groups(t):
    b, d = F.col("block_idx"), F.col("doc_id")
    tens = F.expr("block_idx div 10").cast("string")
    return blocks(t.documents).withColumns({
        "page_index": F.col("page_idx"), "order": b % 8,
        "raw_global_group_id": F.when(b % 10 >= 7, F.concat(F.lit(" G#"), tens, F.lit(" "))).when(b % 10 == 5, "##"),
        "raw_group_id": F.when((b % 10).isin(1, 2), tens).when(b % 10 == 4, F.concat(F.lit("one/"), b.cast("string"))),
        "raw_block_order": F.when((d + b) % 23 == 5, "none").when((d + b) % 31 != 6, F.concat(F.lit(" "), (b % 8).cast("string"))),
        "merge_suspected": (d + F.expr("block_idx div 10")) % 13 == 3, "order_unreliable": F.lit(None).cast("boolean"), "body_repaired": (d + b) % 29 == 7,
    })


@query(
    "s08_provider_hints",
    f"WITH {BLOCKS}, r AS (SELECT *, coalesce({_TOKEN.format(_GLOBAL_ID)}, '') AS g, coalesce({_TOKEN.format(_LOCAL_ID)}, '') AS l, CASE WHEN regexp_matches(trim({_RAW_ORDER}), '^-?[0-9]+$') THEN CAST(trim({_RAW_ORDER}) AS BIGINT) END AS o, (doc_id + block_idx // 10) % 13 = 3 AS merged, (doc_id + block_idx) % 29 = 7 AS repaired FROM blocks), "
    "k AS (SELECT *, CASE WHEN g <> '' THEN 'provider-paddle-global-' || g WHEN l <> '' THEN printf('provider-paddle-page-%03d-group-%s', page_idx + 1, l) ELSE '' END AS grp FROM r), "
    "w AS (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY doc_id, grp ORDER BY page_idx, coalesce(o, -1), block_idx % 8) AS place, bool_or(merged OR repaired) OVER p AS signal, bool_or(o IS NULL) OVER p AS open, min(page_idx) OVER p <> max(page_idx) OVER p AS pages FROM k WINDOW p AS (PARTITION BY doc_id, grp)), "
    "h AS (SELECT *, grp <> '' AND NOT signal AND NOT (n > 1 AND open) AS hinted FROM w) "
    "SELECT doc_id, item_id, CASE WHEN hinted THEN 'provider' ELSE '' END AS hint_source, CASE WHEN hinted THEN grp ELSE '' END AS hint_group, CASE WHEN NOT hinted THEN '' WHEN n = 1 THEN 'single' WHEN place = 1 THEN 'head' WHEN place = n THEN 'tail' ELSE 'middle' END AS hint_role, "
    "CASE WHEN NOT hinted THEN '' WHEN pages THEN 'cross_page' ELSE 'intra_page' END AS hint_scope, CASE WHEN hinted THEN coalesce(o, -1) ELSE -1 END AS hint_order, CASE WHEN hinted THEN 0.98 ELSE 0.0 END AS hint_confidence, grp <> '' AND signal AS suppressed, CASE WHEN grp = '' OR NOT signal THEN '' WHEN repaired THEN 'body_repair_applied' ELSE 'cross_column_merge_suspected' END AS suppressed_reason FROM h",
)
def provider_hints(t):
    """Groups over a page break, within a page and of one block; suppressed ones; ones without an order."""
    hinted = N.provider_hints(_raw_groups(t), ["doc_id"])
    return hinted.select("doc_id", "item_id", "hint_source", "hint_group", "hint_role", "hint_scope", "hint_order", "hint_confidence", "suppressed", "suppressed_reason")


_KINDS = ["text", "image", "text", "table", "text", "formula", "text", "text"]
_SUBS = ["", "image_body", "", "table_html", "", "", "", "body"]
_NOTES = ["Note on figure ", "表注 ", "see Table ", "", "图注 ", " "]


@query(
    "s08_relations",
    f"WITH {BLOCKS}, k AS (SELECT *, ([{', '.join(repr(x) for x in _KINDS)}])[(3 * doc_id + 5 * block_idx) % 8 + 1] AS kind, ([{', '.join(repr(x) for x in _SUBS)}])[(3 * doc_id + 5 * block_idx) % 8 + 1] AS sub, CASE block_idx % 4 WHEN 2 THEN ' Figure_Title' WHEN 3 THEN 'vision_footnote' ELSE 'text' END AS label, ([{', '.join(repr(x) for x in _NOTES)}])[(doc_id + block_idx) % 6 + 1] || text AS note FROM blocks), "
    "a AS (SELECT *, lower(trim(note)) AS low, last_value(CASE WHEN kind IN ('image', 'table', 'code', 'formula') THEN coalesce(nullif(sub, ''), kind) END IGNORE NULLS) OVER (PARTITION BY doc_id, page_idx ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM k) "
    "SELECT doc_id, item_id, CASE lower(trim(label)) WHEN 'figure_title' THEN 'figure' WHEN 'vision_footnote' THEN CASE WHEN starts_with(low, '表注') OR contains(low, 'table') THEN 'table' WHEN starts_with(low, '图注') OR contains(low, 'figure') THEN 'image' WHEN anchor IN ('table_html', 'table') THEN 'table' WHEN anchor IN ('image_body', 'image') THEN 'image' ELSE 'unknown' END END AS target FROM a",
)
def provider_relations(t):
    """Captions and footnotes with their target, named or the anchor before them on the page."""
    b, at = F.col("block_idx"), 3 * F.col("doc_id") + 5 * F.col("block_idx")
    label = F.when(b % 4 == 2, " Figure_Title").when(b % 4 == 3, "vision_footnote").otherwise("text")
    made = blocks(t.documents).withColumns({"kind": cycle(_KINDS, at), "sub_kind": cycle(_SUBS, at), "label": label, "text": F.concat(cycle(_NOTES, F.col("doc_id") + b), F.col("text"))})
    return N.relations(made, ["doc_id", "page_idx"], "block_idx").select("doc_id", "item_id", "target")


_ROLE = "CASE WHEN block_idx % 8 = 7 THEN CASE WHEN doc_id % 6 = 0 THEN 'middle' WHEN doc_id % 2 = 0 THEN ' Tail' ELSE 'single' END WHEN block_idx % 8 = 0 THEN CASE WHEN doc_id % 7 = 0 THEN 'middle' ELSE 'head' END ELSE 'middle' END"
_MODE = "CASE WHEN doc_id % 3 = 0 THEN 'double' WHEN doc_id % 3 = 1 THEN 'single' ELSE '' END"
_ZONE = "CASE WHEN doc_id % 3 = 0 THEN CASE WHEN block_idx % 8 >= 4 THEN 'right_column' ELSE 'left_column' END WHEN doc_id % 11 = 4 THEN 'header' WHEN doc_id % 3 = 1 THEN 'single_column' ELSE 'full_width' END"
_READING = "CASE WHEN (doc_id + block_idx // 4) % 9 = 2 THEN CASE block_idx % 4 WHEN 1 THEN NULL ELSE block_idx END WHEN (doc_id + block_idx // 4) % 9 = 5 THEN block_idx // 2 WHEN (doc_id + block_idx // 4) % 9 = 7 THEN 100 - block_idx ELSE block_idx END"
_VALID_GROUP = "(block_idx + 2) // 4 * 2 + CASE WHEN (block_idx + 2) % 16 = 3 THEN 1 ELSE 0 END"


@query(
    "w06_group_validity",
    f"WITH {BLOCKS}, i AS (SELECT doc_id, {_VALID_GROUP} AS grp, page_idx, block_idx, {_READING} AS o, lower(trim({_ROLE})) AS role, {_MODE} AS mode, {_ZONE} AS zone, length(regexp_replace(CASE WHEN doc_id % 5 = 0 THEN left(text, 20) ELSE text END, '\\s+', '', 'g')) AS n FROM blocks), "
    "l AS (SELECT *, lag(page_idx) OVER w AS p0, lag(role) OVER w AS r0, lag(mode) OVER w AS m0, lag(zone) OVER w AS z0, lag(n) OVER w AS n0 FROM i WINDOW w AS (PARTITION BY doc_id, grp ORDER BY coalesce(o, -1), page_idx, block_idx)), "
    "s AS (SELECT *, r0 IN ('tail', 'single') AND role IN ('head', 'single') AND z0 <> 'header' AND zone <> 'header' AND CASE WHEN m0 = 'double' THEN z0 = 'right_column' ELSE z0 IN ('single_column', 'full_width') END AND CASE WHEN mode = 'double' THEN zone = 'left_column' ELSE zone IN ('single_column', 'full_width') END AND n0 >= 8 AND n >= 8 AND n0 + n >= 32 AS ok FROM l), "
    "g AS (SELECT doc_id, grp, count(*) AS members, count(*) >= 2 AND bool_and(o IS NOT NULL AND o >= 0) AND count(DISTINCT o) = count(*) AS ordered, max(page_idx) - min(page_idx) AS span, count(*) FILTER (page_idx > p0) AS turns, coalesce(bool_or(page_idx < p0 OR page_idx > p0 + 1), false) AS jumps, coalesce(bool_and(ok) FILTER (page_idx > p0), false) AS meets FROM s GROUP BY ALL) "
    "SELECT doc_id, grp, members, ordered AND span = 0 AS intra_page, ordered AND span = 1 AND turns = 1 AND NOT jumps AND meets AS cross_page FROM g",
)
def group_validity(t):
    """Groups that fail each condition: no or doubled orders, orders against the pages, roles, zones, too little text."""
    sql = lambda s: F.expr(s.replace("//", "div").replace("VARCHAR", "STRING"))
    text = F.when(F.col("doc_id") % 5 == 0, F.left("text", F.lit(20))).otherwise(F.col("text"))
    made = blocks(t.documents).withColumns({"grp": sql(_VALID_GROUP), "reading_order": sql(_READING), "boundary_role": sql(_ROLE), "layout_mode": sql(_MODE), "layout_zone": sql(_ZONE), "text": text})
    return N.group_validity(made, ["doc_id", "grp"])


_LEAK_SOURCE = "text || CASE WHEN block_idx % 5 = 0 THEN '.' ELSE '' END || ' where $x_' || (block_idx % 3) || '$' || CASE WHEN block_idx % 4 = 1 THEN '。 ' ELSE ' and' END"
_LEAKED = "left(text, (block_idx * 7) % 40) || CASE WHEN block_idx % 2 = 0 THEN '。' ELSE '' END || ' 以及 $x_' || (block_idx % 3) || '$，对于 $x_' || ((block_idx + CASE WHEN block_idx % 6 = 2 THEN 0 ELSE 1 END) % 3) || '$ 成立'"
_SPANS = "list_transform(regexp_extract_all({0}, '\\$[^$\\\\\\n]+\\$'), lambda e: trim(e))"


@query(
    "w14_neighbour_leak",
    f"WITH {ITEMS}, m AS (SELECT doc_id, block_idx, item_id, {_LEAK_SOURCE} AS src, {_LEAKED} AS said FROM items), l AS (SELECT *, lead(src) OVER (PARTITION BY doc_id ORDER BY block_idx) AS nx FROM m), "
    f"f AS (SELECT *, CASE WHEN nx IS NOT NULL AND NOT regexp_matches(src, '[.!?。！？；;:：)\\]）】”’\"'']\\s*$') THEN list_filter({_SPANS.format('nx')}, lambda e: NOT list_contains({_SPANS.format('src')}, e) AND contains(said, e)) ELSE [] END AS leaked FROM l), "
    "h AS (SELECT *, list_min(list_transform(leaked, lambda e: instr(said, e))) - 1 AS hit FROM f), c AS (SELECT *, rtrim(regexp_replace(rtrim(left(said, hit)), '[，,、\\s]*(?:在|为|是|等于|对于)\\s*$', '')) AS short, rtrim(regexp_extract(left(said, hit), '^(.*[。！？；])', 1)) AS long FROM h) "
    "SELECT doc_id, item_id, CASE WHEN len(leaked) = 0 THEN said WHEN length(short) >= 8 THEN short WHEN length(long) >= 8 THEN long ELSE said END AS trimmed, len(leaked) > 0 AND greatest(length(short), length(long)) >= 8 AS cut FROM c",
)
def neighbour_leak(t):
    """Translations that speak of the next item's formula, with and without own formulas and sentence ends."""
    made = items(t.documents).withColumns({"src": F.expr(_LEAK_SOURCE), "said": F.expr(_LEAKED)})
    nxt = F.lead("src").over(Window.partitionBy("doc_id").orderBy("block_idx"))
    d = made.withColumn("nx", nxt).withColumn("d", N.trim_leak(F.col("said"), F.col("src"), F.col("nx")))
    return d.select("doc_id", "item_id", F.col("d.text").alias("trimmed"), (F.size("d.leaked") > 0).alias("cut"))


_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')"
_TERM_TAIL = ["图神经网络（又称GNN-v2）和", "滤波器 (or Kalman Filter) 与中心(CNN)", "的方法（The）", "已被证明。", "模型（Spin/Orbit Model v.3）", "被测量的对象（Item）", "检测器（A Very Long Key Name Here）"]
_KEY_EDGES = "[ ,.;:()\\[\\]{}，。；：（）【】]"


def _clean(c: str) -> str:
    return f"left(regexp_replace(regexp_replace({c}, '^{_KEY_EDGES}+', ''), '{_KEY_EDGES}+$', ''), 80)"


_ZH, _EN = "([\\x{4e00}-\\x{9fff}][\\x{4e00}-\\x{9fff}A-Za-z0-9·\\-]{1,24})", "([A-Za-z][A-Za-z0-9 ._+/\\-]{1,48})"
_PAIR_PATTERNS = [f"{_ZH}（(?:或称|又称|简称)?{_EN}）", f"{_ZH}\\((?:or |also known as )?{_EN}\\)", f"{_ZH}（{_EN}）"]
_TECH = "\\b[A-Z][A-Za-z0-9]*(?:[-_/][A-Za-z0-9]+)*(?:\\s+[A-Z][A-Za-z0-9]*(?:[-_/][A-Za-z0-9]+)*){0,3}\\b"


@query(
    "c24_term_candidates",
    f"WITH {ITEMS}, m AS (SELECT doc_id, item_id, {_ASCII} AS src, {norm(f"([{', '.join(repr(x) for x in _TERM_TAIL)}])[(doc_id + block_idx) % 7 + 1] || left(" + _ASCII + ", 30 + block_idx % 60)")} AS said FROM items), "
    + "p AS ("
    + " UNION ALL ".join(f"SELECT doc_id, item_id, unnest(list_zip(regexp_extract_all(said, '{x}', 2), regexp_extract_all(said, '{x}', 1))) AS z FROM m" for x in _PAIR_PATTERNS)
    + f"), e AS (SELECT doc_id, item_id, {_clean('z[1]')} AS key, {_clean('z[2]')} AS value, 'explicit_pair' AS origin, 1.0 AS score FROM p), "
    + f"t AS (SELECT doc_id, item_id, said, unnest(list_transform(regexp_extract_all(src, '{_TECH}')[1:24], lambda x: {_clean(norm('x'))})) AS key FROM m), "
    + "u AS (SELECT * FROM e UNION ALL SELECT doc_id, item_id, key, key, 'identity_technical_token', 0.55 FROM t WHERE contains(lower(said), lower(key))) "
    + "SELECT doc_id, item_id, key, value, origin, CAST(score AS DOUBLE) AS score, len(string_split(key, ' ')) <= 4 AND value <> '' AND (lower(key) = lower(value) OR (NOT regexp_matches(value, '[，。；：、,.!?！？]') AND length(value) <= 12 AND len(regexp_extract_all(value, '[\\x{4e00}-\\x{9fff}]')) <= 8 AND NOT regexp_matches(value, '[的已将被从在这其]'))) AS allowed FROM u "
    + "WHERE length(key) >= 2 AND lower(key) NOT IN ('or', 'and', 'the', 'from', 'with', 'for', 'this', 'that') AND regexp_matches(key, '\\p{L}') AND (origin <> 'explicit_pair' OR regexp_matches(value, '[\\x{4e00}-\\x{9fff}]'))",
)
def term_candidates(t):
    """Pairs that a translation explains and technical tokens that it kept, scored, and whether they may be shown again."""
    made = dealt(items(t.documents)).withColumn("src", F.regexp_replace("text", r"[^\x00-\x7F]", ""))
    made = made.withColumn("said", F.concat(cycle(_TERM_TAIL, F.col("doc_id") + F.col("block_idx")), F.left("src", (30 + F.col("block_idx") % 60).cast("int"))))
    found = made.select("doc_id", "item_id", F.explode(K.candidates(F.col("src"), F.col("said"))).alias("c"))
    return found.select("doc_id", "item_id", "c.key", "c.value", "c.origin", F.col("c.score").cast("double").alias("score"), K.allowed(F.col("c.key"), F.col("c.value")).alias("allowed"))


_JOB_LINES = ["upload done: f%d.pdf", "batch b%d: state=pending", " task t%d: state= running ", "summary: /tmp/%d.json", "plain line %d", "task t%d: state=odd", "output pdf: o%d.pdf", "batch b%d: state=done", "", "output pdf:", "job root: /jobs/%d"]


@query(
    "t08_job_states",
    f"WITH l AS (SELECT user_id AS job_id, event_id AS seq, trim(replace(([{', '.join(repr(x) for x in _JOB_LINES)}])[(event_id * 7) % 11 + 1], '%d', CAST(event_id AS VARCHAR))) AS line FROM events), p AS (SELECT *, regexp_extract(line, '^(summary|output pdf|job root): (.+)$', 1) AS label, regexp_extract(line, '^(summary|output pdf|job root): (.+)$', 2) AS value, regexp_extract(line, '^(batch|task) (.*?): state=', 1) AS kind, regexp_extract(line, '^(batch|task) (.*?): state=', 2) AS owner, trim(regexp_extract(line, ': state=(.*)$', 1)) AS raw FROM l WHERE line <> ''), "
    f"s AS (SELECT *, CASE WHEN starts_with(line, 'upload done: ') THEN 'mineru_processing' WHEN kind <> '' THEN CASE raw WHEN 'done' THEN 'ocr_result_ready' ELSE 'mineru_processing' END END AS stage, CASE WHEN starts_with(line, 'upload done: ') THEN '{J.UPLOADED_STAGE[1]}' WHEN kind <> '' THEN CASE raw {' '.join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in J.STATES.items())} ELSE '{J.OTHER_STATE[1]}' || raw END END AS detail FROM p), "
    "v AS (SELECT job_id, string_agg(label || '=' || value, ';' ORDER BY label) AS artifacts FROM (SELECT job_id, label, arg_max(value, seq) AS value FROM s WHERE label <> '' GROUP BY ALL) GROUP BY job_id) "
    "SELECT CAST(job_id AS VARCHAR) AS job_id, arg_max(stage, seq) FILTER (stage IS NOT NULL) AS stage, arg_max(detail, seq) FILTER (stage IS NOT NULL) AS detail, arg_max(owner, seq) FILTER (kind = 'batch') AS batch_id, arg_max(owner, seq) FILTER (kind = 'task') AS task_id, count(*) AS lines, array_to_string(list(line ORDER BY seq)[-40:], '|') AS tail, any_value(coalesce(v.artifacts, '')) AS artifacts FROM s LEFT JOIN v USING (job_id) GROUP BY job_id",
)
def job_state_stream(t):
    """Every job's stage, ids, artifacts and last 40 lines, kept by a stream over the event file."""
    line = F.replace(cycle(_JOB_LINES, F.col("event_id") * 7), F.lit("%d"), F.col("event_id").cast("string"))
    lines = _event_stream(t).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), line.alias("line"))
    s = _run(t, J.stream_states(lines), "update", ("job_id",))
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("artifacts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return s.select("job_id", "stage", "detail", "batch_id", "task_id", "lines", F.array_join("tail", "|").alias("tail"), F.coalesce(pairs, F.lit("")).alias("artifacts"))


# typography: lines, fonts and leadings of blocks by formula
_LINES = "block_idx % 6 + CASE WHEN doc_id % 7 = 0 OR block_idx % 8 = 6 THEN -9 ELSE 0 END"
_LINE_HEIGHT = "CASE WHEN block_idx % 9 = 8 THEN 0.0 ELSE 6.5 + doc_id % 5 END"
_LINE_PITCH = "9.0 + block_idx % 7 - CASE WHEN block_idx % 11 = 3 THEN 12 ELSE 0 END"


def _lined(t):
    k = lambda c: F.expr(c.replace("//", "div"))
    b = blocks(t.documents).withColumns({"n": k(_LINES), "h": k(_LINE_HEIGHT), "p": k(_LINE_PITCH)})
    span = lambda kind, content: F.struct(F.lit(kind).alias("type"), content.alias("content"))

    def line(i):
        top = F.col("y0") + i * F.col("p")
        words = span("text", F.substring("text", 1, (20 + (i * 7 + F.col("block_idx")) % 30).cast("int")))
        maths = F.when((F.col("block_idx") + i) % 4 < F.col("doc_id") % 5, F.array(words, span("inline_equation", F.lit("x")), span("inline_equation", F.lit("y")))).otherwise(F.array(words))
        right = F.col("x0") + (F.col("x1") - F.col("x0")) * (F.lit(0.5) + (i * 3 + F.col("block_idx")) % 5 * F.lit(0.12))
        return F.struct("x0", top.cast("double").alias("y0"), right.alias("x1"), (top + F.col("h")).cast("double").alias("y1"), maths.alias("spans"))

    lines = F.transform(F.when(F.col("n") > 0, F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).otherwise(F.array().cast("array<int>")), line)
    return b.select("doc_id", "page_idx", "block_idx", F.col("block_type").alias("kind"), (F.col("sub_type") == "footnote").alias("footnote"), (F.col("sub_type") == "figure_caption").alias("caption"), "item_id", "x0", "y0", "x1", "y1", F.col("text"), lines.alias("lines"))


_BASELINE = (
    f"{BLOCKS}, b AS (SELECT *, greatest(0, {_LINES}) AS n, {_LINE_HEIGHT} AS h, {_LINE_PITCH} AS p, sub_type IN ('footnote', 'figure_caption') AS note, block_type = 'text' AND sub_type NOT IN ('footnote', 'figure_caption') AS text_item, length(regexp_replace(text, '\\s+', '', 'g')) AS seen FROM blocks), "
    "l AS (SELECT doc_id, page_idx, block_idx, k, x1 - x0 AS box, (x1 - x0) * CAST(0.5 + (k * 3 + block_idx) % 5 * 0.12 AS DOUBLE) AS wide, n, y0 + k * p AS a, y0 + k * p + h AS z, length(regexp_replace(left(text, 20 + (k * 7 + block_idx) % 30), '\\s+', '', 'g')) AS chars, CASE WHEN (block_idx + k) % 4 < doc_id % 5 THEN 2 ELSE 0 END AS f FROM b, unnest(range(n)) AS u(k)), "
    "d AS (SELECT *, (a + z) / 2 - lag((a + z) / 2) OVER (PARTITION BY doc_id, page_idx, block_idx ORDER BY k) AS step FROM l), "
    "m AS (SELECT doc_id, page_idx, block_idx, coalesce(median(z - a) FILTER (z - a > 0), 0) AS height, coalesce(median(step) FILTER (step > 0), 0) AS pitch, max(z) - min(a) AS raw, coalesce(median(chars) FILTER (chars > 0), 0) AS per_line, sum(f) / (sum(f) + count(*)) AS ratio, median(wide) FILTER (k < n - 1 OR n = 1) / any_value(box) AS across, sum(z - a) AS stacked FROM d GROUP BY ALL), "
    "w AS (SELECT doc_id, page_idx, median(x1 - x0) FILTER (text_item) AS wide FROM b GROUP BY ALL), "
    "i AS (SELECT b.*, wide, coalesce(height, 0) AS height, coalesce(pitch, 0) AS pitch, coalesce(per_line, 0) AS per_line, coalesce(ratio, 0) AS ratio, coalesce(across, 0) AS across, coalesce(stacked, 0) / (y1 - y0) AS down, CASE WHEN n > 0 AND raw > 0 THEN least(y1 - y0, raw + CASE WHEN height > 0 THEN least(2.2, height * 0.22) ELSE 0 END) ELSE y1 - y0 END / greatest(1, n) AS local, "
    "text_item AND n >= 3 AND seen >= 40 AND coalesce(ratio, 0) <= 0.5 AND NOT (wide > 0 AND x1 - x0 < wide * 0.6) AS chosen FROM b JOIN w USING (doc_id, page_idx) LEFT JOIN m USING (doc_id, page_idx, block_idx)), "
    "c AS (SELECT *, CASE WHEN local > 0 THEN local ELSE pitch END AS lp, CASE WHEN height > 0 THEN height * 0.98 WHEN pitch > 0 THEN pitch * 0.82 ELSE 0 END AS metric FROM i), "
    "g AS (SELECT doc_id, page_idx, coalesce(quantile_cont(lp, 0.42) FILTER (chosen AND lp > 0), 0) AS p, coalesce(quantile_cont(height, 0.42) FILTER (chosen AND height > 0), 0) AS h, coalesce(quantile_cont(metric, 0.42) FILTER (chosen AND metric > 0), 0) AS m, coalesce(median(per_line) FILTER (chosen AND per_line > 0), 0) AS d FROM c GROUP BY ALL), "
    "r AS (SELECT *, CASE WHEN m > 0 THEN m WHEN h > 0 THEN h * 0.98 ELSE p * 0.82 END AS metric FROM g), "
    "base AS (SELECT doc_id, page_idx, CASE WHEN metric > 0 THEN greatest(8.4, least(14.2, metric * 0.9215)) ELSE 11.4 END AS font_size, CASE WHEN metric > 0 THEN p ELSE 0 END AS line_pitch, CASE WHEN metric > 0 THEN h ELSE 0 END AS line_height, CASE WHEN metric > 0 THEN d ELSE 0 END AS chars_per_line FROM r)"
)


@query("a11_font_baseline", f"WITH {_BASELINE} SELECT doc_id, page_idx, round_even(font_size, 6) AS font_size, round_even(line_pitch, 6) AS line_pitch, round_even(line_height, 6) AS line_height, round_even(chars_per_line, 6) AS chars_per_line FROM base")
def font_baseline(t):
    """Four measures a page, with pages without lines, lines without height and against the order."""
    six = lambda c: F.bround(c, 6).alias(c)
    return Y.page_baseline(_lined(t), ["doc_id", "page_idx"]).select("doc_id", "page_idx", six("font_size"), six("line_pitch"), six("line_height"), six("chars_per_line"))


_SEEDS = (
    f"{_BASELINE}, q AS (SELECT c.*, font_size, line_pitch, line_height, block_type = 'text' OR note AS textual, CASE WHEN seen < 36 THEN 0 ELSE least(0.7, CASE WHEN seen >= 52 THEN least(0.22, (seen - 52) / 220.0) ELSE 0 END + CASE WHEN greatest(1, n) >= 3 THEN least(0.3, (greatest(1, n) - 2) * 0.08) ELSE 0 END + CASE WHEN across >= 0.76 THEN least(0.24, (across - 0.76) / 0.16 * 0.24) ELSE 0 END + CASE WHEN down >= 0.4 THEN least(0.12, (down - 0.4) / 0.24 * 0.12) ELSE 0 END + CASE WHEN ratio >= 0.08 THEN 0.08 ELSE 0 END) END AS compact, "
    "coalesce(NOT note AND (block_type = 'text' OR block_idx % 5 = 0) AND block_idx % 12 <> 7 AND ratio <= 0.5 AND (NOT (wide > 0 AND x1 - x0 < wide * 0.75) OR (block_idx % 3 <> 1 AND seen >= 36 AND greatest(1, n) >= 2)) AND seen >= 40, false) AS body FROM c JOIN base USING (doc_id, page_idx)), "
    "lf AS (SELECT *, CASE WHEN NOT textual OR metric <= 0 THEN 11.4 WHEN sub_type = 'footnote' THEN round_even(greatest(6.6, least(14.2, metric * 0.9215 * 0.78)), 2) WHEN sub_type = 'figure_caption' THEN round_even(greatest(8.4, least(14.2, metric * 0.9215 * 0.92)), 2) ELSE round_even(greatest(8.4, least(14.2, metric * 0.9215)), 2) END AS own FROM q), "
    "pe AS (SELECT *, font_size * greatest(0.97, least(1.03, CASE WHEN line_pitch > 0 AND lp > 0 THEN lp / line_pitch WHEN line_height > 0 AND height > 0 THEN height / line_height ELSE 1 END)) AS page_est, greatest(0.74, 0.86 - compact * 0.18) AS weight FROM lf), "
    "sf AS (SELECT *, CASE WHEN NOT textual THEN 11.4 WHEN body THEN round_even(greatest(8.4, least(14.2, (page_est * weight + own * (1 - weight)) * (1 - least(0.04, compact * 0.055)))), 2) ELSE own END AS seed FROM pe), "
    "sl AS (SELECT *, CASE WHEN body THEN round_even(greatest(0.44, least(0.68, greatest((CASE WHEN CASE WHEN lp > 0 THEN lp ELSE line_pitch END > 0 THEN (CASE WHEN lp > 0 THEN lp ELSE line_pitch END / seed - 1) * 0.35 + greatest(0.5, 0.56 - compact * 0.07) * 0.65 ELSE greatest(0.5, 0.56 - compact * 0.07) END) * 0.988 * (1 - least(0.015, compact * 0.07)), 0.52 * 0.988, CASE WHEN across >= 0.86 THEN 0.44 / 0.9 ELSE 0 END, CASE WHEN ratio >= 0.08 THEN 0.44 / 0.92 ELSE 0 END))), 2) "
    "ELSE round_even(greatest(0.26, least(0.56, greatest((CASE WHEN lp > 0 THEN (lp / seed - 1) * 0.55 + 0.48 * 0.45 ELSE 0.48 END) * 0.988, CASE WHEN across >= 0.9 THEN 0.26 / 0.9 ELSE 0 END, CASE WHEN ratio >= 0.12 THEN 0.26 / 0.92 ELSE 0 END))), 2) END AS lead_em FROM sf)"
)


def _seeded(t):
    b = F.col("block_idx")
    textual = (F.col("kind") == "text") | F.col("footnote") | F.col("caption")
    body = Y.body_candidate(F.col("kind") == "text", F.when(b % 5 == 0, "paragraph").otherwise("table"), F.when(b % 12 == 7, "reference").otherwise("body"), b % 3 != 1)
    return Y.seed_metrics(_lined(t), ["doc_id", "page_idx"], textual, body, digits=6)


@query("m11_seed_type", f"WITH {_SEEDS} SELECT doc_id, item_id, round_even(seed, 2) AS font_size, round_even(lead_em, 2) AS leading FROM sl")
def seed_type(t):
    """Fonts and leadings of body text, captions, footnotes and tables, with and without lines."""
    return _seeded(t).select("doc_id", "item_id", F.bround("seed_font", 2).alias("font_size"), F.bround("seed_leading", 2).alias("leading"))


@query(
    "a12_seed_metrics",
    f"WITH {_SEEDS}, pb AS (SELECT doc_id, page_idx, quantile_cont(seed, 0.46) FILTER (body) AS font, median(x1 - x0) FILTER (body) AS width FROM sl GROUP BY ALL) SELECT doc_id, item_id, body AS is_body, CASE WHEN font IS NOT NULL THEN round_even(greatest(font, font_size - 0.38), 6) END AS page_body_font, width AS page_body_width, round_even(wide, 6) AS page_text_width FROM sl JOIN pb USING (doc_id, page_idx)",
)
def page_seed_metrics(t):
    wide = F.median(F.when((F.col("kind") == "text") & ~F.col("footnote") & ~F.col("caption"), F.col("x1") - F.col("x0"))).over(Window.partitionBy("doc_id", "page_idx"))
    return _seeded(t).select("doc_id", "item_id", "is_body", "page_body_font", "page_body_width", F.bround(wide, 6).alias("page_text_width"))


_FONT = "CASE WHEN block_idx % 13 = 12 THEN 0.0 ELSE 8.0 + (doc_id + block_idx) % 9 * 0.5 END"
_LEADING = "0.2 + (block_idx % 5) * 0.1"
_DENSE = "(doc_id + block_idx) % 6 = 1 OR doc_id % 9 = 4"
_CONTEXT = "block_type = 'text' AND sub_type NOT IN ('title', 'footnote', 'figure_caption')"
_BOTTOM = "y1 + CASE WHEN (doc_id + block_idx) % 4 = 0 THEN 90 ELSE 0 END"
_PAYLOAD = f"""w AS (SELECT doc_id, page_idx, median(x1 - x0) FILTER (block_type = 'text') AS wide FROM blocks GROUP BY ALL),
b AS (SELECT doc_id, page_idx, block_idx, item_id, x0, y0, x1, {_BOTTOM} AS y1, CAST({_FONT} AS DOUBLE) AS font, CAST({_LEADING} AS DOUBLE) AS lead_em, CAST(length(text) AS DOUBLE) AS demand, CASE WHEN block_idx % 7 = 0 THEN 0.93 ELSE 1.0 END AS discount, ({_DENSE}) AS dense, ({_CONTEXT}) AS context, length(trim(text)) AS chars, wide FROM blocks JOIN w USING (doc_id, page_idx) WHERE block_idx % 3 <> 2),
e AS (SELECT *, greatest(0, x1 - x0) AS width, greatest(0, y1 - y0) AS height, greatest(1, ceil(demand / greatest(greatest(4.0, greatest(8.0, x1 - x0) / greatest(font * 0.92, 1.0)) * 0.98, 1.0))) AS lines FROM b),
n AS (SELECT *, font * lines * (1 + greatest(0, lead_em)) AS nat FROM e), r AS (SELECT *, CASE WHEN context AND NOT dense AND font > 0 AND lines >= 3 AND height >= 35 AND nat > 0 THEN height / nat END AS ratio FROM n),
p AS (SELECT *, greatest(1.0, median(ratio) OVER (PARTITION BY doc_id, page_idx)) AS ref, least(height, greatest(height * 0.58, nat * 1.45)) AS part FROM r),
dd AS (SELECT *, greatest(8.0, CASE WHEN ratio >= 1.8 AND ratio >= ref * 1.35 AND part < height - 0.5 THEN round(part, 2) ELSE y1 - y0 END) AS dh FROM p),
x AS (SELECT *, lines * greatest(font * 1.02, font * (1 + lead_em)) * discount / dh AS density FROM dd)"""


def _payloads(t):
    b = blocks(t.documents)
    wide = F.median(F.when(F.col("block_type") == "text", F.col("x1") - F.col("x0"))).over(Window.partitionBy("doc_id", "page_idx"))
    made = b.withColumn("wide", wide).filter("block_idx % 3 != 2").withColumns({
        "font": F.expr(_FONT).cast("double"), "leading": F.expr(_LEADING).cast("double"), "demand": F.length("text").cast("double"), "discount": F.when(F.col("block_idx") % 7 == 0, 0.93).otherwise(1.0),
        "dense": F.expr(_DENSE), "context": F.expr(_CONTEXT), "text_chars": F.length(F.trim("text")), "y1": F.expr(_BOTTOM).cast("double"),
    })
    return made.select("doc_id", "page_idx", "block_idx", "item_id", "x0", "y0", "x1", "y1", "font", "leading", "demand", "discount", "dense", "context", "text_chars", "wide")


@query("a15_body_targets", f"WITH {BLOCKS}, {_PAYLOAD} SELECT doc_id, page_idx, coalesce(median(font) FILTER (NOT dense), median(font)) AS font, round_even(greatest(0.82, least(0.92, median(density))), 6) AS density, round_even(median(demand / greatest(1.0, greatest(8.0, x1 - x0) * dh)), 6) AS pressure FROM x GROUP BY ALL")
def body_targets(t):
    """Fonts, densities and pressures, on pages where all boxes are dense, too, and with boxes much taller than their text."""
    d = Y.body_targets(_payloads(t), ["doc_id", "page_idx"])
    return d.select("doc_id", "page_idx", "font", F.bround("density", 6).alias("density"), F.bround("pressure", 6).alias("pressure"))


@query(
    "l09_anchors",
    f"WITH {BLOCKS}, {_PAYLOAD}, f AS (SELECT *, context AND font > 0 AND NOT dense AND width >= greatest(1.0, wide * 0.58) AND height >= 30 AND density <= 1.18 AS best, context AND font > 0 AND width >= greatest(1.0, wide * 0.72) AND height >= 18 AS other FROM x), "
    "s AS (SELECT *, count(*) FILTER (best) OVER (PARTITION BY doc_id, page_idx) AS n, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY best DESC, height * 2 + width * 0.25 + least(180, chars) DESC, block_idx) AS rank FROM f) "
    "SELECT doc_id, page_idx, item_id, CASE WHEN n >= 2 THEN rank END AS rank FROM s WHERE (n >= 2 AND best AND rank <= 2) OR (n < 2 AND other)",
)
def anchors(t):
    """The two best boxes of a page, or the fallback where fewer qualify."""
    return Y.stable_anchors(_payloads(t), ["doc_id", "page_idx"], "block_idx", "wide").select("doc_id", "page_idx", "item_id", "rank")


_WIDTH20 = "(x1 - x0) * CASE block_idx % 7 WHEN 3 THEN 0.5 WHEN 5 THEN 0.75 WHEN 6 THEN 0.0 ELSE 1.0 END"


@query(
    "w20_narrow_boxes",
    f"WITH {BLOCKS}, g AS (SELECT doc_id, block_idx // 5 AS grp, block_idx, item_id, {_WIDTH20} AS w, 10.0 + block_idx % 9 AS capacity FROM blocks), l AS (SELECT *, lag(w) OVER k AS a, lead(w) OVER k AS z FROM g WINDOW k AS (PARTITION BY doc_id, grp ORDER BY block_idx)) "
    "SELECT doc_id, item_id, round_even(CASE WHEN w > 0 AND a > 0 AND z > 0 AND w < (a + z) / 2 * 0.78 THEN capacity * greatest(w / ((a + z) / 2), 0.72) ELSE capacity END, 6) AS capacity FROM l",
)
def narrow_boxes(t):
    """Capacities of boxes within groups, some narrow, some without width, at the edges unchanged."""
    g = blocks(t.documents).select("doc_id", "item_id", "block_idx", F.expr("block_idx div 5").alias("grp"), F.expr(_WIDTH20).cast("double").alias("w"), (10.0 + F.col("block_idx") % 9).alias("capacity"))
    return Y.relaxed_capacity(g, ["doc_id", "grp"], "block_idx", "w", "capacity").select("doc_id", "item_id", F.bround("relaxed", 6).alias("capacity"))
