"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import block_names, bpe, decontaminate, divergence, gated_lm, jaccard, kneser_ney, langid, merkle, quality, quality_sql, sharding, site_style, token_files
from quillon.llm.common import documents, remainder


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs, "text", "lang", "doc_id", ~held)
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), "text", model).drop("text")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(documents(spark, sf_dir), 8)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return dealt.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.search(documents(spark, sf_dir), items, width=5, percent=80)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_files.count(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)
    return counted.select("doc_id", "n_tokens")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(documents(spark, sf_dir), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), "text", public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kneser_ney.judge(documents(spark, sf_dir), kneser_ney.trusted_ids(labels), carry=["doc_id", "lang"], toxic=kneser_ney.toxic_ids(labels))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = site_style.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.score(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves presented with one character more where 7 divides the id's crc32."""
    docs = documents(spark, sf_dir)
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    presented = F.when(remainder(F.col("doc_id"), 7) == 0, merkle.leaf(*(fields | {"n_chars": F.col("n_chars") + 1}).values()))
    return merkle.manifest(docs, list(fields.values()), "lang", "doc_id", claimed=presented, carry=["doc_id"]).select("doc_id", *merkle.RESULTS)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.dedup(documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


SQL3 = r"""
WITH words AS (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
items AS (SELECT item_id, row_number() OVER () AS ir, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
widths AS (SELECT DISTINCT least(5, len(ws)) AS k FROM items WHERE len(ws) > 0),
held AS (SELECT DISTINCT doc_id, rn, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM words, widths, unnest(range(1, greatest(1, len(ws) - k + 2))) AS u(i)),
wanted AS (SELECT DISTINCT item_id, ir, least(5, len(ws)) AS k, array_to_string(ws[i:i + 4], ' ') AS g FROM items, unnest(range(1, greatest(2, len(ws) - 3))) AS u(i) WHERE len(ws) > 0),
sized AS (SELECT *, count(*) OVER (PARTITION BY ir) AS n_item FROM wanted)
SELECT doc_id, item_id, n_item, count(*) AS n_found FROM held JOIN sized USING (g, k) GROUP BY doc_id, rn, item_id, ir, n_item HAVING 100 * count(*) >= 80 * n_item"""

SQL6 = r"""
WITH RECURSIVE words AS (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT DISTINCT rn, array_to_string(ws[i:i + 2], ' ') AS g FROM words, unnest(range(1, greatest(2, len(ws) - 1))) AS u(i) WHERE len(ws) > 0),
sizes AS (SELECT rn, count(*) AS n FROM grams GROUP BY rn),
shared AS (SELECT a.rn AS a, b.rn AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.rn <> b.rn GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.rn = a JOIN sizes y ON y.rn = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT rn AS a, rn AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, min(o.doc_id) AS component_id FROM words w JOIN reach r ON r.a = w.rn JOIN words o ON o.rn = r.b LEFT JOIN sizes s ON s.rn = w.rn GROUP BY w.rn, w.doc_id, n"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# crc32 by table: the table is eight shifts of each byte
SQL11 = r"""
WITH RECURSIVE crc(b, c, k) AS (SELECT i, i, 0 FROM range(256) AS t(i) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
byte_codes AS (SELECT list(c ORDER BY b) AS codes FROM crc WHERE k = 8),
d AS (SELECT *, row_number() OVER () AS rn FROM documents),
summed AS (SELECT rn, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: xor(codes[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) AS crc FROM d, byte_codes WHERE doc_id IS NOT NULL),
made AS (SELECT rn, doc_id, lang, sha256({id} || {source} || {lang} || {n} || {text}) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256({id} || {source} || {lang} || {n1} || {text}) END AS other FROM d LEFT JOIN summed USING (rn)),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM made),
nodes(g, level, j, n, h) AS (SELECT g, 0, i, n, leaf FROM leaves UNION ALL SELECT g, level + 1, j // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY j)) FROM nodes WHERE n > 1 GROUP BY g, level, j // 2, n),
subs AS (SELECT g, h, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, j, n, h) AS (SELECT 0, g, n, h FROM subs UNION ALL SELECT level + 1, j // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY j)) FROM tops WHERE n > 1 GROUP BY level, j // 2, n),
every AS (SELECT g, level, j, n, h FROM nodes UNION ALL SELECT -1, level, j, n, h FROM tops),
walk(rn, home, g, level, j, n, h, path) AS (SELECT rn, g, g, 0, i, n, coalesce(other, leaf), '' FROM leaves
 UNION ALL SELECT rn, home, CASE WHEN w.n = 1 THEN -1 ELSE w.g END, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN w.n = 1 THEN w.home ELSE w.j // 2 END, CASE WHEN w.n = 1 THEN (SELECT count(*) FROM subs) ELSE (w.n + 1) // 2 END,
  CASE WHEN w.n = 1 THEN w.h WHEN w.j % 2 = 1 THEN sha256(e.h || w.h) ELSE sha256(w.h || coalesce(e.h, '')) END, CASE WHEN w.n = 1 THEN w.path ELSE w.path || coalesce(e.h, '') END
  FROM walk w LEFT JOIN every e ON e.g = w.g AND e.level = w.level AND e.j = xor(w.j, 1) WHERE w.n > 1 OR w.g >= 0)
SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root, sha256(w.path) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
FROM leaves l JOIN walk w ON w.rn = l.rn AND w.g = -1 AND w.n = 1 JOIN subs s ON s.g = l.g, (SELECT h FROM tops WHERE n = 1) t"""
for _name, _field in {"id": "doc_id", "source": "source", "lang": "lang", "n1": "n_chars + 1", "n": "n_chars", "text": "text"}.items():
    SQL11 = SQL11.replace("{" + _name + "}", f"coalesce(strlen(CAST({_field} AS VARCHAR)) || ':' || CAST({_field} AS VARCHAR), '-')")

SQL12 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rn, sha256({_FOLDED}) AS text_sha256, {_FOLDED} AS t FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY t) AS group_size, max(doc_id) OVER (PARTITION BY t) AS keep_id, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, rn) AS r FROM d)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM g"""

SQL13 = r"""
WITH d AS (SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT lang, source, rn, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT rn) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, total FROM groups g JOIN kept k USING (lang) LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
shares AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p, 1 + (1000000000::HUGEINT * (total + 1)) // (sum(total) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS q FROM dense),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM every
 UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

QUERIES = {f.__name__: f for f in (op1_language_id, op2_sharding, op3_decontamination, op4_quality_rules, op5_token_counts, op6_ngram_jaccard, op7_bpe, op8_quality_classifier, op9_html_extraction, op10_lm_scoring, op11_merkle_manifest, op12_exact_dedup, op13_source_divergence)}
ORACLES = {"op3_decontamination": SQL3, "op4_quality_rules": quality_sql.sql(), "op6_ngram_jaccard": SQL6, "op11_merkle_manifest": SQL11, "op12_exact_dedup": SQL12, "op13_source_divergence": SQL13}
