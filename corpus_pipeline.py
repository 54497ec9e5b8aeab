"""The corpus pipeline: quality rules, classifier, near copies, decontamination, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows it is given and, but
for the last, returns the columns of its input. Stages pass the input's columns
through under names of their own, so extra columns may have any names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontaminate, jaccard, kneser_ney, quality
from quillon.llm.common import positional, release, stored, table, written_so_far


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor their group's thresholds reject.

    A null or empty text fails the base rule; null languages and sources are
    groups of their own; repeated rows are kept or rejected alike; an empty
    table stays empty.
    """
    inner, name, back = positional(docs)
    return back(quality.judge(inner, name("text"), name("lang"), name("source")).filter("kept"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity stays below their language's threshold and whose words don't tell of toxic ones.

    A text without words goes; a null language has the overall threshold; null
    ids aren't learned from but judged; repeated rows are judged alike; an empty
    table stays empty, and without labels every text with words stays.
    """
    inner, name, back = positional(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted, toxic = kneser_ney.trusted_ids(labels), kneser_ney.toxic_ids(labels)
    return back(kneser_ney.judge(inner, trusted, doc_id=name("doc_id"), text=name("text"), language=name("lang"), toxic=toxic).filter("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at five words and a similarity of 0.8: the one with the least id.

    A group's documents without an id come after those with one; of equal ids
    with different texts the text with the least hash stays. Rows that repeat
    an id and text stay once. Documents without words are in no group: of
    those, too, rows that repeat an id and text stay once. An empty table
    stays empty.
    """
    inner, name, back = positional(docs)
    doc_id, text = name("doc_id"), name("text")
    linked = jaccard.link(inner, doc_id, text, width=5, percent=80)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    chosen = linked.filter("component is not null").groupBy("component").agg(first.alias("first")).select("first._id", "first._hash")
    wordless = linked.filter("component is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = lambda id_, hash_: F.col("_id").eqNullSafe(F.col(id_)) & (F.col("_hash") == F.col(hash_))
    copies = linked.groupBy(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chosen = table(chosen.union(wordless).join(copies, same("c_id", "c_hash"), "left").select("_id", "_hash", F.coalesce("n", F.lit(1)).alias("n")), "chosen")
    hashed = inner.withColumn("_text_hash", F.xxhash64(text))

    def rows_of(keys: DataFrame) -> DataFrame:
        if keys.count() <= jaccard.SEMI_ROWS:  # 24 bytes a row; beyond it both sides are shuffled
            keys = F.broadcast(keys)
        return hashed.join(keys, same(doc_id, "_text_hash"), "left_semi")

    # texts move only for rows that repeat an id and text
    return back(rows_of(chosen.filter("n = 1")).unionByName(rows_of(chosen.filter("n > 1")).dropDuplicates([doc_id, "_text_hash"])))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    A null or empty text holds none; items without an id count like others;
    repeated rows stay or go alike; without items all documents stay.
    """
    inner, name, back = positional(docs)
    return back(decontaminate.clean(inner, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text=name("text"), width=5, percent=80))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded text, a row for each row.

    A null text has no tokens, like an empty one; a null id stays null.
    """
    coded = bpe.encode(docs.select("doc_id", "text"), "text", public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality_rules), ("quality classifier", quality_classifier), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination), ("BPE encoding and decoding", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark = written_so_far()
        docs, path = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, mark, keep=(path,))  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
