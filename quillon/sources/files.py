"""Readers of small files: event logs, glossaries, manifests, JSON lines, file listings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import catalog as K

EVENT = "job_id string, seq bigint, ts string, level string, stage string, user_stage string, substage string, stage_detail string, provider string, event string, event_type string, progress_current bigint, progress_total bigint, progress_unit string, retry_count bigint, elapsed_ms bigint, message string, payload string, _corrupt string"
GLOSSARY = "array<struct<source:string,target:string,note:string,level:string,match_mode:string,context:string>>"
# Header names that glossary files use.
HEADERS = {"source": "source src term original 原文 术语".split(), "target": "target tgt translation 译文 翻译".split(), "note": "note notes comment 备注".split(), "level": "level 级别".split(), "match_mode": "match_mode match 匹配".split(), "context": "context 上下文".split()}


def event_log(spark: SparkSession, path: str, job_id: str | None = None, base_seq: int = 0) -> DataFrame:
    """JSON-lines events: malformed and foreign rows dropped, numbered by their line."""
    text = spark.read.text(path, wholetext=False).withColumn("_file", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id())
    line = text.withColumn("_line", F.row_number().over(Window.partitionBy("_file").orderBy("_at")) - 1).filter(F.trim("value") != "")
    e = line.select("_line", F.from_json("value", EVENT, {"columnNameOfCorruptRecord": "_corrupt"}).alias("e")).filter("e is not null and e._corrupt is null").select("_line", "e.*")
    if job_id is not None:
        e = e.filter(F.coalesce(F.col("job_id"), F.lit("")).isin("", job_id)).withColumn("job_id", F.lit(job_id))
    return e.withColumns({"level": F.coalesce("level", F.lit("info")), "event_type": F.coalesce("event_type", "event"), "seq": F.col("_line") + base_seq + 1}).drop("_line", "_corrupt")


def glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Glossary rows of a CSV file with or without a header; columns by name, else by place."""
    raw = spark.read.option("header", False).option("multiLine", True).option("mode", "PERMISSIVE").csv(path, schema=", ".join(f"_c{i} string" for i in range(6)))
    top = list(raw.first() or [None] * 6)  # one row
    first = [(x or "").strip().strip("\ufeff").lower() for x in top]
    place = {name: next((i for i, x in enumerate(first) if x in names), None) for name, names in HEADERS.items()}
    headed = place["source"] is not None and place["target"] is not None
    if not headed:
        place = {name: i for i, name in enumerate(HEADERS)}
    rows = raw
    if headed:
        same = F.lit(True)
        for i, x in enumerate(top):
            same = same & F.col(f"_c{i}").eqNullSafe(F.lit(x))
        rows = raw.filter(~same)
    return normalize(rows.select(*[(F.col(f"_c{i}") if i is not None else F.lit(None).cast("string")).alias(n) for n, i in place.items()]))


def glossary_json(df: DataFrame, column: str) -> DataFrame:
    """Glossary rows of a column of JSON arrays."""
    return normalize(df.select(F.explode(F.from_json(column, GLOSSARY)).alias("g")).select("g.*"))


def normalize(g: DataFrame) -> DataFrame:
    """Trimmed entries; a preserved term is its own target; entries without both sides go."""
    clean = {c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "﻿", "")) for c in HEADERS}
    g = g.select(*[v.alias(k) for k, v in clean.items()])
    level = K.glossary_level(F.col("level"))
    g = g.withColumns({"level": level, "match_mode": K.match_mode(F.col("match_mode")), "target": F.when((level == "preserve") & (F.col("target") == ""), F.col("source")).otherwise(F.col("target"))})
    return g.filter((F.col("source") != "") & (F.col("target") != ""))


def json_lines_results(df: DataFrame, column: str, by: str, order: str) -> DataFrame:
    """Per key: the results of all its lines in order, the first data info, and the number of lines."""
    parsed = df.select(by, order, F.from_json(column, "result struct<layoutParsingResults:array<string>,dataInfo:string>").alias("j"))
    return parsed.groupBy(by).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "j.result.layoutParsingResults"))), lambda x: x["layoutParsingResults"])).alias("results"),
        F.min_by("j.result.dataInfo", F.when(F.col("j.result.dataInfo").isNotNull(), F.col(order))).alias("data_info"),
        F.count(F.lit(1)).alias("lines"),
    )


def manifest_pages(spark: SparkSession, manifest: str, item_schema: str) -> DataFrame:
    """Items of the page files that a manifest lists, with their page; a page listed twice is an error.

    The manifest is a table like any other: the files of its folder are joined
    to it by their path below the folder, so it may list any number of pages.
    """
    m = spark.read.schema("schema string, schema_version string, pages array<struct<page_index:bigint,page_number:bigint,path:string>>").option("multiLine", True).json(manifest)
    listed = m.select(F.explode("pages").alias("p")).select(F.col("p.page_index").alias("page_idx"), F.col("p.path").alias("_path"))
    if listed.groupBy("page_idx").count().filter("count > 1").limit(1).count():
        raise ValueError("manifest lists a page twice")
    base = manifest.rsplit("/", 1)[0]
    rows = spark.read.schema(item_schema).option("multiLine", True).option("recursiveFileLookup", True).json(base)
    below = F.element_at(F.split(F.col("_metadata.file_path"), "/" + re.escape(base.rsplit("/", 1)[-1]) + "/", 2), -1)
    return rows.withColumn("_below", F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B")))).join(listed, F.col("_below") == F.col("_path")).drop("_below", "_path")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, size, content) of the files in ZIP archives; one archive is in memory at a time.

    A member whose name leads out of the archive is an error, a folder no member.
    """

    def run(batches):
        import io
        import zipfile

        for pdf in batches:
            for at, raw in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for m in z.infolist():
                        if m.is_dir():
                            continue
                        if m.filename.startswith("/") or ".." in m.filename.split("/"):
                            raise ValueError(f"member leads out of its archive: {m.filename}")
                        yield pd.DataFrame([(at, m.filename, m.file_size, z.read(m))], columns=["archive", "name", "size", "content"])

    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    return archives.mapInPandas(run, "archive string, name string, size bigint, content binary")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size, modified) of files, without reading their content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
