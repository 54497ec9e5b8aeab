"""Writers: page tables, upserts, event appends, reports, caches, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save_pages(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that df has rows of, and no others."""
    df.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def manifest(df: DataFrame, page: str, file: str) -> DataFrame:
    """One row with the manifest of page files as JSON, pages in order; a book's pages are few."""
    pages = F.array_sort(F.collect_list(F.struct(F.col(page).alias("page_index"), (F.col(page) + 1).alias("page_number"), F.col(file).alias("path"))))
    return df.groupBy().agg(F.to_json(F.struct(F.lit("translation_manifest_v1").alias("schema"), F.lit("1.0").alias("schema_version"), pages.alias("pages"))).alias("value"))


def merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key (an upsert)."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def without(old: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """old without the rows of the given keys (a delete)."""
    return old.join(keys.select(*key).distinct(), key, "left_anti")


def numbered(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """new with ``seq`` continued behind the greatest one that old has for the key."""
    last = old.groupBy(F.col(key).alias("_k")).agg(F.max("seq").alias("_last"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.withColumn("_n", n).join(last, F.col(key) == F.col("_k"), "left").withColumn("seq", F.coalesce("_last", F.lit(0)) + F.col("_n")).drop("_k", "_last", "_n")


def append_events(df: DataFrame, path: str) -> None:
    """Events appended as JSON lines; nulls are left out of a line."""
    df.write.mode("append").option("ignoreNullFields", True).json(path)


def run_report(metrics: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """One row with a run's document as JSON: the columns of a one-row table and, under their names, one-row parts."""
    doc = metrics
    for name, part in parts.items():
        doc = doc.join(F.broadcast(part.select(F.struct(*part.columns).alias(name))))  # one row each
    return doc.select(F.to_json(F.struct(*doc.columns)).alias("value"))


def report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def store_cache(df: DataFrame, path: str, key: str = "cache_key", value: str = "translated") -> None:
    """Append results under their content key, in folders by the key's first two characters; blank ones are skipped."""
    df.filter(F.trim(value) != "").withColumn("shard", F.substring(key, 1, 2)).write.partitionBy("shard").mode("append").parquet(path)


def load_cache(spark: SparkSession, path: str, key: str = "cache_key") -> DataFrame:
    return spark.read.parquet(path).dropDuplicates([key]).drop("shard")


def replaced(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Text replaced in the rows that hold it."""
    return df.withColumn(column, F.when(F.col(column).contains(old), F.replace(F.col(column), F.lit(old), F.lit(new))).otherwise(F.col(column)))


def expired(df: DataFrame, created: str, seconds: int, now) -> DataFrame:
    """Rows older than a time to live at ``now``."""
    return df.filter(F.col(created) <= now - F.expr(f"INTERVAL {int(seconds)} SECONDS"))


def to_delete(files: DataFrame, keep: DataFrame) -> DataFrame:
    """Files that the keep list doesn't name."""
    return files.join(keep.select(F.col("name").alias("_keep")), F.col("name") == F.col("_keep"), "left_anti")
