"""Tables that are replaced together: versioned folders and one pointer.

A version is a folder with a table each; the pointer names the version that
counts and is written last, by a rename, which the store does as a whole. A
writer that dies before leaves the old version as it was; its folder is left
over and can be swept. Readers take the version once and read both tables of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTER = "_current"


def _store(spark: SparkSession, path: str):
    """The file system that holds a path."""
    jvm = spark._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current(spark: SparkSession, path: str) -> str | None:
    """The version that counts, or None."""
    fs, Path = _store(spark, path)
    at = Path(f"{path}/{POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def point(spark: SparkSession, path: str, version: str) -> None:
    """Let a version count: a new pointer is written beside the old one and renamed over it."""
    fs, Path = _store(spark, path)
    new = Path(f"{path}/{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(new)
    try:
        out.write(bytearray(version.encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(Path(f"{path}/{POINTER}")), options)


def write(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> str:
    """A new version's folder; it doesn't count until ``point``."""
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    return version


def read(spark: SparkSession, path: str, *names: str) -> tuple[DataFrame, ...]:
    """Tables of the version that counts."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} has no version")
    return tuple(spark.read.parquet(f"{path}/{version}/{n}") for n in names)


def sweep(spark: SparkSession, path: str) -> int:
    """Delete the folders of versions that don't count; not while anyone reads or writes them."""
    fs, Path = _store(spark, path)
    keep, gone = current(spark, path), 0
    for status in fs.listStatus(Path(path)):
        name = status.getPath().getName()
        if name.startswith("v-") and name != keep or name.startswith(f"{POINTER}-"):
            fs.delete(status.getPath(), True)
            gone += 1
    return gone


def upserted(stored: DataFrame, changed: DataFrame, key: str, order: str) -> DataFrame:
    """Stored rows with changed ones in their place; of several changes to a key the last by ``order`` counts."""
    w = Window.partitionBy(key).orderBy(F.desc("_rank"), F.desc(order))
    both = stored.withColumn("_rank", F.lit(0)).unionByName(changed.withColumn("_rank", F.lit(1)))
    return both.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_rank", "_at")


def children_replaced(stored: DataFrame, parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Stored child rows, but for changed parents all and only the new ones."""
    return stored.join(parents.select(key).distinct(), key, "left_anti").unionByName(children)


def save_jobs(spark: SparkSession, path: str, jobs: DataFrame, artifacts: DataFrame, key: str = "job_id", order: str = "updated_at") -> str:
    """Upsert jobs and replace their artifact rows, both or neither; the new version.

    Artifacts of a job that isn't among ``jobs`` are left out. The first call
    makes the tables. One writer at a time.
    """
    last = upserted(jobs.limit(0), jobs, key, order)
    own = artifacts.join(jobs.select(key).distinct(), key, "left_semi")
    if current(spark, path) is not None:
        stored, rows = read(spark, path, "jobs", "artifacts")
        last, own = upserted(stored, jobs, key, order), children_replaced(rows, jobs, own, key)
    version = write(spark, path, {"jobs": last, "artifacts": own})
    point(spark, path, version)
    return version
