"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.shared import shared_folder

#: of tables that operators write; sf0.1-like texts take three quarters of the default's disk
COMPRESSION = "zstd"
#: paths of the tables that operators have written and results may still read, in order
_written: list[str] = []


def _delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders in whatever store they lie; without a JVM at hand (Spark Connect) they stay."""
    jvm = getattr(spark, "_jvm", None)
    for p in paths if jvm is not None else ():
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hand_back() -> None:
    """Give free memory that Arrow and the C library keep back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def settled(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker hands its free memory back.

    Python workers live on for the tasks of later stages; what is kept of one
    stage would add to what the next one needs.
    """

    def then_settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return then_settle


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within sends Python at most so many rows at once; long texts would else make large batches, on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables in the shared folder that go when an operator has its result."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", COMPRESSION).parquet(path)
        self.paths.append(path)
        schema = df.schema
        del df
        self.sweep()
        return self.spark.read.schema(schema).parquet(path)

    def sweep(self, wait: float = 0) -> None:
        """Let Spark remove shuffle files that nothing refers to any more, rather than when the driver next happens to collect.

        The JVM hears of what Python has let go only up to a second later; without ``wait`` the last table's files stay until the next sweep.
        """
        gc.collect()
        time.sleep(wait)
        if getattr(self.spark, "_jvm", None) is not None:
            self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, which nothing reads any more."""
        gone = [p for p in self.paths if p.rpartition("/")[2].rpartition("-")[0] in names]
        _delete(self.spark, gone)
        self.paths = [p for p in self.paths if p not in gone]

    def clear(self) -> None:
        _delete(self.spark, self.paths)
        self.paths = []


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back (cuts lineage, survives lost executors), and where it is."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", COMPRESSION).parquet(path)
    _written.append(path)
    hand_back()  # what the driver has collected on the way
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back. The table stays until ``release``, since results read it lazily."""
    return stored(df, name)[0]


def track(path: str) -> str:
    """A folder that ``release`` deletes like a table."""
    _written.append(path)
    return path


def written_so_far() -> int:
    """A mark for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the tables that operators wrote since a mark, but for ``keep``; call it when the results that read them are written."""
    gone = [p for p in _written[since:] if p not in keep]
    _delete(spark, gone)
    _written[since:] = [p for p in _written[since:] if p in keep]


def positional(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[..., DataFrame]]:
    """docs under names by position, the new name of a column, and the way back.

    So nothing that an operator adds meets a column of the input. The way back
    takes names of result columns, too; an input column of such a name is left out.
    """
    names = docs.columns
    plain = [f"in{i}_" for i in range(len(names))]

    def back(df: DataFrame, *results: str) -> DataFrame:
        return df.select(*[F.col(p).alias(n) for p, n in zip(plain, names) if n not in results], *results)

    return docs.toDF(*plain), lambda name: plain[names.index(name)], back


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t, True) for n, t in fields)])


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
