"""Set operators, deduplication, top-k and batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, signature: Column, order: list[str], out: str, keep: str) -> DataFrame:
    """df with ``out``: the ``keep`` value of the first row of the same signature; a null signature stands alone.

    The first row of a signature is found by aggregation and joined back, so a
    signature shared by a third of all rows is summed before it is shuffled.
    """
    marked = df.withColumn("_s", signature)
    reps = marked.filter("_s is not null").groupBy(F.col("_s").alias("_r")).agg(F.min_by(keep, F.struct(*order)).alias("_keep"))
    return marked.join(reps, F.col("_s") == F.col("_r"), "left").withColumn(out, F.coalesce("_keep", keep)).drop("_s", "_r", "_keep")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the values of its last row, at the position of its first."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest])


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group in order, with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def batches(df: DataFrame, by: list[str], order: list[str], batchable: Column, size: int) -> DataFrame:
    """df with ``batch``: batchable rows in runs of ``size``, every other row by itself afterwards."""
    d = df.withColumn("_b", batchable)
    w = Window.partitionBy(*by, "_b").orderBy(*order)
    n = F.row_number().over(w) - 1
    runs = F.ceil(F.count_if(F.col("_b")).over(Window.partitionBy(*by)) / size)
    return d.withColumn("batch", F.when(F.col("_b"), F.floor(n / size)).otherwise(runs + n).cast("long")).drop("_b")


def page(df: DataFrame, order: list, offset: int, limit: int, most: int = 500) -> DataFrame:
    """A page of the ordered rows; the limit is clamped to 1 to ``most``."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(most, max(1, limit)))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of only one side, with which side that is."""
    return left.exceptAll(right).withColumn("side", F.lit("missing")).unionByName(right.exceptAll(left).withColumn("side", F.lit("extra")))
