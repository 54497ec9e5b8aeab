"""Streams of job events: reading, latest state, windows, gauges and batched flushes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.sources.sinks import save_pages

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 10, form: str = "parquet") -> DataFrame:
    """A stream of event files."""
    return spark.readStream.format(form).schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).load(path)


def latest_state(events: DataFrame, key: str = "user_id", rank: dict[str, int] | None = None) -> DataFrame:
    """Per key the event of highest rank, then latest; update mode."""
    order = F.lit(0)
    for name, r in (rank or {}).items():
        order = F.when(F.col("event_type") == name, r).otherwise(order)
    return events.groupBy(key).agg(F.max_by("event_type", F.struct(order, "ts", "event_id")).alias("stage"), F.max("ts").alias("seen"), F.count(F.lit(1)).alias("n"))


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums per type and window; late rows within the watermark still count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


GAUGE = "event_type string, running bigint, peak bigint"
GAUGE_STATE = "running bigint, peak bigint"


def gauge(events: DataFrame) -> DataFrame:
    """Running requests per type and their peak: even ids start one, odd ids end one.

    The events of a key in one micro-batch are ordered as a whole, 16 bytes for
    each (``maxFilesPerTrigger`` bounds them); events of a later micro-batch
    count as later.
    """

    def step(key: tuple, batches, state: GroupState):
        running, peak = state.get if state.exists else (0, 0)
        parts = [(pdf["ts"].to_numpy("datetime64[us]").astype(np.int64), pdf["event_id"].to_numpy(np.int64)) for pdf in batches]
        ts, ids = (np.concatenate(x) for x in zip(*parts))
        run = running + np.cumsum(np.where(ids[np.lexsort((ids, ts))] % 2 == 0, 1, -1))
        running, peak = int(run[-1]), max(peak, int(run.max()))
        state.update((running, peak))
        yield pd.DataFrame([(key[0], running, peak)], columns=["event_type", "running", "peak"])

    return events.groupBy("event_type").applyInPandasWithState(step, GAUGE, GAUGE_STATE, "update", GroupStateTimeout.NoTimeout)


MEMORY = "term string, hits bigint, latest double, at bigint"
MEMORY_STATE = "hits bigint, latest double, at bigint"


def term_memory(events: DataFrame) -> DataFrame:
    """Per term its hits and the value of its last event, kept across batches."""

    def step(key: tuple, batches, state: GroupState):
        hits, latest, at = state.get if state.exists else (0, 0.0, -1)
        for pdf in batches:
            hits += len(pdf)
            last = pdf.loc[pdf["event_id"].idxmax()]
            if last["event_id"] > at:
                latest, at = float(last["value"]), int(last["event_id"])
        state.update((hits, latest, at))
        yield pd.DataFrame([(key[0], hits, latest, at)], columns=["term", "hits", "latest", "at"])

    terms = events.withColumn("term", F.col("event_type"))
    return terms.groupBy("term").applyInPandasWithState(step, MEMORY, MEMORY_STATE, "update", GroupStateTimeout.NoTimeout)


def flush_dirty(path: str, by: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that replaces only the partitions a batch touches; running it again changes nothing."""

    def write(batch: DataFrame, _batch_id: int) -> None:
        save_pages(batch, path, by)

    return write


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Stage and progress of log lines of the form '[stage] text 3/5'."""
    part = lambda i: F.regexp_extract(column, r"^\[(\w+)\]\s*(.*?)(?:\s+(\d+)/(\d+))?$", i)
    return lines.select("*", part(1).alias("stage"), part(2).alias("message"), F.try_to_number(F.nullif(part(3), F.lit("")), F.lit("999999999")).cast("long").alias("current"), F.try_to_number(F.nullif(part(4), F.lit("")), F.lit("999999999")).cast("long").alias("total")).filter("stage != ''")


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """All that a stream has now, as a table beside its checkpoint; in update mode the last row of each of ``keys``.

    Every micro-batch replaces its own folder, so one that runs again changes nothing.
    """
    spark, out = stream.sparkSession, f"{checkpoint.rstrip('/')}-{name}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out).withColumn("_batch", F.regexp_extract("_metadata.file_path", r"/batch=(\d+)/", 1).cast("long"))
    if mode == "append":
        return rows.drop("_batch")
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("v"))
        return last.select(*[F.col(c) if c in keys else F.col(f"v.{c}") for c in stream.columns])
    top = rows.agg(F.max("_batch").alias("_top"))  # one row
    return rows.join(F.broadcast(top), F.col("_batch") == F.col("_top")).drop("_batch", "_top")
