"""The folder that all executors share, and tables written to it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where the session names none, one is made if all tasks run on this machine;
    on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "quillon-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: folders in the shared one that results may still read
_tracked: list[str] = []


def track(path: str) -> str:
    """A folder that ``release`` deletes."""
    _tracked.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete what ``written`` and streams have put into the shared folder, once the results that read it are written; how many folders."""
    for p in _tracked:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gone = len(_tracked)
    _tracked.clear()
    return gone


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts its lineage and survives lost executors. It stays until ``release``."""
    path = track(f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
