"""Token counts by a separator scan of flat, unindexed token files.

A token file is a run of little-endian identifiers; each document ends with the
end-of-document identifier, and nothing says where documents begin. A file is
read in blocks of fixed size that ignore documents. Each block is searched for
the identifier in one vectorised comparison. Documents that lie across blocks
are stitched by a prefix scan over a file's blocks: the number of separators in
earlier blocks gives a document's ordinal, the position of the last earlier
separator its start. The scan needs one row per block, so a file of any size is
spread over all tasks.

Files are opened by ``pyarrow.fs``, so they may lie in any store it knows. The
writer names files by task attempt; the manifest (file, ordinal, id), written
as a table, names only those of attempts that counted.

Defined results: a null or empty text is a document of no tokens; tokens after
the last separator of a file form a document with ``closed`` false; an empty
file has no documents; repeated rows are documents of their own; an empty table
writes no file. Columns other than id and text aren't read, whatever their names.
Files and manifest stay until ``common.release``.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import shared_folder, table, track

BLOCK_BYTES = 4 << 20


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


MANIFEST = T.StructType([T.StructField("file", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("doc_id", T.LongType())])


def write(docs: DataFrame, ranks_path: str, pattern: str, eod: int, folder: str | None = None, *, doc_id: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """Encode every text with a byte-level vocabulary into token files; returns the manifest."""
    folder = folder or track(f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}")
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = f"<u{width}"

    def run(batches):
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.tokens"
        store, path = open_store(name)
        sink, n = None, 0
        for batch in batches:
            if sink is None:
                store.create_dir(path.rpartition("/")[0], recursive=True)
                sink = store.open_output_stream(path)
            for text in batch.column(1):
                ids = coder.encode_ordinary(text.as_py() or "")
                ids.append(eod)
                sink.write(np.array(ids, kind).tobytes())
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * k, pa.string()), pa.array(np.arange(n, n + k)), batch.column(0)], names=MANIFEST.names)
            n += k
        if sink is not None:
            sink.close()

    return table(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, MANIFEST), "manifest")


_BLOCK = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("bytes", T.LongType())])
_FOUND = T.StructType([T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))])


def scan(files: DataFrame, eod: int, *, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, first_token, n_tokens, closed) of every document in the files of column ``file``."""
    step = block_bytes - block_bytes % width

    def blocks(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = open_store(name)
                size = store.get_file_info(path).size or 0
                n = -(-size // step)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n)), pa.array([size] * n, pa.int64())], names=_BLOCK.names)

    def search(batches):
        for batch in batches:
            for name, block, size in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = open_store(name)
                with store.open_input_file(path) as f:
                    f.seek(block * step)
                    raw = f.read(min(step, size - block * step))
                tokens = np.frombuffer(raw[: len(raw) - len(raw) % width], f"<u{width}")
                ends = np.flatnonzero(tokens == eod) + block * (step // width)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=_FOUND.names)

    listed = files.select("file").distinct().mapInArrow(blocks, _BLOCK).repartition("file", "block")
    found = listed.mapInArrow(search, _FOUND)
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.select("file", "block", "ends", F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)).alias("before"), F.coalesce(F.max(F.expr("try_element_at(ends, -1)")).over(earlier), F.lit(-1)).alias("last_end"),
                         F.sum("n_tokens").over(Window.partitionBy("file")).alias("total"), F.lead("block").over(order).isNull().alias("is_last"))
    rest = F.greatest("last_end", F.coalesce(F.expr("try_element_at(ends, -1)"), F.lit(-1)))
    # the tokens after the last separator of the file, if any, end where the file ends
    open_end = F.when(F.col("is_last") & (rest < F.col("total") - 1), F.array("total")).otherwise(F.array().cast("array<long>"))
    found = found.withColumn("stops", F.concat("ends", open_end))
    one = found.select("file", "before", "last_end", "ends", "stops", F.posexplode("stops").alias("i", "end"))
    first = F.when(F.col("i") == 0, F.col("last_end")).otherwise(F.expr("stops[i - 1]")) + 1
    return one.select("file", (F.col("before") + F.col("i")).alias("ordinal"), first.alias("first_token"), (F.col("end") - first).alias("n_tokens"), (F.col("i") < F.size("ends")).alias("closed"))


def count(docs: DataFrame, ranks_path: str, pattern: str, eod: int) -> DataFrame:
    """(doc_id, n_tokens): texts to token files, files to counts, counts to ids."""
    manifest = write(docs, ranks_path, pattern, eod)
    found = scan(manifest.select("file").distinct(), eod)
    # both sides have a row per document, but files so small that Spark would take them for broadcastable
    return manifest.hint("merge").join(found.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "first_token")
