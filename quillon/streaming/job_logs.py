"""The state of jobs from their log lines: stage, provider ids, artifacts and the last lines, as a stream or at once.

Lines are parsed by column expressions; the stateful operator only merges what
they say. A job's state is one value (its stage), a list (its last lines) and a
map (its artifacts), so a micro-batch touches only the jobs and labels it names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators import sets as U

# Labels of artifacts, stages of provider states and how many lines are kept.
LABELS = (
    "job root", "source pdf", "layout json", "normalized document json", "normalization report json", "provider raw dir", "provider zip", "provider summary json", "schema version",
    "translations dir", "output pdf", "summary", "events jsonl", "batch_id", "task_id", "full_zip_url",
)
UPLOADED = "upload done: "
UPLOADED_STAGE = ("mineru_processing", "文件上传完成，等待 MinerU 处理")
STATES = {
    "waiting-file": ("mineru_upload", "等待文件上传到 MinerU"),
    "pending": ("mineru_processing", "MinerU 已接收任务，等待排队"),
    "running": ("mineru_processing", "MinerU 正在解析文件"),
    "converting": ("mineru_processing", "MinerU 正在转换文件"),
    "done": ("ocr_result_ready", "MinerU 结果已就绪，准备标准化"),
    "failed": ("failed", "MinerU 处理失败"),
}
OTHER_STATE = ("mineru_processing", "MinerU 状态: ")
TAIL = 40
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parse_line(line: Column) -> dict[str, Column]:
    """What a log line says: its trimmed text, label and value of an artifact, stage and detail, batch and task id; null where it says nothing."""
    s = F.regexp_replace(F.coalesce(line, F.lit("")), r"(?U)^\s+|\s+$", "")
    label = F.regexp_extract(s, "^(" + "|".join(LABELS) + "):", 1)
    value = F.regexp_replace(F.substring(s, F.length(label) + 2, F.length(s)), r"(?U)^\s+|\s+$", "")
    said = (label != "") & (value != "")
    part = lambda i: F.regexp_replace(F.regexp_extract(s, r"^(batch|task) (.*?): state=(.*)$", i), r"(?U)^\s+|\s+$", "")
    kind, owner, raw = part(1), part(2), part(3)
    stated = (kind != "") & (owner != "") & (raw != "")
    of = lambda i: F.coalesce(*[F.when(raw == k, v[i]) for k, v in STATES.items()])
    uploaded = s.startswith(UPLOADED)
    return {
        "line": s,
        "label": F.when(said, label),
        "value": F.when(said, value),
        "stage": F.when(uploaded, UPLOADED_STAGE[0]).when(stated, F.coalesce(of(0), F.lit(OTHER_STATE[0]))),
        "detail": F.when(uploaded, UPLOADED_STAGE[1]).when(stated, F.coalesce(of(1), F.concat(F.lit(OTHER_STATE[1]), raw))),
        "batch_id": F.when(~uploaded & stated & (kind == "batch"), owner),
        "task_id": F.when(~uploaded & stated & (kind == "task"), owner),
    }


def parsed(lines: DataFrame, job: str, seq: str, line: str) -> DataFrame:
    """(job_id, seq, and what the lines say), without blank lines."""
    said = parse_line(F.col(line))
    return lines.select(F.col(job).cast("string").alias("job_id"), F.col(seq).cast("long").alias("seq"), *[c.alias(n) for n, c in said.items()]).filter("line != ''")


FIELDS = ("stage", "detail", "batch_id", "task_id")
STATE = "job_id string, stage string, detail string, batch_id string, task_id string, lines long, tail array<string>, artifacts map<string,string>"


class JobLog(StatefulProcessor):
    """Merges the parsed lines of one job, in order within a micro-batch; a later micro-batch is later."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "stage string, detail string, batch_id string, task_id string, lines long")
        self.tail = handle.getListState("tail", "line string")
        self.artifacts = handle.getMapState("artifacts", "label string", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.job.get()) if self.job.exists() else [None, None, None, None, 0]
        tail = [r[0] for r in self.tail.get()]
        new: dict[str, str] = {}
        # lines of a job in one micro-batch (maxFilesPerTrigger bounds them)
        for r in sorted((r for pdf in rows for r in pdf.itertuples(index=False)), key=lambda r: (r.seq, r.line)):
            for k, name in enumerate(FIELDS):
                said = getattr(r, name)
                if said is not None and said == said:
                    state[k] = said
            if r.label is not None and r.label == r.label:
                new[r.label] = r.value
            state[4] += 1
            tail = [*tail[1 - TAIL :], r.line] if len(tail) >= TAIL else [*tail, r.line]
        self.job.update(tuple(state))
        self.tail.put([(x,) for x in tail])
        for label, value in new.items():
            self.artifacts.updateValue((label,), (value,))
        held = {k[0]: v[0] for k, v in self.artifacts.iterator()}
        yield pd.DataFrame({"job_id": [key[0]], **{n: [state[k]] for k, n in enumerate(FIELDS)}, "lines": [state[4]], "tail": [tail], "artifacts": [held]})

    def close(self) -> None:
        pass


def keep_state_in_rocks(spark: SparkSession) -> None:
    """The state store that several kinds of state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def stream_states(lines: DataFrame, job: str = "job_id", seq: str = "seq", line: str = "line") -> DataFrame:
    """A row with the state of each job that a micro-batch has lines of; update mode."""
    keep_state_in_rocks(lines.sparkSession)
    return parsed(lines, job, seq, line).groupBy("job_id").transformWithStateInPandas(JobLog(), STATE, "Update", "None")


def job_states(lines: DataFrame, job: str = "job_id", seq: str = "seq", line: str = "line") -> DataFrame:
    """The same states at once: last values by their order, the last lines ranked before they are gathered."""
    p = parsed(lines, job, seq, line)
    order = F.struct("seq", "line")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    states = p.groupBy("job_id").agg(*[last(c) for c in FIELDS], F.count(F.lit(1)).alias("lines"))
    ranked = U.top_k(p.select("job_id", "seq", "line"), ["job_id"], [F.desc("seq"), F.desc("line")], TAIL)
    tails = ranked.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]).alias("tail"))
    values = p.filter("label is not null").groupBy("job_id", "label").agg(F.max_by("value", order).alias("value"))
    maps = values.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("artifacts"))
    none = F.create_map().cast("map<string,string>")
    return states.join(tails, "job_id").join(maps, "job_id", "left").withColumn("artifacts", F.coalesce("artifacts", none)).select("job_id", *FIELDS, "lines", "tail", "artifacts")
