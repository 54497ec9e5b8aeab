import random

import pytest
from pyspark.sql import functions as F

from quillon.streaming import events, job_logs

LINES = ["upload done: a.pdf", "batch b7: state=pending", "task t3: state= done ", "task t4: state=odd state", "batch : state=done", "batch x: state=", "summary: /tmp/s.json", "output pdf:", "output pdf: o.pdf ", "  ", "", None, " plain text ", "task t9: state=failed", "job root: /a: b", "upload done: x: state=done"]


def brute(rows):
    """job -> (stage, detail, batch, task, number of lines, last lines, artifacts), line by line."""
    jobs = {}
    for job, _, line in sorted(rows, key=lambda r: (r[1], (r[2] or "").strip())):
        line = (line or "").strip()
        if not line:
            continue
        state = jobs.setdefault(job, [None, None, None, None, 0, [], {}])
        state[4] += 1
        state[5] = [*state[5], line][-40:]
        for label in job_logs.LABELS:
            if line.startswith(label + ":") and line[len(label) + 1 :].strip():
                state[6][label] = line[len(label) + 1 :].strip()
        if line.startswith("upload done: "):
            state[:2] = job_logs.UPLOADED_STAGE
            continue
        for k, kind in ((2, "batch "), (3, "task ")):
            owner, sep, raw = line.removeprefix(kind).partition(": state=")
            if line.startswith(kind) and sep and owner.strip() and raw.strip():
                state[:2] = job_logs.STATES.get(raw.strip(), (job_logs.OTHER_STATE[0], job_logs.OTHER_STATE[1] + raw.strip()))
                state[k] = owner.strip()
    return {j: (*s[:5], tuple(s[5]), tuple(sorted(s[6].items()))) for j, s in jobs.items()}


def got(df):
    return {r.job_id: (r.stage, r.detail, r.batch_id, r.task_id, r.lines, tuple(r.tail), tuple(sorted((r.artifacts or {}).items()))) for r in df.collect()}


def made(n, seed):
    rng = random.Random(seed)
    return [(f"j{rng.randrange(4)}", i, rng.choice(LINES)) for i in range(n)]


@pytest.mark.parametrize("n", [1, 30, 400])
def test_batch(spark, n):
    rows = made(n, n)
    df = spark.createDataFrame(rows, "job_id string, seq long, line string").repartition(3)
    assert got(job_logs.job_states(df)) == brute(rows)


def test_stream_over_micro_batches_and_a_restart(spark, tmp_path):
    """Two files in two micro-batches, then two more after a restart from the same checkpoint."""
    rows = made(600, 3)
    schema = "job_id string, seq long, line string"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")

    def write(k):
        spark.createDataFrame(rows[150 * k : 150 * (k + 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(name):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return events.run_once(job_logs.stream_states(stream), name, "update", str(tmp_path / "state"), ("job_id",))

    try:
        for k in (0, 1):
            write(k)
        assert got(run("states")) == brute(rows[:300])
        for k in (2, 3):
            write(k)
        last = run("states")
        assert got(last) == brute(rows) == got(job_logs.job_states(spark.createDataFrame(rows, schema)))
        assert last.select(F.max(F.size("tail"))).first()[0] == 40
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
