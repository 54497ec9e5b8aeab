import pytest

from quillon.sources import versions

JOB, ART = "job_id long, updated_at long, stage string", "job_id long, name string"


def state(spark, path):
    jobs, artifacts = versions.read(spark, path, "jobs", "artifacts")
    return sorted(map(tuple, jobs.collect())), sorted(map(tuple, artifacts.collect()))


def save(spark, path, jobs, artifacts):
    return versions.save_jobs(spark, path, spark.createDataFrame(jobs, JOB), spark.createDataFrame(artifacts, ART))


def test_upsert_replaces_children(spark, tmp_path):
    path = str(tmp_path / "store")
    save(spark, path, [(1, 1, "a"), (2, 1, "a"), (2, 2, "b")], [(1, "x"), (2, "y"), (2, "z"), (9, "not a job")])
    assert state(spark, path) == ([(1, 1, "a"), (2, 2, "b")], [(1, "x"), (2, "y"), (2, "z")])
    save(spark, path, [(2, 0, "older counts, too"), (3, 1, "new")], [(2, "w")])
    assert state(spark, path) == ([(1, 1, "a"), (2, 0, "older counts, too"), (3, 1, "new")], [(1, "x"), (2, "w")])
    save(spark, path, [], [])
    assert len(state(spark, path)[0]) == 3
    assert versions.sweep(spark, path) == 2 and len(state(spark, path)[0]) == 3


@pytest.mark.parametrize("dies_at", ["artifacts", "pointer"])
def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch, dies_at):
    path = str(tmp_path / "store")
    save(spark, path, [(1, 1, "a")], [(1, "x")])
    before = state(spark, path)
    real = versions.write

    def half(s, p, tables):
        real(s, p, {"jobs": tables["jobs"]})
        raise OSError("gone")

    def none(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(versions, "write" if dies_at == "artifacts" else "point", half if dies_at == "artifacts" else none)
        with pytest.raises(OSError, match="gone"):
            save(spark, path, [(1, 2, "b")], [(1, "y")])
    assert state(spark, path) == before
    save(spark, path, [(1, 3, "c")], [])
    assert state(spark, path) == ([(1, 3, "c")], [])


def test_nothing_stored(spark, tmp_path):
    assert versions.current(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"), "jobs")


def test_what_was_written_can_be_released(spark):
    import os

    from quillon.sources import shared

    shared.release(spark)
    df = shared.written(spark.range(5).toDF("id"), "some")
    assert df.count() == 5
    folder = shared._tracked[0]
    assert os.path.isdir(folder) and shared.release(spark) == 1 and not os.path.exists(folder) and shared.release(spark) == 0
