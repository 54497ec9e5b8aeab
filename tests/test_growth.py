"""Work per row and per group: texts are read once, groups go to Python together, counts keep to fixed-size sums."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import joins, markdown, sequential, windows
from quillon.plans import all_queries

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
DEALT = ("f12_command_prefix", "f28_glued_blocks", "c24_term_candidates", "c27_markdown", "m05_fitted_size", "c07_protect", "c15_box_split", "f16_copied_output", "f16_english_output", )


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pair_scores_read_a_text_once(spark):
    df = spark.createDataFrame([(1, 1, 0, "a text", 0.0, 0.0, 1.0, 1.0)], "g int, i int, page_idx long, t string, x0 double, y0 double, x1 double, y1 double")
    scored = windows.join_score(df, ["g"], ["i"], "t").select("g", "i", "decision")
    assert plan(scored).count("(?U)") == 1


def test_groups_over_ends_of_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(1)
        rows = [(g, i, rng.randint(1, 9), rng.choice(["join", "break"])) for g in (None, 1, 2, 3, 4, 5) for i in range(rng.choice([1, 3, 7]))]
        df = spark.createDataFrame(rows, "g int, i int, n int, d string").coalesce(1)
        assert "FlatMapGroups" not in plan(sequential.pack(df, ["g"], ["i"], "n", 3, 12))
        want_window, want_group, want_smooth = {}, {}, {}
        for g in (None, 1, 2, 3, 4, 5):
            own = [r for r in rows if r[0] == g]
            window = items = total = 0
            last = None
            for _, i, n, _ in own:
                if items and (items >= 3 or total + n > 12):
                    window, items, total = window + 1, 0, 0
                items, total = items + 1, total + n
                want_window[g, i] = window
                last = float(n) if last is None else min(last + 2.0, max(last - 2.0, float(n)))
                want_smooth[g, i] = last
            at = made = 0
            while at < len(own):
                to = at
                while to < len(own) - 1 and own[to][3] == "join":
                    to += 1
                made += to > at
                for k in range(at, to + 1):
                    want_group[g, own[k][1]] = made if to > at else None
                at = to + 1
        got = lambda d, c: {(r["g"], r["i"]): r[c] for r in d.collect()}
        assert got(sequential.pack(df, ["g"], ["i"], "n", 3, 12), "window") == want_window
        assert got(sequential.chain_ids(df, ["g"], ["i"], "d"), "group_no") == want_group
        assert got(sequential.smooth(df, ["g"], ["i"], "n", 2.0), "smoothed") == want_smooth
        boxes = df.select("g", F.col("i").cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("i") + 1.5).alias("x1"), F.lit(1.0).alias("y1"))
        merged = sorted(((r["g"] or 0, r["n"]) for r in sequential.merge_boxes(boxes, ["g"]).collect()))
        assert merged == sorted((g or 0, sum(r[0] == g for r in rows)) for g in (None, 1, 2, 3, 4, 5))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_missing_inputs_keep_no_sets(spark):
    jobs = spark.createDataFrame([(1, None), (2, 1), (3, 9)], "j int, s int")
    artifacts = spark.createDataFrame([(1, "a"), (1, "x"), (2, "b"), (2, "b"), (9, "a"), (9, "c")], "j int, k string")
    found = joins.missing_inputs(jobs, artifacts, "j", "k", ("a", "b", "c"), "s")
    assert "ObjectHashAggregate" not in plan(found)
    assert sorted((r["j"], r["missing"]) for r in found.collect()) == [(1, ["b", "c"]), (2, ["c"]), (3, ["b"])]


@tables
@pytest.mark.parametrize("name", DEALT)
def test_rows_of_one_row_group_are_dealt(spark, name):
    assert "REPARTITION_BY_COL" in plan(all_queries.QUERIES[name](spark, SF))


@tables
@pytest.mark.parametrize("name", ["f16_copied_output", "f16_english_output"])
def test_a_translation_is_measured_once(spark, name):
    assert plan(all_queries.QUERIES[name](spark, SF)).count("{30,}") == 1


@tables
def test_boxes_stay_with_their_texts(spark):
    assert "Join" not in plan(all_queries.QUERIES["m05_fitted_size"](spark, SF))


def test_rules_are_left_out_only_where_nothing_matches(monkeypatch):
    rng = random.Random(2)
    parts = ["$", "^{", "}", "_", "x1", "a(b)", r"\left(", r"\right)", "[ab]", "]_c", "{1, 2}^n", "3 + ab_c", "x-y/z", " ", "$a$", r"\alpha{n}", "12", "*", "β_2"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(2000)]
    got = [markdown.markdown(t) for t in texts]
    monkeypatch.setattr(markdown, "MARKS", [""] * len(markdown.PROMOTED))
    assert got == [markdown.markdown(t) for t in texts]


@tables
def test_candidates_read_a_text_once(spark):
    assert plan(all_queries.QUERIES["c24_term_candidates"](spark, SF)).count("[^\\x00-") == 1


@tables
def test_glued_texts_are_measured_before_rows_move(spark):
    found = plan(all_queries.QUERIES["f28_glued_blocks"](spark, SF))
    assert found.index("Window") < found.index("(?U)")
