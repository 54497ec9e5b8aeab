from collections import Counter

import duckdb
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import quality, quality_sql


def brute(t):
    w = (t or "").encode().split()
    five = Counter(zip(w, w[1:], w[2:], w[3:], w[4:]))
    hit = {i + k for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab #|\né")), max_size=60)), min_size=1, max_size=5))
def test_measures(texts):
    got = quality.measure_column(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert tuple(int(got[m][i]) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute(t)


def test_odd_rows_match_sql(spark, odd):
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    got = sorted(map(str, quality.judge(odd, least_docs=2, tail_docs=4, carry=["doc_id"]).select(*names).toPandas().astype(object).values.tolist()))
    c = duckdb.connect()
    c.register("documents", odd.toPandas())
    want = sorted(map(str, c.execute(quality_sql.sql(least_docs=2, tail_docs=4)).df()[names].astype(object).values.tolist()))
    assert len(got) == 14 and [g.replace("nan", "None") for g in got] == [w.replace("nan", "None").replace("<NA>", "None") for w in want]


def test_carried_columns_and_empty(odd, none):
    assert quality.judge(none).count() == 0
    assert quality.judge(odd).columns[:5] == odd.columns
    clash = odd.withColumnRenamed("n_chars", "total").withColumnRenamed("source", "g_lang")
    assert quality.judge(clash, source="g_lang").count() == 14


def test_merging_sketches_is_adding(odd):
    rated = quality.ratios(quality.measure(odd))
    whole = quality.sketches(rated, []).toPandas().set_index(["ratio", "bucket"]).n.to_dict()
    parts = quality.merge(quality.sketches(rated, ["lang"]), []).toPandas().set_index(["ratio", "bucket"]).n.to_dict()
    assert whole == parts


def test_clashing_names(odd):
    got = quality.judge(odd.withColumnRenamed("n_chars", "kept").withColumn("n_words", odd["doc_id"]))
    assert got.columns[:4] == ["doc_id", "text", "lang", "source"] and len(set(got.columns)) == len(got.columns) and got.count() == 14


def test_groups_have_thresholds_of_their_own(spark):
    """Equal documents are kept in one group and rejected in another, by the group's quartiles and by its tail."""
    word = lambda n: "a" * n
    text = lambda size, k: " ".join(f"{word(size)}{chr(97 + k % 20)}{chr(97 + j)}" for j in range(12))
    rows = [(g, text(size + i % 4, i)) for g, size in (("short", 2), ("long", 9)) for i in range(40)] + [("short", text(10, 1)), ("long", text(10, 1))]
    rows += [("short", text(3, i) + "$" * (i % 20 == 7)) for i in range(40)] + [("long", text(10, i) + "$" * (20 * (i % 20 == 7))) for i in range(40)]
    df = spark.createDataFrame([(i, t, "en", g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    judged = quality.judge(df, spread=1, least_docs=20, tail_docs=20).toPandas().set_index("doc_id")
    assert not judged.base_failed.any() and not judged.kept[80] and judged.kept[81]
    rated = quality.ratios(quality.measure(df))
    most = {r.g_source: r for r in quality.thresholds(rated, "lang", "source", least_docs=20, tail_docs=20).collect()}
    assert 0 < most["short"].most_r_symbols < most["long"].most_r_symbols and most["short"].most_r_length < most["long"].most_r_length
