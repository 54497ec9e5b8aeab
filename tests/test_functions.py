"""Column functions and operators on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.functions import catalog, geometry, roles, rules, text
from quillon.operators import joins, sequential, sets, windows
from quillon.sources import documents, files, sinks
from quillon.streaming import events


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, starts, ends",
    [("and so on", True, False), ("The end of", False, True), ("Then", True, False), ("A-", False, True), ("Done.", False, False), ("", False, False), ("Read the", False, True)],
)
def test_cues(spark, given, starts, ends):
    df = spark.createDataFrame([(given,)], "t string")
    r = df.select(text.starts_like_continuation(F.col("t")), text.ends_like_continuation(F.col("t"))).first()
    assert (r[0], r[1]) == (starts, ends)


def test_unicode_space(spark):
    assert one(spark, text.normalize_space(F.col("t")), t="a　 b\n\tc ") == "a b c"


def test_dollars_and_placeholders(spark):
    assert one(spark, text.dollar_balance(F.col("t")), t=r"$a \$ b$ $") == 3
    assert one(spark, text.placeholder_sequence(F.col("t")), t="x <f1-abc/> [[FORMULA_3]] @@P1@@") == ["<f1-abc/>", "[[FORMULA_3]]", "@@P1@@"]


@pytest.mark.parametrize("url, name", [("https://example.com/files/paper.pdf?download=1#top", "paper.pdf"), ("https://example.com/a/", None), ("  ", None)])
def test_url_tail(spark, url, name):
    assert one(spark, text.url_file_name(F.col("t")), t=url) == name


def test_page_ranges(spark):
    assert one(spark, text.parse_page_ranges(F.col("t")), t="1-3,5, 2") == [1, 2, 3, 5]


def test_preview_is_cut(spark):
    assert one(spark, F.length(text.preview(F.col("t"))), t="a" * 300) == 220


def test_keep_reasons(spark):
    rows = [(" ", True, False, ""), ("<f1-abc/>", True, False, ""), ("long enough text here", False, False, ""), ("https://a.example/x", True, False, ""), ("Fig1", True, True, ""), ("Fig1", None, False, "non_flow"), ("Fig1", True, False, "non_flow"), ("Fig.1", True, True, ""), ("some words of text", True, True, "non_flow")]
    df = spark.createDataFrame(rows, "t string, p boolean, c boolean, z string")
    got = [r[0] for r in df.select(rules.keep_reason(rules.Item(*[F.col(c) for c in "tpcz"]))).collect()]
    assert got == ["empty_source_text", "placeholder_only", "policy_skip", "hard_metadata_fragment", "short_non_body_label", "short_non_body_label", None, None, None]


def test_references_and_code(spark):
    assert one(spark, rules.reference_entry(F.col("t")), t="[12] Smith, J. A study. Phys. Rev. 1999, 12-34.") is True
    assert one(spark, rules.code_literal(F.col("t")), t="X(1)=Y(2)+3; DO10I = 1,5 Z[3]=4") is True
    assert one(spark, rules.english_prose(F.col("t")), t="This is a plain sentence with quite a few words in it") is True
    assert one(spark, rules.author_list(F.col("t")), t="Ann Lee, Bo Cruz, Dee Fox and Gil Hart") is True
    assert one(spark, rules.garbled(F.col("t")), t="¤¤¤¤ ¬¬¬ a") is True


def test_roles(spark):
    df = spark.createDataFrame([("", "text", "title", "", [""]), ("", "text", "", "", ["Caption"]), ("", "image", "", "", [""]), ("Heading", "text", "body", "", [""])], "g string, t string, s string, d string, tags array<string>")
    got = [r[0] for r in df.select(roles.layout_role(*[F.col(c) for c in ("g", "t", "s", "d", "tags")])).collect()]
    assert got == ["title", "caption", "unknown", "heading"]


def test_catalog(spark):
    assert one(spark, catalog.user_stage(F.col("t")), t="rendering") == "render"
    assert one(spark, catalog.glossary_level(F.col("t")), t=" Keep ") == "preserve"
    assert one(spark, catalog.error_class(F.col("t"), F.lit(None)), t="Connection reset") == "transport_error"
    assert one(spark, catalog.provider_family(F.col("t"), F.lit("m")), t="https://api.deepseek.com/v1") == "deepseek_official"


def test_boxes(spark):
    assert one(spark, geometry.valid_box(F.array(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.col("t"))), t=1.0) == [0, 0, 2, 1]
    assert one(spark, geometry.valid_box(F.array(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.col("t"))), t=-1.0) is None
    assert one(spark, geometry.array_median(F.array(F.lit(3.0), F.col("t"), F.lit(1.0))), t=9.0) == 3.0


def test_first_wins_keeps_null_signatures(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "i long, s string")
    got = {r["i"]: r["rep"] for r in sets.first_wins(df, F.col("s"), ["i"], "rep", "i").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_overlay(spark):
    base = spark.createDataFrame([("a", 1, 0), ("b", 2, 1)], "k string, v int, p int")
    top = spark.createDataFrame([("b", 9, 0), ("c", 7, 1)], "k string, v int, p int")
    got = [(r["k"], r["v"]) for r in joins.overlay(base, top, "k", ["v"], "p").orderBy("block", "position").collect()]
    assert got == [("a", 1), ("b", 9), ("c", 7)]


def test_whole_word_terms(spark):
    texts = spark.createDataFrame([(1, "The F-center is here"), (2, "no offcenter"), (3, "centers")], "i int, t string")
    terms = spark.createDataFrame([("f-center",), ("center",)], "term string")
    got = sorted((r["i"], r["term"]) for r in joins.term_matches(texts, "t", terms, "term", whole_words=True).collect())
    assert got == [(1, "center"), (1, "f-center")]


def test_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8)], "prev long, next long")
    got = sorted((r["chain"], r["position"], r["node"]) for r in joins.chains(edges).collect())
    assert got == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 4), (7, 0, 7), (7, 1, 8)]


def test_greedy_packing_agrees(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 5, 9, 1, 1, 1, 30, 2])], "g int, i int, n int")
    a = [r["window"] for r in sequential.pack(df, ["g"], ["i"], "n", 3, 12).orderBy("i").collect()]
    b = df.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", F.col("n").cast("long").alias("n")))).alias("m")).select(sequential.pack_array(F.transform("m", lambda x: x["n"]), 3, 12)).first()[0]
    assert a == b == [0, 0, 1, 1, 1, 2, 3, 4]


def test_chain_ids_resume_behind_a_chain(spark):
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate(["join", "join", "candidate", "break", "join", None])], "g int, i int, d string")
    got = [r["group_no"] for r in sequential.chain_ids(df, ["g"], ["i"], "d").orderBy("i").collect()]
    assert got == [1, 1, 1, None, 2, 2]


def test_sequential_functions(spark):
    assert one(spark, sequential.similarity(F.col("t"), F.lit("abcd")), t="abcd") == 1.0
    assert json.loads(one(spark, sequential.lenient_json(F.col("t")), t='```json\n{id: 1, "a": [1,2,],}\n```')) == {"id": 1, "a": [1, 2]}
    assert one(spark, sequential.lenient_json(F.col("t")), t="nothing") is None
    spans = one(spark, sequential.term_spans(F.col("t"), F.array(F.lit("color"), F.lit("color center"))), t="Color centers and color")
    assert [(s["start"], s["stop"]) for s in spans] == [(0, 12), (18, 23)]
    assert " ".join(one(spark, sequential.split_by_weight(F.col("t"), F.array(F.lit(1.0), F.lit(1.0))), t="a b. c d")).split() == ["a", "b.", "c", "d"]


def test_merge_boxes_to_a_fixpoint(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (1, 1.0, 1.0, 4.0, 4.0), (1, 3.0, 3.0, 5.0, 5.0), (1, 9.0, 9.0, 10.0, 10.0)], "g int, x0 double, y0 double, x1 double, y1 double")
    got = sorted(tuple(r)[1:] for r in sequential.merge_boxes(df, ["g"]).collect())
    assert got == [(0.0, 0.0, 5.0, 5.0, 3), (9.0, 9.0, 10.0, 10.0, 1)]


def test_stage_history_and_changes(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a", 1), (1, "2024-01-01 00:00:01", "a", 2), (1, "2024-01-01 00:00:03", "b", 3)], "k int, ts string, s string, i int").withColumn("ts", F.to_timestamp("ts"))
    got = [(r["stage"], r["duration_ms"]) for r in windows.stage_history(df, "k", "ts", "s", "i").orderBy("entered").collect()]
    assert got == [("a", 3000), ("b", None)]
    got = [r["change"] for r in windows.changes(df, "k", ["ts"], ["s"]).orderBy("i").collect()]
    assert got == ["created", "s_changed"]


def test_event_log_and_manifest(spark, tmp_path):
    log = tmp_path / "e.jsonl"
    log.write_text('{"event":"a","job_id":"j"}\n\nnot json\n{"event":"b","job_id":"other"}\n{"event":"c","level":"warn"}\n')
    got = [(r["seq"], r["event"], r["level"], r["event_type"]) for r in files.event_log(spark, str(log), "j", 10).orderBy("seq").collect()]
    assert got == [(11, "a", "info", "a"), (15, "c", "warn", "c")]
    (tmp_path / "p1.json").write_text('[{"item_id":"x"},{"item_id":"y"}]')
    (tmp_path / "m.json").write_text('{"schema":"s","pages":[{"page_index":4,"page_number":5,"path":"p1.json"}]}')
    got = sorted((r["page_idx"], r["item_id"]) for r in files.manifest_pages(spark, str(tmp_path / "m.json"), "item_id string").collect())
    assert got == [(4, "x"), (4, "y")]


def test_glossary_csv_with_and_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Target,Source,Level\nziel,term,keep\n,word,preserve\nx,,\n")
    (tmp_path / "b.csv").write_text("term,ziel\nword,wort,note\n")
    a = sorted((r["source"], r["target"], r["level"]) for r in files.glossary_csv(spark, str(tmp_path / "a.csv")).collect())
    b = sorted((r["source"], r["target"], r["level"]) for r in files.glossary_csv(spark, str(tmp_path / "b.csv")).collect())
    assert a == [("term", "ziel", "preserve"), ("word", "word", "preserve")]
    assert b == [("term", "ziel", "preferred"), ("word", "wort", "preferred")]


def test_document_reader(spark, tmp_path):
    doc = {"schema": documents.SCHEMA_NAME, "document_id": "d", "page_count": 1, "pages": [{"page_index": 0, "blocks": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    read = documents.read_documents(spark, str(tmp_path / "d.json"))
    assert [r["text"] for r in documents.flatten(read).orderBy("block_order").collect()] == ["a", "b"]
    assert documents.problems(read).count() == 0
    (tmp_path / "bad.json").write_text(json.dumps(doc | {"schema": "other"}))
    with pytest.raises(Exception, match="unexpected schema"):
        documents.read_documents(spark, str(tmp_path / "bad.json")).collect()


def test_adapters_replace_in_place():
    known = documents.default_adapters()
    names = list(known.known)
    known.register(names[0], known.known[names[1]])
    assert list(known.known) == names


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "pages")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "page long, t string")
    sinks.save_pages(df, path, ["page"])
    sinks.save_pages(spark.createDataFrame([(2, "c")], "page long, t string"), path, ["page"])
    assert sorted((r["page"], r["t"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    cache = str(tmp_path / "cache")
    keyed = spark.createDataFrame([("aa1", "x"), ("ab2", " ")], "cache_key string, translated string")
    sinks.store_cache(keyed, cache)
    sinks.store_cache(keyed, cache)
    assert [r["cache_key"] for r in sinks.load_cache(spark, cache).collect()] == ["aa1"]
    assert json.loads(sinks.manifest(spark.createDataFrame([(1, "b"), (0, "a")], "p long, f string"), "p", "f").first()["value"])["pages"][0]["path"] == "a"


def test_stream_flush_touches_only_its_partitions(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "click"), (2, "view")], "event_id long, event_type string")
    rows.selectExpr("event_id", "timestamp'2024-01-01' ts", "1L user_id", "event_type", "1.0D value", "'' props").write.parquet(source)
    q = events.read_events(spark, source).writeStream.foreachBatch(events.flush_dirty(out, ["event_type"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_windowed_stream_matches_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(20).selectExpr("id event_id", "timestampadd(SECOND, id * 60, timestamp'2024-01-01') ts", "1L user_id", "'click' event_type", "1.0D value", "'' props").write.parquet(source)
    got = events.run_once(events.windowed(events.read_events(spark, source)), "windowed_test", "complete", str(tmp_path / "cp"))
    assert sorted(r["n"] for r in got.collect()) == [5, 5, 5, 5]
