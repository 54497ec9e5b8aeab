"""Operators without SQL on values worked out by hand or by brute force."""

import hashlib
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.functions import more, roles, rules
from quillon.operators import commands, fitting, joins, pages, protection, sequential, windows
from quillon.sources import documents, files, sinks
from quillon.streaming import events

GLOSSARY = [
    {"source": "the", "target": "der", "level": "canonical", "match_mode": "case_insensitive", "context": ""},
    {"source": "Core", "target": "Kern", "level": "preserve", "match_mode": "exact", "context": "atom"},
]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def tag(letter, n, kind, text):
    return f"<{letter}{n}-{hashlib.blake2s(f'{kind}{chr(0)}{text}'.encode(), digest_size=2).hexdigest()[:3]}/>"


def test_protection_of_formulas_and_terms(spark):
    got = one(spark, protection.protect(GLOSSARY)(F.col("t")), t=r"The sum \alpha_{1}+x^{2} of <f9-abc/> the Core")
    formula = got["protected_map"][1]
    assert [e["token_type"] for e in got["protected_map"]] == ["term", "formula", "term"]
    assert (formula["original_text"], formula["source_offset"]) == (r"\alpha_{1}", 8)  # the wider match is prose
    first = got["protected_map"][0]
    assert (first["token_tag"], first["original_text"], first["restore_text"]) == (tag("t", 1, "term", "The"), "The", "der")
    text = got["text"]
    for e in got["protected_map"]:
        assert e["checksum"] == hashlib.blake2s(f"{e['token_type']}\0{e['original_text']}".encode(), digest_size=2).hexdigest()[:3]
        text = text.replace(e["token_tag"], e["original_text"], 1)
    assert text.replace(" ", "") == r"The sum \alpha_{1}+x^{2} of <f9-abc/> the Core".replace(" ", "")
    near = one(spark, protection.protect(GLOSSARY)(F.col("t")), t="atom and Core")
    assert [e["original_text"] for e in near["protected_map"]] == ["Core"] and near["protected_map"][0]["restore_text"] == "Core"


@pytest.mark.parametrize("text", ["plain words of prose only", r"\beta", "C-H", "a, b, c, d", None, ""])
def test_what_is_no_formula_stays(text):
    assert protection.protected(text, []) == (text or "", [])


def test_glued_prose_is_parted():
    assert protection.protected("x}where", [])[0] == "x} where"


def test_formula_maps_there_and_back(spark):
    p = spark.createDataFrame([("x",)], "t string").select(protection.protect([])(F.lit(r"so \gamma_{2} = 5 it is")).alias("p")).select("p.*")
    formulas = protection.formula_map(F.col("protected_map"))
    got = p.select(formulas.alias("f"), protection.protected_map(formulas).alias("m"), F.col("protected_map")).first()
    assert [e["placeholder"] for e in got["f"]] == [e["token_tag"] for e in got["protected_map"]] and len(got["f"]) == 1
    assert got["m"][0]["checksum"] == got["protected_map"][0]["checksum"] and got["m"][0]["source_offset"] == -1


def brute_lines(ems, box, size):
    room, lines, marked, used, has = max(1.0, box * fitting.LINE_SAFETY / size), 1, 0, 0.0, False
    for width, formula in zip(ems.width, ems.formula):
        if used > 0 and used + width > room + 1e-9:
            marked, lines, used, has = marked + has, lines + 1, 0.0, False
        if width > room:
            lines, used = lines + math.ceil(width / room) - 1, width % room
        else:
            used += width
        has = has or formula
    return lines, marked + has


def test_lines_against_a_loop():
    rng = random.Random(7)
    pieces = ["中", "word ", "a ", "longer-than/most_lines ", "$x^{2}$ ", "，", "\n", "⟦FORMULA_1⟧", "x" * 30 + " "]
    for _ in range(400):
        ems = fitting.Ems.of("".join(rng.choice(pieces) for _ in range(rng.randrange(60))), {"⟦FORMULA_1⟧": r"\frac{a}{b}"})
        box, size = rng.uniform(5, 300), rng.uniform(6, 20)
        assert ems.lines(box, size) == brute_lines(ems, box, size)
    assert fitting.Ems.of("", {}).lines(10, 5) == (1, 0) and fitting.Ems.of("a", {}).lines(0, 5) == (1, 0)
    assert fitting.Ems.of("中文 ab, $x$", {}).width.tolist() == pytest.approx([1, 1, 0.32, 1.1, 0.62, 0.32, 0.89])


def test_solved_size_is_the_largest_that_fits(spark):
    rows = [(200.0, 60.0, "words and 中文 text " * 9), (90.0, 12.0, "too much " * 30), (300.0, 500.0, "little")]
    df = spark.createDataFrame(rows, "w double, h double, t string")
    none = F.array().cast("array<struct<placeholder:string,formula_text:string>>")
    got = df.select("w", "h", "t", fitting.solve("w", "h", "t", none, F.lit(0.2), F.lit(6.0), F.lit(14.0)).alias("g")).collect()
    for r in got:
        ems = fitting.Ems.of(r["t"], {})
        sizes = [7.8 + i * 0.01 for i in range(621)]
        fits = [s for s in sizes if ems.height(r["w"], s, 0.2)[0] <= r["h"]]
        assert r["g"]["size"] == 7.8 if not fits else abs(r["g"]["size"] - max(fits)) <= 0.1 or ems.height(r["w"], r["g"]["size"], 0.2)[0] <= r["h"]
    assert [r["g"]["size"] for r in got][1:] == [7.8, pytest.approx(14.0, abs=0.05)]


def test_fit_plans(spark):
    none = F.array().cast("array<struct<placeholder:string,formula_text:string>>")
    one_ = F.array(F.struct(F.lit("p").alias("placeholder"), F.lit(r"\frac{a}{b}_2").alias("formula_text")))
    est = lambda h, r: F.struct(F.lit(h).alias("height"), F.lit(r).alias("formula_ratio"))
    df = spark.range(1)
    low = df.select(fitting.plan(F.lit(100.0), F.lit("abc"), none, F.lit(10.0), est(20.0, 0.0)).alias("p")).first()["p"]
    force = lambda x, s: max(0.0, min(1.0, (1 / (1 + math.exp(-s * x)) - 0.5) * 2))
    assert low["size"] == round(10 + round(0.35 * force((0.86 - 0.2) / 0.86, 5.0), 3), 2) and low["reasons"] == ["underfilled_body"] and low["mode"] == "continuous_fit"
    high = df.select(fitting.plan(F.lit(100.0), F.lit("a b c"), one_, F.lit(10.0), est(150.0, 0.2)).alias("p")).first()["p"]
    share, complexity = round(1 / (1 + 3 / 12), 3), round(0.16 + 0.025, 3)
    trust = max(0.22, math.exp(-1.35 * (0.2 * 0.65 + share * 0.55 + 0.26 + complexity * 0.45)))
    fill = 1.5 * (1 - 0.18 * force(0.2 * 0.42 + share * 0.38 + 0.05, 3.0))
    assert high["overflow"] == pytest.approx(fill) and high["trust"] == pytest.approx(trust)
    assert high["size"] == round(10 - round(0.4 * force(fill - 0.86, 4.2) * trust * trust, 3), 2)
    assert high["reasons"] == ["height_pressure", "formula_weighted", "formula_complexity", "formula_count_weighted"]
    capped = df.select(fitting.plan(F.lit(100.0), F.lit("abc"), none, F.lit(7.0), est(20.0, 0.0), F.lit(7.05)).alias("p")).first()["p"]
    assert capped["size"] == 7.8


def test_block_trees_of_any_depth(spark):
    tree = '[{"t":"a","k":"algorithm","children":[{"t":"b"},{"t":"c","children":[{"t":"d","children":[{"t":"e"}]}]}]},{"t":"f"}]'
    df = spark.createDataFrame([("x", 0, tree), ("x", 1, "[]"), ("y", 4, None)], "document_id string, page_index int, blocks string")
    flat = documents.tree_items(df, inherits=F.get_json_object("block", "$.k") == "algorithm")
    got = {(r["item_id"], r["t"], r["inside"]) for r in flat.withColumn("t", F.get_json_object("block", "$.t")).collect()}
    assert got == {("p001-b000", "a", True), ("p001-b000-i000", "b", True), ("p001-b000-i001", "c", True), ("p001-b000-i001-i000", "d", True), ("p001-b000-i001-i000-i000", "e", True), ("p001-b001", "f", False)}


@pytest.mark.parametrize(
    "text, prefix",
    [
        ("run --fast in.txt > out.txt and then wait for all the other jobs to finish", "run --fast in.txt > out.txt"),
        ("tool <input> -v 3 makes the long table that everybody will read", "tool <input> -v 3"),
        ("Run the model and then wait for all the other jobs to finish", ""),
        ("run --fast in.txt > out.txt and on", ""),
        ("sort a.csv then look over the many lines that remain there", ""),
        ("", ""), (None, ""),
    ],
)
def test_command_prefix(spark, text, prefix):
    assert spark.createDataFrame([(text,)], "t string").select(commands.command_prefix(F.col("t"))).first()[0] == prefix


def test_garbled_formulas(spark):
    cases = [("", False), ("α" * 8, True), (r"{\bf x}{\bf y}", True), (r"{{α}} {{ \alpha }}", True), (r"\mathrm{a}\mathrm{b}\text{c}" + "x" * 200, False), ("α" * 4 + "x" * 180, True), ("α" * 4, False)]
    df = spark.createDataFrame(cases, "t string, want boolean")
    assert [r[0] for r in df.filter(rules.garbled_formula(F.col("t")) != F.col("want")).collect()] == []


def test_items_to_rebuild(spark):
    long = "some words of a text " * 8
    rows = [("text", True, long, "", [], False, True), ("text", True, long, "done", [], False, False), ("text", True, long, "done", ["α" * 9], False, True), ("text", True, long, "", [], True, False), ("image", True, long, "", [], False, False), ("text", True, "ASMALL " + "x " * 50, "done", [], False, True)]
    df = spark.createDataFrame(rows, "k string, p boolean, s string, t string, f array<string>, i boolean, want boolean")
    assert df.filter(rules.rebuilds(*[F.col(c) for c in "kpstfi"]) != F.col("want")).count() == 0


def test_rights_notices(spark):
    cases = [("Copyright 2020 A. B. All rights reserved.", True), ("Copyright: written permission of the owner", False), ("all rights", False), ("copyright " * 40, False)]
    df = spark.createDataFrame(cases, "t string, want boolean")
    assert df.filter(rules.hard_metadata(F.col("t")) != F.col("want")).count() == 0


def test_structure_role_from_metadata(spark):
    got = one(spark, roles.structure_role(F.lit("unknown"), F.lit(" Body"), F.lit("paragraph"), F.lit("body"), F.col("m")), m=" Sidebar")
    assert got == "sidebar"


def test_checksum(spark):
    assert one(spark, sequential.checksum(F.lit("formula"), F.col("t")), t="x^2") == hashlib.blake2s(b"formula\0x^2", digest_size=2).hexdigest()[:3]


def test_smoothing_and_limits(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([10.0, 40.0, 5.0, 6.0])], "g int, i int, v double")
    assert [r["smoothed"] for r in sequential.smooth(df, ["g"], ["i"], "v", 10.0).orderBy("i").collect()] == [10.0, 20.0, 10.0, 6.0]
    steps = [(100.0, False)] * 12 + [(100.0, True), (95_000.0, False), (50_000.0, False)] + [(1.0, False)] * 12
    df = spark.createDataFrame([(1, i, ms, bad) for i, (ms, bad) in enumerate(steps)], "g int, i int, ms double, bad boolean")
    got = [r["limit_after"] for r in sequential.adaptive_limit(df, "g", ["i"], "ms", "bad").orderBy("i").collect()]
    assert got[:12] == [8] * 12 and got[12:15] == [4, 3, 3] and got[15:26] == [3] * 11 and got[26] == 4


def test_cycles_are_in_no_chain(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (20, 20)], "prev long, next long")
    assert sorted((r["chain"], r["position"], r["node"]) for r in joins.chains(edges).collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]
    assert joins.chains(edges.limit(0)).count() == 0


def test_terms_within_words(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "The F-Center is here"), (2, "nothing"), (3, None), (4, "centers")], "i int, t string")
    terms = spark.createDataFrame([("CENTER", 7), ("he", 8), ("ent", 9)], "term string, n int")
    want = [(1, "CENTER", 7), (1, "ent", 9), (1, "he", 8), (4, "CENTER", 7), (4, "ent", 9)]
    got = lambda: sorted((r["i"], r["term"], r["n"]) for r in joins.term_matches(texts, "t", terms, "term", whole_words=False).collect())
    assert got() == sorted(want)
    monkeypatch.setattr(joins, "TERM_ROWS", 1)
    assert got() == sorted(want)
    assert joins.term_matches(texts, "t", terms.limit(0), "term", whole_words=False).count() == 0


def test_numbering_over_runs(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.random()) for g in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(5)
    got = {(r["g"], r["i"]): r["n"] for r in windows.numbered(df, ["g"], F.expr("i div 7"), ["i"], "n").collect()}
    assert got == {(g, i): i + 1 for g, i, _ in rows}


def brute_split(text, capacities):
    """The scoring of the first pass, position by position."""
    t = sequential.BoxText(text, {}, False)
    ends, at, n = [], 0, len(t.tokens)
    room = [max(1.0, c) for c in capacities]
    s = sequential.SPLIT
    for i in range(len(room) - 1):
        most, rest, later = n - (len(room) - i - 1), t.upto[n] - t.upto[at], sum(room[i + 1 :])
        aim = rest * room[i] / max(1.0, sum(room[i:]))
        anchor = at + 1
        while anchor < most and t.upto[anchor] - t.upto[at] < min(aim, room[i] * s["fill"]):
            anchor += 1
        weights = s["roomy_weights"] if room[i] >= 2 * later else s["weights"]
        best = None
        for p in range(at + 1, most + 1):
            solid = "".join(t.tokens[at:p]).rstrip()
            stop = bool(solid) and solid.endswith(sequential.SPLIT_PUNCTUATION)
            if not (stop or abs(p - anchor) <= 24 or p in (at + 1, most)):
                continue
            here = t.upto[p] - t.upto[at]
            score = max(0, here - room[i] * 1.01) * weights[0] + max(0, rest - here - later * 1.03) * weights[1] + abs(here - aim) + max(0, room[i] * 0.55 - here) * 0.1 + (0 if stop else 1.25)
            if best is None or score < best[0] - 1e-9:
                best = (score, p)
        at = best[1]
        ends.append(at)
    return ends


def test_box_split_against_brute_force():
    rng = random.Random(5)
    import numpy as np

    for _ in range(30):
        text = " ".join(rng.choice(["word", "longer", "a", "end.", "stop,", "中文", "x1"]) for _ in range(rng.randrange(8, 120)))
        room = [rng.uniform(5, 80) for _ in range(rng.randrange(2, 5))]
        t = sequential.BoxText(text, {}, False)
        r = np.maximum(1.0, np.array(room))
        assert sequential._first_ends(t, r, r) == brute_split(text, room)
        parts = sequential.split_for_boxes(text, {}, room)
        assert len(parts) == len(room) and "".join("".join(p.split()) for p in parts) == "".join(text.split())
    assert sequential.split_for_boxes("", {}, [1.0, 2.0]) == ["", ""] and sequential.split_for_boxes(" a ", {}, [5.0]) == ["a"]
    even = sequential.split_for_boxes("one two three. four five six. seven eight nine.", {}, [14.0, 14.0, 14.0])
    assert even == ["one two three.", "four five six.", "seven eight nine."]


def test_metadata_zone_and_page_sizes(spark):
    import json

    page = [{"type": "text", "sub_type": s, "bbox": [0, 0, 5, 6], "text": s} for s in ("title", "body", "heading", "body", "body")]
    flat = json.dumps({"provider": "p", "pages": [{"width": 9, "height": 8, "blocks": page}]})
    listed = json.dumps([[{"type": "text", "bbox": [0, 0, 50, 60], "content": [{"text": "a"}, {"text": "b"}]}, {"type": "text", "bbox": [0, 0, 70, 20], "content": [{"text": "c"}]}]])
    para = json.dumps({"pdf_info": [{"page_idx": 3, "page_size": [1, 2], "para_blocks": [{"type": "text", "bbox": [0, 0, 1, 1], "lines": [{"spans": [{"content": "x"}, {"content": "y"}]}, {"spans": [{"content": "z"}]}]}]}]})
    raw = spark.createDataFrame([("f", flat), ("l", listed), ("p", para), ("none", "{}"), ("null", None)], "document_id string, raw string")
    got = documents.default_adapters().normalize(raw).orderBy("document_id", "block_order").collect()
    assert [r["sub_type"] for r in got if r["document_id"] == "f"] == ["title", "metadata", "heading", "body", "body"]
    assert [(r["text"], r["page_width"], r["page_height"]) for r in got if r["document_id"] == "l"] == [("ab", 70.0, 60.0), ("c", 70.0, 60.0)]
    assert [(r["text"], r["page_index"], r["page_width"]) for r in got if r["document_id"] == "p"] == [("x y\nz", 3, 1.0)]
    assert {r["document_id"] for r in got} == {"f", "l", "p"}


def test_peak_of_a_key_larger_than_an_arrow_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rng = random.Random(1)
    rows = [(i, i * 7919 % 5000) for i in range(5000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, at long").repartition(3)
    df.selectExpr("event_id", "timestampadd(SECOND, at, timestamp'2024-01-01') ts", "1L user_id", "'click' event_type", "1.0D value", "'' props").write.parquet(source)
    run = peak = 0
    for i, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        run += 1 if i % 2 == 0 else -1
        peak = max(peak, run)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = events.run_once(events.gauge(events.read_events(spark, source, 100)), "gauge_test", "update", str(tmp_path / "cp"), ("event_type",)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r["running"], r["peak"]) for r in got] == [(run, peak)]


def test_update_stream_keeps_the_last_row_of_a_key(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).selectExpr("id event_id", "timestamp'2024-01-01' ts", "1L user_id", "'click' event_type", "double(id) value", "'' props").coalesce(1).write.mode("append").parquet(source)
    got = events.run_once(events.term_memory(events.read_events(spark, source, 1)), "memory_test", "update", str(tmp_path / "cp"), ("term",)).collect()
    assert [(r["term"], r["hits"]) for r in got] == [("click", 30)]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.txt", "1")
        z.writestr("two.txt", "22")
        z.mkdir("empty")
    got = sorted((r["name"], r["size"], bytes(r["content"])) for r in files.zip_members(spark, str(tmp_path / "a.zip")).collect())
    assert got == [("two.txt", 2, b"22"), ("x/one.txt", 1, b"1")]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../up.txt", "1")
    with pytest.raises(Exception, match="leads out"):
        files.zip_members(spark, str(tmp_path / "bad.zip")).collect()


def test_manifest_lists_files_in_folders(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "p 1+.json").write_text('[{"item_id":"x"}]')
    (tmp_path / "unlisted.json").write_text('[{"item_id":"no"}]')
    (tmp_path / "m.json").write_text('{"schema":"s","pages":[{"page_index":4,"page_number":5,"path":"deep/p 1+.json"}]}')
    assert [tuple(r) for r in files.manifest_pages(spark, str(tmp_path / "m.json"), "item_id string").select("page_idx", "item_id").collect()] == [(4, "x")]
    (tmp_path / "twice.json").write_text('{"schema":"s","pages":[{"page_index":4,"path":"a.json"},{"page_index":4,"path":"b.json"}]}')
    with pytest.raises(ValueError, match="twice"):
        files.manifest_pages(spark, str(tmp_path / "twice.json"), "item_id string")


def test_appended_events_and_run_report(spark, tmp_path):
    import json

    df = spark.createDataFrame([(1, "a", None), (2, None, 3.0)], "seq long, event string, value double")
    sinks.append_events(df, str(tmp_path / "log"))
    sinks.append_events(df.limit(1), str(tmp_path / "log"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "log")).collect())
    assert lines == ['{"seq":1,"event":"a"}', '{"seq":1,"event":"a"}', '{"seq":2,"value":3.0}']
    doc = sinks.run_report(spark.createDataFrame([(3, "book")], "pages int, mode string"), {"requests": spark.createDataFrame([(7,)], "slow int")})
    assert json.loads(doc.first()["value"]) == {"pages": 3, "mode": "book", "requests": {"slow": 7}}


def test_job_ids(spark):
    got = spark.range(200).select(more.job_id(F.current_timestamp()).alias("i")).collect()
    assert all(len(r["i"]) == 21 and r["i"][14] == "-" and int(r["i"][15:], 16) >= 0 for r in got) and len({r["i"] for r in got}) > 190
