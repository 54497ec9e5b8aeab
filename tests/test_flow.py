"""Commands, continuation groups, leaks and terms against plain Python."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillon.functions import terms
from quillon.operators import commands, continuation

PROSE = "and then wait for all the other jobs to finish"


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()[0]


def test_prefix_is_linear(spark):
    """Ten times the words take about ten times as long, not a hundred times."""
    took = {}
    for n in (800, 8000, 80_000):
        df = spark.createDataFrame([("run --fast in.txt > out.txt " + "word " * n,)] * 4, "t string").coalesce(1)
        q = df.select(F.length(commands.command_prefix(F.col("t"))).alias("n"))
        assert {r.n for r in q.collect()} == {27}
        began = time.perf_counter()
        q.collect()
        took[n] = time.perf_counter() - began
    assert took[80_000] < 30 * took[8000] + 0.5


def test_long_prefix(spark):
    many = "tool " + "-a 1 " * 2000
    assert one(spark, "t string", (many + "x.txt",), commands.command_prefix(F.col("t"))) == ""
    assert one(spark, "t string", (many + PROSE,), commands.command_prefix(F.col("t"))) == many.strip()


@pytest.mark.parametrize(
    ("text", "lines", "want"),
    [
        (None, [], ("keep_all", "", "local")),
        ("  ", ["  "], ("keep_all", "", "local")),
        ("X(I,J) = K(I,J)+2.5D0 Y_1 = Z(I)*3", [], ("keep_all", "", "local")),
        (f"run --fast in.txt > out.txt {PROSE}", [], ("translate_tail", "run --fast in.txt > out.txt", "local")),
        (f"we go {PROSE}", [f"we go {PROSE}"], ("translate_all", "", "local")),
        (f"{PROSE} make -j 4", [PROSE, "make -j 4"], ("translate_all", "", "fallback")),
        ("it is so", ["it is so"], ("keep_all", "", "fallback")),
    ],
)
def test_decisions(spark, text, lines, want):
    d = one(spark, "t string, l array<string>", (text, lines), commands.local_decision(F.col("t"), F.col("l")))
    assert (d.action, d.prefix, d.by) == want


HINTED = "page_index int, order int, raw_global_group_id string, raw_group_id string, raw_block_order string, merge_suspected boolean, order_unreliable boolean, body_repaired boolean"


def hints(spark, rows):
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, " + HINTED)
    out = continuation.provider_hints(df, ["doc"]).orderBy("page_index", "order").collect()
    return [(r.hint_group, r.hint_role, r.hint_scope, r.hint_order, r.hint_confidence, r.suppressed_reason) for r in out]


def test_hints(spark):
    far = "provider-paddle-global-a-b"
    assert hints(spark, [(0, 0, " a b ", None, "3", None, None, None), (1, 0, "a/b", "x", "0", None, None, None), (1, 1, "a b", None, "1", None, None, None)]) == [
        (far, "head", "cross_page", 3, 0.98, ""), (far, "middle", "cross_page", 0, 0.98, ""), (far, "tail", "cross_page", 1, 0.98, "")]
    assert hints(spark, [(4, 0, "--", "7", None, None, None, None)]) == [("provider-paddle-page-005-group-7", "single", "intra_page", -1, 0.98, "")]
    assert hints(spark, [(0, 0, None, "7", "1", None, None, None), (0, 1, None, "7", "x", None, None, None)]) == [("", "", "", -1, 0.0, "")] * 2
    assert hints(spark, [(0, 0, None, "7", "1", True, None, None), (0, 1, None, "7", "2", None, None, True), (1, 0, None, "7", "2", None, None, None)]) == [
        ("", "", "", -1, 0.0, "cross_column_merge_suspected"), ("", "", "", -1, 0.0, "body_repair_applied"), ("provider-paddle-page-002-group-7", "single", "intra_page", 2, 0.98, "")]
    assert hints(spark, [(0, 0, None, None, "1", True, None, None)]) == [("", "", "", -1, 0.0, "")]


MEMBER = "reading_order int, page_idx int, block_idx int, boundary_role string, layout_mode string, layout_zone string, text string"
TAIL, HEAD = (3, 0, 9, "tail", "", "single_column", "x" * 20), (4, 1, 10, " Head", "single", "full_width", "y " * 20)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([TAIL, HEAD], (False, True)),
        ([TAIL], (False, False)),
        ([TAIL, (5, 0, 3, *TAIL[3:])], (True, False)),
        ([TAIL, (4, 2, *HEAD[2:])], (False, False)),
        ([(5, *TAIL[1:]), HEAD], (False, False)),
        ([(4, *TAIL[1:]), HEAD], (False, False)),
        ([(None, *TAIL[1:]), HEAD], (False, False)),
        ([(*TAIL[:3], "middle", *TAIL[4:]), HEAD], (False, False)),
        ([TAIL, (*HEAD[:3], "tail", *HEAD[4:])], (False, False)),
        ([(*TAIL[:4], "double", "right_column", TAIL[6]), (*HEAD[:4], "double", "left_column", HEAD[6])], (False, True)),
        ([(*TAIL[:4], "double", "left_column", TAIL[6]), HEAD], (False, False)),
        ([(*TAIL[:5], "header", TAIL[6]), HEAD], (False, False)),
        ([TAIL, (*HEAD[:6], "too few")], (False, False)),
        ([(*TAIL[:6], "x" * 12), (*HEAD[:6], "y" * 19)], (False, False)),
        ([TAIL, HEAD, (6, 1, 12, "middle", "", "", "z")], (False, True)),
        ([TAIL, HEAD, (6, 0, 12, "middle", "", "", "z")], (False, False)),
    ],
)
def test_group_validity(spark, rows, want):
    r = continuation.group_validity(spark.createDataFrame([("g", *r) for r in rows], "g string, " + MEMBER), ["g"]).first()
    assert (r.intra_page, r.cross_page) == want


def leak(said, source, following):
    """What is left of a translation, by searching character by character."""
    spans = lambda t: [m.group() for m in re.finditer(r"(?<!\\)\$(?:\\.|[^$\\\n])+(?<!\\)\$", t or "")]
    if not said or not following or not (source or "").strip() or re.search(r"""[.!?。！？；;:：)\]）】”’"']\s*$""", source.strip()):
        return said
    foreign = [e for e in spans(following) if e not in spans(source) and e in said]
    if not foreign:
        return said
    at = min(said.index(e) for e in foreign)
    rest = re.sub(r"[，,、\s]*(?:在|为|是|等于|对于)\s*$", "", said[:at].rstrip()).rstrip()
    if len(rest) < 8:
        rest = said[: max((k + 1 for k in range(at) if said[k] in "。！？；"), default=0)].rstrip()
    return rest if len(rest) >= 8 else said


def test_leaks(spark):
    rng = random.Random(4)
    parts = ["$a$", "$b_1$", r"\$ ", r"$c\$d$", "text ", "。", "对于", "，在 ", "long enough words ", "；", ". ", " and", "$", "\n"]
    text = lambda k: "".join(rng.choice(parts) for _ in range(k))
    rows = [(i, text(rng.randrange(9)), text(rng.randrange(1, 6)), text(rng.randrange(1, 6))) for i in range(1500)] + [(1500, None, "a", "b"), (1501, "a $b$", None, "$b$"), (1502, "a", "b", None)]
    df = spark.createDataFrame(rows, "i int, said string, src string, nx string").withColumn("d", continuation.trim_leak(F.col("said"), F.col("src"), F.col("nx")))
    got = {r.i: (r.d.text, len(r.d.leaked or [])) for r in df.collect()}
    want = {i: leak(said, src, nx) for i, said, src, nx in rows}
    assert {i: g[0] for i, g in got.items()} == want
    cut = [i for i, said, _, _ in rows if want[i] != said]
    assert len(cut) > 30 and all(1 <= got[i][1] <= 3 for i in cut)


def test_terms(spark):
    said = "采用了支持向量机（简称SVM-1）和 卷积网络(or Conv Net)，以及的（of）、滤波（Kalman）. GPU/TPU v2 用于 Deep Learning"
    source = "Deep  Learning on GPU/TPU With The SVM-1 or Q. Größe"
    got = [tuple(c) for c in one(spark, "s string, t string", (source, said), terms.candidates(F.col("s"), F.col("t")))]
    pair = lambda k, v: (k, v, "explicit_pair", 1.0)
    assert got == [pair("SVM-1", "采用了支持向量机"), pair("of", "以及的"), pair("Kalman", "滤波"), pair("Conv Net", "卷积网络"), pair("of", "以及的"), pair("Kalman", "滤波"), ("Deep Learning", "Deep Learning", "identity_technical_token", 0.55)]
    assert one(spark, "s string, t string", (None, None), terms.candidates(F.col("s"), F.col("t"))) == []


@pytest.mark.parametrize(("key", "value", "want"), [("SVM", "支持向量机", True), ("SVM", "svm", True), ("SVM", "被用的机器", False), ("the", "the", False), ("a b c d e", "词", False), ("Net", "很长很长很长很长的", False), ("Net", "网，络", False), ("Net", "word", False), (None, "词", None)])
def test_terms_that_may_be_shown(spark, key, value, want):
    assert one(spark, "k string, v string", (key, value), terms.allowed(F.col("k"), F.col("v"))) in ((want,) if want is not None else (None, False))
