import pytest
from pyspark.sql import functions as F

from quillon.operators import typography as Y

LINE = "array<struct<x0:double,y0:double,x1:double,y1:double,spans:array<struct<type:string,content:string>>>>"
ITEM = f"page int, kind string, caption boolean, footnote boolean, x0 double, y0 double, x1 double, y1 double, text string, lines {LINE}"
TEXT = "forty and more characters are what a candidate needs to have"


def lines(n, pitch, height, *kinds):
    return [(0.0, float(i * pitch), 180.0, float(i * pitch + height), [(k, "word " * 4) for k in kinds or ("text",)]) for i in range(n)]


def item(ls, text=TEXT, kind="text", note=None, x1=200.0, y1=60.0):
    return (1, kind, note, None, 0.0, 0.0, x1, y1, text, ls)


def base(spark, *items):
    r = Y.page_baseline(spark.createDataFrame(list(items), ITEM), ["page"]).first()
    return tuple(round(r[c], 4) for c in ("font_size", "line_pitch", "line_height", "chars_per_line"))


DEFAULT = (11.4, 0.0, 0.0, 0.0)


@pytest.mark.parametrize(
    ("items", "want"),
    [
        # local pitch: three lines from 0 to 30 and the padding 2.2 over three lines
        ([item(lines(3, 10, 10))], (round(10 * 0.98 * 0.9215, 4), round((30 + 2.2) / 3, 4), 10.0, 16.0)),
        ([item(lines(2, 10, 10))], DEFAULT),
        ([item(None)], DEFAULT),
        ([item(None, text="three\nlines of it, with some more\nand forty characters at least")], (14.2, 20.0, 0.0, 0.0)),
        ([item(lines(3, 10, 10), text="short")], DEFAULT),
        ([item(lines(3, 10, 10), note=True)], DEFAULT),
        ([item(lines(3, 10, 10), kind="table")], DEFAULT),
        ([item(lines(3, 10, 10, "text", "inline_equation", "inline_equation"))], DEFAULT),
        ([item(lines(3, 12, 0))], (8.4 if 12 * 0.82 * 0.9215 < 8.4 else round(12 * 0.82 * 0.9215, 4), 8.0, 0.0, 16.0)),
        ([item(lines(3, 10, 10)), item(None, x1=900.0), item(None, x1=900.0)], DEFAULT),
    ],
)
def test_baseline(spark, items, want):
    assert base(spark, *items) == want


def test_medians(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([4.0, 1.0],), ([],), ([7.0],)], "v array<double>")
    assert [r.m for r in df.select(Y.median(F.col("v")).alias("m")).collect()] == [2.0, 2.5, 0.0, 7.0]


PAYLOAD = "page int, at int, x0 double, y0 double, x1 double, y1 double, font double, leading double, demand double, discount double, dense boolean, context boolean, text_chars int, wide double"


def payload(at, height=60.0, width=200.0, font=10.0, demand=80.0, dense=False, context=True, chars=80):
    return (1, at, 0.0, 0.0, width, height, font, 0.4, demand, 1.0, dense, context, chars, 200.0)


def test_tall_boxes_count_with_a_part_of_their_height(spark):
    """Four lines of ten points need 56; a box of 300 is more than 1.35 times the page's ratio."""
    rows = [payload(1), payload(2), payload(3, height=300.0), payload(4, height=300.0, dense=True), payload(5, height=300.0, font=0.0)]
    got = {r["at"]: r.density_height for r in Y.with_density(spark.createDataFrame(rows, PAYLOAD), ["page"]).collect()}
    assert got == {1: 60.0, 2: 60.0, 3: 174.0, 4: 300.0, 5: 300.0}


def test_targets_of_dense_pages(spark):
    rows = [payload(1, font=9.0, dense=True), payload(2, font=11.0, dense=True)]
    assert Y.body_targets(spark.createDataFrame(rows, PAYLOAD), ["page"]).first().font == 10.0
    assert Y.body_targets(spark.createDataFrame([*rows, payload(3, font=12.0)], PAYLOAD), ["page"]).first().font == 12.0


def test_anchors_and_their_fallback(spark):
    at = lambda rows: sorted((r["at"], r["rank"]) for r in Y.stable_anchors(spark.createDataFrame(rows, PAYLOAD), ["page"], "at", "wide").collect())
    assert at([payload(1), payload(2, height=70.0), payload(3, height=90.0), payload(4, height=20.0)]) == [(2, 2), (3, 1)]
    assert at([payload(1), payload(2)]) == [(1, 1), (2, 2)]
    assert at([payload(1), payload(2, dense=True), payload(3, width=130.0, demand=40.0), payload(4, height=17.0), payload(5, context=False)]) == [(1, 1), (3, 2)]
    assert at([payload(1), payload(2, dense=True), payload(3, width=110.0), payload(4, height=18.0)]) == [(1, None), (2, None), (4, None)]


def seeds(spark, *items, body=True):
    df = spark.createDataFrame(list(items), ITEM)
    candidate = Y.body_candidate(F.col("kind") == "text", F.lit(""), F.lit("body"), F.lit(body))
    return [(r.is_body, r.seed_font, r.seed_leading, r.page_body_font, r.page_body_width) for r in Y.seed_metrics(df, ["page"], F.col("kind") == "text", candidate).orderBy("x1", "text").collect()]


def test_seeds_by_hand(spark):
    """Three lines of ten points on 200 x 60, ninety per cent wide and half the height: compactness 0.0 for 50 characters but 0.08 for lines, 0.21 and 0.05 for density."""
    (got,) = seeds(spark, item(lines(3, 10, 10)))
    chars = len(TEXT.replace(" ", ""))
    compact = 0.08 + (0.9 - 0.76) / 0.16 * 0.24 + (0.5 - 0.4) / 0.24 * 0.12 + (max(0, chars - 52) / 220 if chars >= 52 else 0)
    own = round(10 * 0.98 * 0.9215, 2)
    page, weight = 10 * 0.98 * 0.9215, max(0.74, 0.86 - compact * 0.18)
    font = round((page * weight + own * (1 - weight)) * (1 - min(0.04, compact * 0.055)), 2)
    pitch = (30 + 2.2) / 3
    base = ((pitch / font - 1) * 0.35 + max(0.5, 0.56 - compact * 0.07) * 0.65) * 0.988 * (1 - min(0.015, compact * 0.07))
    leading = round(min(0.68, max(base, 0.52 * 0.988, 0.44 / 0.9)), 2)
    assert got == (True, font, leading, round(max(font, page - 0.38), 2), 200.0)


def test_seeds_of_other_kinds(spark):
    note, table, bare = item(lines(3, 10, 10), note=True, x1=201.0), item(lines(3, 10, 10), kind="table", x1=202.0), item(None, text="short", x1=203.0)
    got = seeds(spark, note, table, bare)
    assert [g[0] for g in got] == [False, False, False] and got[0][1] == max(8.4, round(10 * 0.98 * 0.9215 * 0.92, 2)) and got[1][1] == got[2][1] == 11.4
    assert all(g[3] is None and g[4] is None for g in got)
    assert got[2][2] == round((60 / 11.4 - 1) * 0.55 * 0.988 + 0.48 * 0.45 * 0.988, 2) or got[2][2] == 0.56
