"""Page typography: baselines from line boxes, body targets, stable anchors and capacities of narrow boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import more as M
from quillon.operators.commands import let

# Scales, limits and ratios that results depend on.
DEFAULT_FONT, LEAST_FONT, MOST_LOCAL_FONT, BODY_FACTOR = 11.4, 8.4, 14.2, 0.9215
HEIGHT_SCALE, PITCH_SCALE, BASELINE = 0.98, 0.82, 0.42
PADDING_RATIO, PADDING_MOST = 0.22, 2.2
CANDIDATE_LINES, CANDIDATE_CHARS, CANDIDATE_FORMULAS, CANDIDATE_WIDTH = 3, 40, 0.5, 0.6
DENSITY_LEAST, DENSITY_MOST = 0.82, 0.92
TALL_LINES, TALL_HEIGHT, TALL_RATIO, TALL_PAGE_RATIO, TALL_NATURAL, TALL_ORIGINAL = 3, 35.0, 1.8, 1.35, 1.45, 0.58
ANCHORS, ANCHOR_WIDTH, ANCHOR_HEIGHT, ANCHOR_DENSITY = 2, 0.58, 30.0, 1.18
FALLBACK_WIDTH, FALLBACK_HEIGHT, TEXT_SCORE = 0.72, 18.0, 180.0
NARROW, RELAXED = 0.78, 0.72
SCALE_LEAST, SCALE_MOST, CAPTION_SCALE, FOOTNOTE_SCALE, FOOTNOTE_LEAST = 0.97, 1.03, 0.92, 0.78, 6.6
BLEND, BLEND_LEAST, BLEND_SLOPE, COMPACT_MOST, COMPACT_SLOPE = 0.86, 0.74, 0.18, 0.04, 0.055
BODY_WIDTH, BODY_SHORT, BODY_PERCENTILE, BODY_FLOOR = 0.75, 36, 0.46, 0.38
COMPACT_CHARS, COMPACT_LINES, COMPACT_X, COMPACT_Y, COMPACT_FORMULAS, COMPACTNESS_MOST = 52, 3, 0.76, 0.40, 0.08, 0.7
LEADING, LEADING_FACTOR, BODY_LEADING, OTHER_LEADING = 0.48, 0.988, (0.44, 0.68), (0.26, 0.56)
TARGET, TARGET_LEAST, TARGET_SLOPE, TIGHT_MOST, TIGHT_SLOPE, NORMAL_LEADING = 0.56, 0.50, 0.07, 0.015, 0.07, 0.52
DENSE_RATIO, FORMULA_RATIO = 0.9, 0.92


def median(values: Column) -> Column:
    """Median of an array's numbers, 0 if there are none."""
    return let(F.array_sort(values), lambda v: F.when(F.size(v) == 0, 0.0).otherwise((F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2))


def positive(values: Column) -> Column:
    return F.filter(values, lambda v: v > 0)


def visible(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))


def line_height(lines: Column) -> Column:
    """Median height of the lines that have one."""
    return median(positive(F.transform(lines, lambda x: x["y1"] - x["y0"])))


def line_pitch(lines: Column) -> Column:
    """Median distance between the centres of lines that follow each other downwards."""
    centres = F.transform(lines, lambda x: (x["y0"] + x["y1"]) / 2)
    return let(centres, lambda c: median(positive(F.zip_with(F.slice(c, F.lit(2), F.greatest(F.lit(0), F.size(c) - 1)), F.slice(c, F.lit(1), F.greatest(F.lit(0), F.size(c) - 1)), lambda a, b: a - b))))


def font_metric(height: Column, pitch: Column) -> Column:
    return F.when(height > 0, height * HEIGHT_SCALE).when(pitch > 0, pitch * PITCH_SCALE).otherwise(0.0)


def text_height(lines: Column, height: Column, box_height: Column) -> Column:
    """From the first line's top to the last one's bottom and a padding, at most the box."""
    raw = F.array_max(F.transform(lines, lambda x: x["y1"])) - F.array_min(F.transform(lines, lambda x: x["y0"]))
    padding = F.when(height > 0, F.least(F.lit(PADDING_MOST), height * PADDING_RATIO)).otherwise(0.0)
    return F.when((F.size(lines) > 0) & (raw > 0), F.least(box_height, raw + padding)).otherwise(box_height)


def chars_per_line(lines: Column) -> Column:
    plain = F.transform(lines, lambda x: visible(F.array_join(F.transform(F.filter(x["spans"], lambda s: s["type"] == "text"), lambda s: s["content"]), "")))
    return median(positive(plain))


def formula_ratio(lines: Column) -> Column:
    kinds = F.flatten(F.transform(lines, lambda x: F.transform(x["spans"], lambda s: s["type"])))
    count = lambda k, kind: F.size(F.filter(k, lambda t: t == kind))
    return let(kinds, lambda k: F.when(count(k, "text") + count(k, "inline_equation") > 0, count(k, "inline_equation") / (count(k, "text") + count(k, "inline_equation"))).otherwise(0.0))


def clamp(c: Column, least: float | Column, most: float | Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, float) else x
    return F.greatest(as_column(least), F.least(as_column(most), c))


def occupied_width(lines: Column, width: Column) -> Column:
    """Median width of the lines but for the last, as a part of the box."""
    widths = F.transform(lines, lambda x: F.greatest(F.lit(0.0), x["x1"] - x["x0"]))
    return F.when(width > 0, median(positive(F.slice(widths, F.lit(1), F.greatest(F.lit(1), F.size(widths) - 1)))) / width).otherwise(0.0)


def occupied_height(lines: Column, height: Column) -> Column:
    total = F.aggregate(F.transform(lines, lambda x: F.greatest(F.lit(0.0), x["y1"] - x["y0"])), F.lit(0.0), lambda a, h: a + h)
    return F.when(height > 0, total / height).otherwise(0.0)


def compactness(chars: Column, lines: Column, across: Column, down: Column, formulas: Column) -> Column:
    """How densely a source is set, from 0 to 0.7: points for text, lines, width, height and formulas."""
    points = lambda c, value: F.when(c, value).otherwise(0.0)
    total = (
        points(chars >= COMPACT_CHARS, F.least(F.lit(0.22), (chars - COMPACT_CHARS) / 220.0)) + points(lines >= COMPACT_LINES, F.least(F.lit(0.3), (lines - (COMPACT_LINES - 1)) * 0.08))
        + points(across >= COMPACT_X, F.least(F.lit(0.24), (across - COMPACT_X) / 0.16 * 0.24)) + points(down >= COMPACT_Y, F.least(F.lit(0.12), (down - COMPACT_Y) / 0.24 * 0.12)) + points(formulas >= COMPACT_FORMULAS, F.lit(0.08))
    )
    return F.when(chars < BODY_SHORT, 0.0).otherwise(clamp(total, 0.0, COMPACTNESS_MOST))


def measured(items: DataFrame, page: list[str]) -> DataFrame:
    """items with what their lines and boxes measure, under names that begin with m_.

    items has kind, caption, footnote, x0 to y1, text and lines: [(x0, y0, x1, y1,
    spans: [(type, content)])]. Without lines the text's own lines are counted.
    """
    c = F.col
    lines = F.coalesce("lines", F.array().cast(items.schema["lines"].dataType))
    note = F.coalesce(c("caption"), F.lit(False)) | F.coalesce(c("footnote"), F.lit(False))
    explicit = F.size(F.filter(F.split("text", "\n"), lambda s: F.trim(s) != ""))
    i = items.withColumns({"m_lines": lines, "m_note": note, "m_width": F.greatest(F.lit(0.0), c("x1") - c("x0")), "m_box": F.greatest(F.lit(0.0), c("y1") - c("y0")), "m_chars": visible(c("text"))})
    i = i.withColumns({
        "m_height": line_height(c("m_lines")), "m_pitch": line_pitch(c("m_lines")), "m_per_line": chars_per_line(c("m_lines")), "m_formulas": formula_ratio(c("m_lines")), "m_across": occupied_width(c("m_lines"), c("m_width")), "m_down": occupied_height(c("m_lines"), c("m_box")),
        "m_n": F.when(F.size("m_lines") > 0, F.size("m_lines")).otherwise(F.greatest(F.lit(1), F.coalesce(explicit, F.lit(0)))), "m_wide": F.median(F.when((c("kind") == "text") & ~c("m_note"), c("m_width"))).over(Window.partitionBy(*page)),
    })
    local = text_height(c("m_lines"), c("m_height"), c("m_box")) / c("m_n")
    return i.withColumns({"m_local": F.when(local > 0, local).otherwise(c("m_pitch")), "m_metric": font_metric(c("m_height"), c("m_pitch")), "m_compact": compactness(c("m_chars"), c("m_n"), c("m_across"), c("m_down"), c("m_formulas"))}).drop("m_lines")


def page_baseline(items: DataFrame, page: list[str]) -> DataFrame:
    """(page, font_size, line_pitch, line_height, chars_per_line) of every page (items as for ``measured``).

    What counts are texts of three lines and forty characters that aren't narrow
    nor mostly formulas, captions or footnotes. The font comes from their own
    metrics, else from their line heights, else from the pitch; a page without
    any has the default and zeros.
    """
    return _baseline(measured(items, page), page)


def _baseline(i: DataFrame, page: list[str]) -> DataFrame:
    c = F.col
    chosen = (c("kind") == "text") & ~c("m_note") & (c("m_n") >= CANDIDATE_LINES) & (c("m_chars") >= CANDIDATE_CHARS) & (c("m_formulas") <= CANDIDATE_FORMULAS) & ~((c("m_wide") > 0) & (c("m_width") < c("m_wide") * CANDIDATE_WIDTH))
    i = i.withColumn("m_chosen", F.coalesce(chosen, F.lit(False)))
    at = lambda name: F.coalesce(F.percentile(F.when(c("m_chosen") & (c(name) > 0), c(name)), F.lit(BASELINE)), F.lit(0.0))
    p = i.groupBy(*page).agg(at("m_local").alias("p"), at("m_height").alias("h"), at("m_metric").alias("m"), F.coalesce(F.median(F.when(c("m_chosen") & (c("m_per_line") > 0), c("m_per_line"))), F.lit(0.0)).alias("chars"))
    metric = F.when(c("m") > 0, c("m")).when(c("h") > 0, c("h") * HEIGHT_SCALE).otherwise(c("p") * PITCH_SCALE)
    known = metric > 0
    zero = lambda name: F.when(known, c(name)).otherwise(0.0)
    return p.select(*page, F.when(known, clamp(metric * BODY_FACTOR, LEAST_FONT, MOST_LOCAL_FONT)).otherwise(DEFAULT_FONT).alias("font_size"), zero("p").alias("line_pitch"), zero("h").alias("line_height"), zero("chars").alias("chars_per_line"))


def body_candidate(plain: Column, layout: Column, semantic: Column, bodylike: Column) -> Column:
    """Running text long and wide enough to tell a page's type by; a narrow one needs two lines and a body's role."""
    c = F.col
    narrow = (c("m_wide") > 0) & (c("m_width") < c("m_wide") * BODY_WIDTH)
    kind = plain | layout.isin("paragraph", "list_item")
    return ~c("m_note") & kind & F.coalesce(semantic, F.lit("")).isin("", "body", "abstract") & (c("m_formulas") <= CANDIDATE_FORMULAS) & (~narrow | (bodylike & (c("m_chars") >= BODY_SHORT) & (c("m_n") >= 2))) & (c("m_chars") >= CANDIDATE_CHARS)


def local_font(textual: Column) -> Column:
    """The font that an item's own lines tell, smaller for captions and footnotes."""
    own = F.col("m_metric") * BODY_FACTOR
    sized = F.when(F.coalesce("footnote", F.lit(False)), clamp(own * FOOTNOTE_SCALE, FOOTNOTE_LEAST, MOST_LOCAL_FONT)).when(F.coalesce("caption", F.lit(False)), clamp(own * CAPTION_SCALE, LEAST_FONT, MOST_LOCAL_FONT)).otherwise(clamp(own, LEAST_FONT, MOST_LOCAL_FONT))
    return F.when(textual & (F.col("m_metric") > 0), F.bround(sized, 2)).otherwise(DEFAULT_FONT)


def seed_font(textual: Column, body: Column) -> Column:
    """An item's font: its own, for body text blended with the page's by how compact it is (page columns as of ``page_baseline``)."""
    c = F.col
    ratio = F.when((c("line_pitch") > 0) & (c("m_local") > 0), c("m_local") / c("line_pitch")).when((c("line_height") > 0) & (c("m_height") > 0), c("m_height") / c("line_height")).otherwise(1.0)
    page = F.when(c("font_size") > 0, c("font_size") * clamp(ratio, SCALE_LEAST, SCALE_MOST)).otherwise(c("m_font"))
    weight = F.greatest(F.lit(BLEND_LEAST), F.lit(BLEND) - c("m_compact") * BLEND_SLOPE)
    blend = (page * weight + c("m_font") * (1.0 - weight)) * (1.0 - F.least(F.lit(COMPACT_MOST), c("m_compact") * COMPACT_SLOPE))
    return F.when(~textual, DEFAULT_FONT).when(body, F.bround(clamp(blend, LEAST_FONT, MOST_LOCAL_FONT), 2)).otherwise(c("m_font"))


def seed_leading(font: Column, body: Column) -> Column:
    """An item's leading: what its pitch tells, mixed with a target, not below what dense lines and formulas need."""
    c = F.col
    told = lambda pitch: pitch / font - 1.0
    pitch = F.when(c("m_local") > 0, c("m_local")).otherwise(c("line_pitch"))
    target = F.greatest(F.lit(TARGET_LEAST), F.lit(TARGET) - c("m_compact") * TARGET_SLOPE)
    flowing = F.when((pitch > 0) & (font > 0), told(pitch) * 0.35 + target * 0.65).otherwise(target) * LEADING_FACTOR * (1.0 - F.least(F.lit(TIGHT_MOST), c("m_compact") * TIGHT_SLOPE))
    flowing = F.greatest(flowing, F.lit(NORMAL_LEADING * LEADING_FACTOR))
    other = F.when((c("m_local") > 0) & (font > 0), told(c("m_local")) * 0.55 + LEADING * 0.45).otherwise(LEADING) * LEADING_FACTOR

    def held(base: Column, span: tuple[float, float], dense: float, formulas: float) -> Column:
        base = F.greatest(base, F.when(c("m_across") >= dense, span[0] / DENSE_RATIO).otherwise(0.0), F.when(c("m_formulas") >= formulas, span[0] / FORMULA_RATIO).otherwise(0.0))
        return F.bround(clamp(base, *span), 2)

    # what has no floor may be negative before it is clamped
    return F.when(body, held(flowing, BODY_LEADING, 0.86, 0.08)).otherwise(held(other, OTHER_LEADING, 0.9, 0.12))


def seed_metrics(items: DataFrame, page: list[str], textual: Column, body: Column, digits: int = 2) -> DataFrame:
    """items with their page's baseline and ``is_body``, ``seed_font``, ``seed_leading``; ``page_body_font`` and ``page_body_width`` (null without body text).

    ``textual`` says what has text of its own and ``body`` is a ``body_candidate``.
    A page's body font is a percentile of its body's fonts, not far below the baseline, to ``digits`` places.
    """
    c = F.col
    i = measured(items, page).withColumn("m_font", local_font(textual))
    base = _baseline(i, page)
    i = i.join(base.withColumnsRenamed({p: f"_{p}" for p in page}), [c(p) == c(f"_{p}") for p in page]).drop(*[f"_{p}" for p in page])
    i = i.withColumn("is_body", F.coalesce(body, F.lit(False))).withColumn("seed_font", seed_font(textual, c("is_body")))
    i = i.withColumn("seed_leading", seed_leading(c("seed_font"), c("is_body")))
    w = Window.partitionBy(*page)
    font = F.bround(F.percentile(F.when(c("is_body") & (c("seed_font") > 0), c("seed_font")), F.lit(BODY_PERCENTILE)).over(w), digits)
    lifted = F.when(c("font_size") > 0, F.bround(F.greatest(font, c("font_size") - BODY_FLOOR), digits)).otherwise(font)
    i = i.withColumns({"page_body_font": F.when(font.isNotNull(), lifted), "page_body_width": F.median(F.when(c("is_body"), c("m_width"))).over(w)})
    return i.drop(*[n for n in i.columns if n.startswith("m_")])


def with_density(payloads: DataFrame, page: list[str]) -> DataFrame:
    """payloads with width, height, density_height and density (estimated height of the text in it).

    payloads has x0 to y1, font, leading, demand (units of text), discount (of
    formulas), dense (a box too small for its text) and context (running body
    text). A context box much taller than its text, also measured by its page,
    counts with a part of its height.
    """
    c = F.col
    lines = M.required_lines(c("x0"), c("x1"), c("demand"), c("font"))
    i = payloads.withColumns({"width": F.greatest(F.lit(0.0), c("x1") - c("x0")), "height": F.greatest(F.lit(0.0), c("y1") - c("y0")), "_lines": F.when(c("font") > 0, lines).otherwise(1)})
    natural = F.when((c("font") > 0), c("font") * F.greatest(F.lit(1), c("_lines")) * (1.0 + F.greatest(F.lit(0.0), c("leading")))).otherwise(0.0)
    tall = c("context") & ~c("dense") & (c("_lines") >= TALL_LINES) & (c("height") >= TALL_HEIGHT) & (natural > 0)
    i = i.withColumn("_natural", natural).withColumn("_ratio", F.when(tall, c("height") / c("_natural")))
    i = i.withColumn("_page", F.greatest(F.lit(1.0), F.median("_ratio").over(Window.partitionBy(*page))))
    part = F.least(c("height"), F.greatest(c("height") * TALL_ORIGINAL, c("_natural") * TALL_NATURAL))
    loose = (c("_ratio") >= TALL_RATIO) & (c("_ratio") >= c("_page") * TALL_PAGE_RATIO) & (part < c("height") - 0.5)
    i = i.withColumn("density_height", F.greatest(F.lit(8.0), F.when(loose, F.round(part, 2)).otherwise(c("y1") - c("y0"))))
    estimate = lines * F.greatest(c("font") * 1.02, c("font") * (1.0 + c("leading"))) * c("discount")
    return i.withColumn("density", estimate / c("density_height")).drop("_lines", "_natural", "_ratio", "_page")


def body_targets(payloads: DataFrame, page: list[str]) -> DataFrame:
    """(page, font, density, pressure): medians over a page's body, of the fonts of boxes that aren't dense if there are any, and the density within its limits."""
    c = F.col
    i = with_density(payloads, page)
    pressure = c("demand") / F.greatest(F.lit(1.0), F.greatest(F.lit(8.0), c("x1") - c("x0")) * c("density_height"))
    t = i.groupBy(*page).agg(F.median(F.when(~c("dense"), c("font"))).alias("stable"), F.median("font").alias("all"), F.median("density").alias("d"), F.median(pressure).alias("pressure"))
    return t.select(*page, F.coalesce("stable", "all").alias("font"), F.greatest(F.lit(DENSITY_LEAST), F.least(F.lit(DENSITY_MOST), c("d"))).alias("density"), "pressure")


def stable_anchors(payloads: DataFrame, page: list[str], order: str, text_width: str) -> DataFrame:
    """The anchors of each page's body font, with ``rank`` or null where the fallback applies.

    The two best of the wide, high boxes that aren't dense, by height, width and
    text; where fewer than two qualify, all wide boxes of running text instead.
    ``text_width`` is the page's median width of texts.
    """
    c = F.col
    i = with_density(payloads, page)
    usable = c("context") & (c("font") > 0)
    wide = lambda ratio: c("width") >= F.greatest(F.lit(1.0), c(text_width) * ratio)
    first = usable & ~c("dense") & wide(ANCHOR_WIDTH) & (c("height") >= ANCHOR_HEIGHT) & (c("density") <= ANCHOR_DENSITY)
    second = usable & wide(FALLBACK_WIDTH) & (c("height") >= FALLBACK_HEIGHT)
    score = c("height") * 2.0 + c("width") * 0.25 + F.least(F.lit(TEXT_SCORE), c("text_chars").cast("double"))
    w = Window.partitionBy(*page)
    i = i.withColumns({"_first": F.coalesce(first, F.lit(False)), "_second": F.coalesce(second, F.lit(False)), "_score": score})
    i = i.withColumns({"_n": F.count_if(c("_first")).over(w), "_rank": F.row_number().over(w.orderBy(F.desc("_first"), F.desc("_score"), order))})
    enough = c("_n") >= ANCHORS
    return i.filter((enough & c("_first") & (c("_rank") <= ANCHORS)) | (~enough & c("_second"))).withColumn("rank", F.when(enough, c("_rank"))).drop("_first", "_second", "_score", "_n", "_rank")


def relaxed_capacity(items: DataFrame, group: list[str], order: str, width: str, capacity: str) -> DataFrame:
    """items with ``relaxed``: a box much narrower than its two neighbours in the group holds less than its capacity, by the ratio of widths but not below a limit."""
    w = Window.partitionBy(*group).orderBy(order)
    around = (F.lag(width).over(w) + F.lead(width).over(w)) / 2
    between = (F.lag(width).over(w) > 0) & (F.lead(width).over(w) > 0) & (F.col(width) > 0)
    i = items.withColumns({"_around": around, "_between": F.coalesce(between, F.lit(False))})
    ratio = F.col(width) / F.col("_around")
    narrow = F.col("_between") & (F.col(width) < F.col("_around") * NARROW)
    return i.withColumn("relaxed", F.when(narrow, F.col(capacity) * F.greatest(ratio, F.lit(RELAXED))).otherwise(F.col(capacity))).drop("_around", "_between")
