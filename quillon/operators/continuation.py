"""Text that runs on: hints of a provider's groups, checks of groups over a page break, captions and leaks between neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators.commands import let

# What hints, roles and texts look like.
GLOBAL_GROUP, PAGE_GROUP = "provider-paddle-global-", "provider-paddle-page-%03d-group-%s"
CONFIDENCE = 0.98
HEADS, TAILS = ("head", "single"), ("tail", "single")
FLOW_ZONES = ("single_column", "left_column", "right_column", "full_width")
WHOLE_ZONES = ("single_column", "full_width")
SIDE_CHARS, BOTH_CHARS = 8, 32
ANCHORS = ("image", "table", "code", "formula")
TABLE_ANCHORS, IMAGE_ANCHORS = ("table_html", "table"), ("image_body", "image")
MATH = r"(?<!\\)\$(?:\\.|[^$\\\n])+(?<!\\)\$"
TERMINAL = r"""[.!?。！？；;:：)\]）】”’"'](?U:\s*)$"""
DANGLING = r"[，,、\s]*(?:在|为|是|等于|对于)(?U:\s*)$"
SENTENCE_ENDS = "。！？；"
LEAST_TRIMMED = 8


def token(value: Column) -> Column:
    """An id with anything but letters, digits and _ . - as a single hyphen."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(value.cast("string"), F.lit(""))), "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")


def order_number(value: Column) -> Column:
    """A reading order given as a number or its digits, else null."""
    s = F.trim(value.cast("string"))
    return F.when(s.rlike(r"^-?\d+$"), s.try_cast("long"))


def provider_group(global_id: Column, local_id: Column, page: Column) -> Column:
    """The group a block belongs to: across pages, or within its page; '' for none."""
    whole, part = token(global_id), token(local_id)
    return F.when(whole != "", F.concat(F.lit(GLOBAL_GROUP), whole)).when(part != "", F.format_string(PAGE_GROUP, (page + 1).cast("int"), part)).otherwise("")


def role_in_group(index: Column, size: Column) -> Column:
    return F.when(size <= 1, "single").when(index == 0, "head").when(index == size - 1, "tail").otherwise("middle")


def provider_hints(blocks: DataFrame, document: list[str]) -> DataFrame:
    """blocks with the continuation hint of their provider group.

    blocks has page_index, order, raw_global_group_id, raw_group_id,
    raw_block_order and the column signals merge_suspected, order_unreliable and
    body_repaired. A group with any signal is suppressed as a whole; one of
    several blocks of which one has no reading order gets no hint. A group's
    rows meet in one window, those of no group by document.
    """
    signal = F.coalesce("merge_suspected", F.lit(False)) | F.coalesce("order_unreliable", F.lit(False)) | F.coalesce("body_repaired", F.lit(False))
    b = blocks.withColumns({"_group": provider_group(F.col("raw_global_group_id"), F.col("raw_group_id"), F.col("page_index")), "_number": order_number(F.col("raw_block_order"))})
    whole = Window.partitionBy(*document, "_group")
    ranked = whole.orderBy("page_index", F.coalesce("_number", F.lit(-1)), "order")
    b = b.withColumns({
        "_size": F.count(F.lit(1)).over(whole), "_at": F.row_number().over(ranked) - 1, "_signal": F.max(signal).over(whole),
        "_open": F.max(F.col("_number").isNull()).over(whole), "_pages": F.min("page_index").over(whole) != F.max("page_index").over(whole),
    })
    grouped = F.col("_group") != ""
    hinted = grouped & ~F.col("_signal") & ~((F.col("_size") > 1) & F.col("_open"))
    reason = F.when(F.coalesce("body_repaired", F.lit(False)), "body_repair_applied").otherwise("cross_column_merge_suspected")
    return b.withColumns({
        "hint_source": F.when(hinted, "provider").otherwise(""), "hint_group": F.when(hinted, F.col("_group")).otherwise(""), "hint_role": F.when(hinted, role_in_group(F.col("_at"), F.col("_size"))).otherwise(""),
        "hint_scope": F.when(hinted, F.when(F.col("_pages"), "cross_page").otherwise("intra_page")).otherwise(""), "hint_order": F.when(hinted, F.coalesce("_number", F.lit(-1))).otherwise(-1),
        "hint_confidence": F.when(hinted, CONFIDENCE).otherwise(0.0), "suppressed": grouped & F.col("_signal"), "suppressed_reason": F.when(grouped & F.col("_signal"), reason).otherwise(""),
    }).drop("_group", "_number", "_size", "_at", "_signal", "_open", "_pages")


def footnote_target(label: Column, text: Column, anchor: Column) -> Column:
    """What a caption or footnote belongs to: by its words, else by the anchor before it."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    said = F.when(low.startswith("表注") | low.contains("table"), "table").when(low.startswith("图注") | low.contains("figure"), "image")
    before = F.when(anchor.isin(*TABLE_ANCHORS), "table").when(anchor.isin(*IMAGE_ANCHORS), "image")
    return F.when(label == "figure_title", "figure").when(label == "vision_footnote", F.coalesce(said, before, F.lit("unknown")))


def relations(blocks: DataFrame, page: list[str], order: str) -> DataFrame:
    """blocks (label, text, kind, sub_kind) with ``target``: the last image, table, code or formula before a footnote on its page."""
    before = Window.partitionBy(*page).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.last(F.when(F.col("kind").isin(*ANCHORS), F.coalesce(F.nullif("sub_kind", F.lit("")), F.col("kind"))), ignorenulls=True).over(before)
    return blocks.withColumn("_anchor", anchor).withColumn("target", footnote_target(F.lower(F.trim("label")), F.col("text"), F.col("_anchor"))).drop("_anchor")


def signal_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""))


def zones_meet(mode: Column, zone: Column, next_mode: Column, next_zone: Column) -> Column:
    """From the end of a page's flow to the beginning of the next one's."""
    leaves = F.when(mode == "double", zone == "right_column").otherwise(zone.isin(*WHOLE_ZONES))
    enters = F.when(next_mode == "double", next_zone == "left_column").otherwise(next_zone.isin(*WHOLE_ZONES))
    return zone.isin(*FLOW_ZONES) & next_zone.isin(*FLOW_ZONES) & leaves & enters


def group_validity(items: DataFrame, group: list[str]) -> DataFrame:
    """(group, members, intra_page, cross_page): whether a provider's groups may be joined.

    items has reading_order, page_idx, block_idx, boundary_role, layout_mode,
    layout_zone and text. Two members at least with distinct orders from 0 are
    needed. On one page that is enough; over two, they follow each other, the
    text goes from one to the other exactly once, from a tail to a head, through
    zones that meet, with enough text on both sides.
    """
    w = Window.partitionBy(*group).orderBy(F.coalesce("reading_order", F.lit(-1)), "page_idx", "block_idx")
    lower = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    i = items.select(*group, "reading_order", "page_idx", "block_idx", lower("boundary_role").alias("role"), lower("layout_mode").alias("mode"), lower("layout_zone").alias("zone"), signal_chars(F.col("text")).alias("chars"))
    before = F.struct("page_idx", "role", "mode", "zone", "chars")
    i = i.withColumn("was", F.lag(before).over(w))
    step = F.col("page_idx") - F.col("was.page_idx")
    usable = (
        F.col("was.role").isin(*TAILS) & F.col("role").isin(*HEADS) & zones_meet(F.col("was.mode"), F.col("was.zone"), F.col("mode"), F.col("zone"))
        & (F.col("was.chars") >= SIDE_CHARS) & (F.col("chars") >= SIDE_CHARS) & (F.col("was.chars") + F.col("chars") >= BOTH_CHARS)
    )
    known = F.col("reading_order").isNotNull() & (F.col("reading_order") >= 0)
    g = i.groupBy(*group).agg(
        F.count(F.lit(1)).alias("members"), (F.min(known) & (F.count_distinct("reading_order") == F.count(F.lit(1))) & (F.count(F.lit(1)) >= 2)).alias("ordered"),
        F.min("page_idx").alias("low"), F.max("page_idx").alias("high"), F.count_if(step > 0).alias("turns"), F.coalesce(F.max((step < 0) | (step > 1)), F.lit(False)).alias("jumps"), F.coalesce(F.min(F.when(step > 0, usable)), F.lit(False)).alias("meets"),
    )
    over = F.col("ordered") & (F.col("high") == F.col("low") + 1) & (F.col("turns") == 1) & ~F.col("jumps") & F.col("meets")
    return g.select(*group, "members", (F.col("ordered") & (F.col("low") == F.col("high"))).alias("intra_page"), over.alias("cross_page"))


def math_spans(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MATH), F.lit(0))


def sentence_start(text: Column, before: Column) -> Column:
    """Characters up to the end of the last sentence that ends before a position counted from 0."""
    head = F.substring(text, F.lit(1), before)
    return F.length(F.regexp_extract(head, f"(?s)^(.*[{SENTENCE_ENDS}])", 1))


def trim_leak(translated: Column, source: Column, following: Column) -> Column:
    """(text, leaked): a translation without what it says of the next item.

    Where the source ends in mid-sentence, formulas of the following source that
    the own source lacks tell that its text came along: the translation ends
    before the first of them, without a dangling word; if under eight characters
    are left, at the last sentence's end before it; if still too few, not at all.
    """
    clean = lambda c: F.regexp_replace(c, r"(?U)\s+$", "")
    result = lambda text, leaked: F.struct(text.alias("text"), leaked.alias("leaked"))
    none = F.array().cast("array<string>")
    trimmed_source = F.regexp_replace(F.coalesce(source, F.lit("")), r"(?U)^\s+|\s+$", "")
    incomplete = (trimmed_source != "") & ~trimmed_source.rlike(TERMINAL)

    def cut(leaked: Column) -> Column:
        first = F.array_min(F.transform(leaked, lambda e: F.instr(translated, e))) - 1
        short = clean(F.regexp_replace(clean(F.substring(translated, F.lit(1), first)), DANGLING, ""))
        kept = let(F.struct(first.alias("at"), short.alias("text")), lambda s: F.when(F.length(s["text"]) >= LEAST_TRIMMED, s["text"]).otherwise(clean(F.substring(translated, F.lit(1), sentence_start(translated, s["at"])))))
        return let(kept, lambda k: F.when(F.length(k) >= LEAST_TRIMMED, result(k, F.slice(leaked, 1, 3))).otherwise(result(translated, none)))

    found = let(math_spans(source), lambda own: F.filter(math_spans(following), lambda e: ~F.array_contains(own, e) & (F.instr(translated, e) > 0)))
    leaks = let(found, lambda leaked: F.when(F.size(leaked) > 0, cut(leaked)).otherwise(result(translated, none)))
    return F.when(F.coalesce(incomplete & (translated != "") & (F.coalesce(following, F.lit("")) != ""), F.lit(False)), leaks).otherwise(result(translated, none))
