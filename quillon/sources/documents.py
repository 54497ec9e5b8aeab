"""Nested page documents: schema, readers, format detection and adapters to one flat block table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import roles as R
from quillon.sources.shared import written

SCHEMA_NAME, SCHEMA_VERSION = "normalized_document_v1", "1.1"
BLOCK = "block_id string, page_index bigint, `order` bigint, reading_order bigint, type string, sub_type string, bbox array<double>, text string, tags array<string>, layout_role string, semantic_role string, structure_role string, derived struct<role:string,by:string,confidence:double>, metadata map<string,string>, lines array<struct<bbox:array<double>,spans:array<struct<type:string,content:string,bbox:array<double>>>>>"


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(f"{p.split(' ', 1)[0]}:{p.split(' ', 1)[1]}" for p in _fields(ddl)) + ">"


def _fields(ddl: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [*out, now.strip()]


DOCUMENT = f"schema string, schema_version string, document_id string, page_count bigint, pages array<struct<page_index:bigint, width:double, height:double, unit:string, blocks:array<{_struct(BLOCK)}>>>"
GENERIC = "provider string, pages array<struct<width:double, height:double, unit:string, blocks:array<struct<type:string, sub_type:string, derived:struct<role:string>, bbox:array<double>, text:string>>>>"
CONTENT_LIST = "array<array<struct<type:string, bbox:array<double>, content:array<struct<type:string, text:string>>>>>"
LAYOUT_PARSING = "layoutParsingResults array<struct<prunedResult:struct<width:double, height:double, parsing_res_list:array<struct<block_label:string, block_content:string, block_bbox:array<double>>>>>>"
PARA_BLOCKS = "pdf_info array<struct<page_idx:bigint, page_size:array<double>, para_blocks:array<struct<type:string, bbox:array<double>, lines:array<struct<spans:array<struct<type:string, content:string>>>>>>>>"

#: what every adapter makes of a raw document
PAGES = "array<struct<page_index:bigint, width:double, height:double, blocks:array<struct<type:string, sub_type:string, bbox:array<double>, text:string>>>>"
#: the flat block table that normalising returns
FLAT = ["document_id", "page_index", "page_width", "page_height", "block_order", "type", "sub_type", "bbox", "text"]

# Labels of layout blocks that hold text, and those that never belong to the body.
TEXT_LABELS = ("abstract", "aside_text", "doc_title", "figure_title", "footnote", "header", "number", "paragraph_title", "reference_content", "text", "vision_footnote")
SIDE_LABELS = ("aside_text", "footnote", "footer", "footer_image", "header", "header_image", "number", "vision_footnote")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole normalized JSON documents, one per file; rows of another schema are errors."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    named = F.assert_true(F.col("schema").eqNullSafe(F.lit(SCHEMA_NAME)), F.concat(F.lit("unexpected schema: "), F.coalesce("schema", F.lit("none"))))
    return docs.filter(named.isNull())


def pages(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", F.posexplode("pages").alias("page_at", "page")).select("document_id", "page_at", "page.*")


def flatten(docs: DataFrame) -> DataFrame:
    """One row per block of normalized documents."""
    p = pages(docs).select("document_id", F.col("page_at").cast("long").alias("page_index"), F.posexplode("blocks").alias("at", "b"))
    return p.select("document_id", "page_index", F.col("at").cast("long").alias("block_order"), "b.type", "b.sub_type", "b.bbox", "b.text")


Adapter = Callable[[Column], tuple[Column, Column]]


def _page(index: Column, width: Column, height: Column, blocks: Column) -> Column:
    return F.struct(index.cast("long").alias("page_index"), width.cast("double").alias("width"), height.cast("double").alias("height"), blocks.alias("blocks"))


def _block(kind: Column, sub_type: Column, bbox: Column, text: Column) -> Column:
    return F.struct(kind.alias("type"), sub_type.alias("sub_type"), bbox.alias("bbox"), text.alias("text"))


def _farthest(blocks: Column, edge: int, at: str = "bbox") -> Column:
    """Greatest right (2) or lower (3) edge of a page's boxes, 0 without boxes."""
    return F.coalesce(F.array_max(F.transform(blocks, lambda b: F.get(b[at], F.lit(edge)))), F.lit(0.0))


def generic(raw: Column) -> tuple[Column, Column]:
    """Flat pages of blocks. A body block between a title and an abstract or heading names authors: metadata."""
    doc = F.from_json(raw, GENERIC)
    kind = lambda b: F.coalesce(F.nullif(R.plain(b["type"]), F.lit("")), F.lit("text"))
    sub = lambda b: F.coalesce(F.nullif(R.plain(b["sub_type"]), F.lit("")), F.lit("body"))
    role = lambda b: F.coalesce(F.nullif(R.plain(b["derived"]["role"]), F.lit("")), sub(b))

    def blocks(page: Column) -> Column:
        every = page["blocks"]
        beside = lambda i: F.when(i >= 0, role(F.get(every, i)))
        between = lambda i: (beside(i - 1) == "title") & (i + 1 < F.size(every)) & beside(i + 1).isin("abstract", "heading")
        gap = lambda b, i: (kind(b) == "text") & (sub(b) == "body") & F.coalesce(between(i), F.lit(False))
        return F.transform(every, lambda b, i: _block(b["type"], F.when(gap(b, i), "metadata").otherwise(b["sub_type"]), b["bbox"], b["text"]))

    pages = F.transform(doc["pages"], lambda p, i: _page(i, p["width"], p["height"], blocks(p)))
    return F.get_json_object(raw, "$.pages[0].blocks").isNotNull() & F.get_json_object(raw, "$.provider").isNotNull(), pages


def content_list(raw: Column) -> tuple[Column, Column]:
    """Pages as lists of blocks with segments; a page is as large as its boxes reach."""
    text = lambda b: F.array_join(F.transform(b["content"], lambda s: s["text"]), "")
    blocks = lambda p: F.transform(p, lambda b: _block(b["type"], F.lit(""), b["bbox"], text(b)))
    pages = F.transform(F.from_json(raw, CONTENT_LIST), lambda p, i: _page(i, _farthest(p, 2), _farthest(p, 3), blocks(p)))
    return F.get_json_object(raw, "$[0][0].content").isNotNull(), pages


def para_blocks(raw: Column) -> tuple[Column, Column]:
    """Pages of paragraphs of lines of spans."""
    line = lambda x: F.array_join(F.transform(x["spans"], lambda s: s["content"]), " ")
    blocks = lambda p: F.transform(p["para_blocks"], lambda b: _block(b["type"], F.lit(""), b["bbox"], F.array_join(F.transform(b["lines"], line), "\n")))
    pages = F.transform(F.from_json(raw, PARA_BLOCKS)["pdf_info"], lambda p: _page(p["page_idx"], F.get(p["page_size"], F.lit(0)), F.get(p["page_size"], F.lit(1)), blocks(p)))
    return F.get_json_object(raw, "$.pdf_info").isNotNull(), pages


def layout_parsing(raw: Column) -> tuple[Column, Column]:
    """Pages of labelled layout blocks."""
    blocks = lambda r: F.transform(r["parsing_res_list"], lambda b: _block(b["block_label"], F.lit(""), b["block_bbox"], b["block_content"]))
    pages = F.transform(F.from_json(raw, LAYOUT_PARSING)["layoutParsingResults"], lambda p, i: _page(i, p["prunedResult"]["width"], p["prunedResult"]["height"], blocks(p["prunedResult"])))
    return F.get_json_object(raw, "$.layoutParsingResults").isNotNull(), pages


class Adapters:
    """Ordered registry of (name, adapter); registering a name again replaces it in place.

    An adapter makes of a raw JSON column the test whether the text is of its
    format, and the document's pages.
    """

    def __init__(self):
        self.known: dict[str, Adapter] = {}

    def register(self, name: str, adapter: Adapter) -> None:
        self.known[name] = adapter

    def detect(self, raw: Column) -> Column:
        """Name of the first adapter whose test holds, or 'unknown'."""
        return F.coalesce(*[F.when(F.coalesce(a(raw)[0], F.lit(False)), F.lit(n)) for n, a in self.known.items()], F.lit("unknown"))

    def normalize(self, df: DataFrame, raw: str = "raw") -> DataFrame:
        """Blocks of every recognised row (document_id, raw JSON) with its provider; the input is read once."""
        tagged = df.select("document_id", F.col(raw).alias("raw"), self.detect(F.col(raw)).alias("provider"))
        parsed = F.coalesce(*[F.when(F.col("provider") == n, a(F.col("raw"))[1].cast(PAGES)) for n, a in self.known.items()])
        p = tagged.select("document_id", "provider", F.explode(parsed).alias("p")).select("document_id", "provider", "p.page_index", F.col("p.width").alias("page_width"), F.col("p.height").alias("page_height"), F.posexplode("p.blocks").alias("o", "b"))
        return p.withColumn("block_order", F.col("o").cast("long")).select("*", "b.*").select(*FLAT, "provider")


def default_adapters() -> Adapters:
    found = Adapters()
    for name, a in (("generic_flat_ocr", generic), ("content_list_v2", content_list), ("para_blocks", para_blocks), ("layout_parsing", layout_parsing)):
        found.register(name, a)
    return found


def column_signals(flat: DataFrame) -> DataFrame:
    """flat with each block's column, its page's column mode and where two columns were merged.

    A page is double if either side has two texts (or slots) of a column's
    width, or one each beside an empty box. On such a page a text next to an
    empty box of the other column at the same height has probably absorbed that
    box's text.
    """
    page = Window.partitionBy("document_id", "page_index")
    edge = lambda i: F.coalesce(F.get("bbox", F.lit(i)), F.lit(0.0))
    valid, width = F.coalesce(F.size("bbox"), F.lit(0)) == 4, F.col("page_width")
    span = edge(2) - edge(0)
    label, text = R.plain(F.col("type")), F.trim(F.coalesce("text", F.lit("")))
    guess = F.when(~valid | (width <= 0) | width.isNull(), "unknown").when(F.greatest(F.lit(0.0), span) >= width * 0.62, "full").when((edge(0) + edge(2)) / 2 <= width / 2, "left").otherwise("right")
    d = flat.withColumns({"column": guess, "empty": valid & (F.length(text) < 2), "centre": (edge(0) + edge(2)) / 2, "sized": label.isin(*TEXT_LABELS) & valid & (span / F.nullif(width, F.lit(0.0))).between(0.18, 0.48), "side": label.isin(*SIDE_LABELS)})
    slots = {s: F.count_if(F.col("sized") & (F.col("column") == s)).over(page) for s in ("left", "right")}
    texts = {s: F.count_if(F.col("sized") & (F.col("column") == s) & (text != "")).over(page) for s in ("left", "right")}
    middle = {s: F.median(F.when(F.col("sized") & (F.col("column") == s) & (text != ""), F.col("centre"))).over(page) for s in ("left", "right")}
    hollow = F.max(F.col("empty") & F.col("column").isin("left", "right")).over(page)
    sparse = ((slots["left"] >= 2) & (slots["right"] >= 2)) | ((slots["left"] >= 1) & (slots["right"] >= 1) & hollow)
    double = (width > 0) & (((texts["left"] >= 2) & (texts["right"] >= 2)) | sparse)
    mode = F.when((width <= 0) | width.isNull(), "unknown").when(double, "double").otherwise("single")
    split = F.when(double, F.coalesce((middle["left"] + middle["right"]) / 2, width / 2)).otherwise(F.when(width > 0, width / 2).otherwise(0.0))
    d = d.withColumns({"mode": mode, "split_x": F.bround(split, 3)})
    seen = F.struct("column", "empty", "side", F.lit(1).alias("there"), edge(1).alias("top"), edge(3).alias("bottom"), (~valid).alias("lost"))
    d = d.withColumn("own", seen)
    own = F.col("own")

    def meets(other: Column) -> Column:
        shared = F.least(own["bottom"], other["bottom"]) - F.greatest(own["top"], other["top"])
        height = F.least(F.greatest(F.lit(1.0), own["bottom"] - own["top"]), F.greatest(F.lit(1.0), other["bottom"] - other["top"]))
        sides = own["column"].isin("left", "right") & other["column"].isin("left", "right") & (own["column"] != other["column"])
        bodies = ~own["side"] & ~other["side"] & ~own["lost"] & ~other["lost"]
        return F.coalesce((F.col("mode") == "double") & sides & bodies & (own["empty"] != other["empty"]) & (shared >= height * 0.25), F.lit(False))

    order = page.orderBy("block_order")
    d = d.withColumns({"before": meets(F.lag("own").over(order)), "after": meets(F.lead("own").over(order))})
    hit = F.col("before") | F.col("after")
    peer = F.when(F.col("after"), F.col("block_order") + 1).when(F.col("before"), F.col("block_order") - 1)
    return d.select(*flat.columns, "column", "mode", "split_x", hit.alias("suspected"), (hit & F.col("empty")).alias("text_missing"), (hit & ~F.col("empty")).alias("absorbed"), peer.alias("peer_order"))


def signal_summary(signals: DataFrame) -> DataFrame:
    """Per document: pages and blocks under suspicion, and every page's mode and counts in order."""
    p = signals.groupBy("document_id", "page_index").agg(F.first("mode").alias("mode"), F.count_if("suspected").alias("suspected"), F.count_if("text_missing").alias("missing"), F.count_if("absorbed").alias("absorbed"))
    pages = F.array_sort(F.collect_list(F.struct("page_index", "mode", "suspected", "missing", "absorbed")))
    return p.groupBy("document_id").agg(F.count_if(F.col("suspected") > 0).alias("suspicious_pages"), F.sum("suspected").alias("suspicious_blocks"), pages.alias("pages"))


def tree_items(pages_of: DataFrame, children: str = "children", inherits: Column | None = None) -> DataFrame:
    """One row per block of the block trees in (document_id, page_index, blocks): blocks is a JSON array.

    An id is p, the page from 1, -b and the place of the top block, and -i with
    its place for every level below. ``inherits`` tells of a block (JSON column
    ``block``) what holds for all blocks under it, too, such as being part of an
    algorithm. Every level of the trees is one pass; their depth is unbounded.
    """
    own = F.coalesce(inherits, F.lit(False)) if inherits is not None else F.lit(False)
    listed = lambda c: F.from_json(c, "array<string>")
    level = pages_of.select("document_id", "page_index", F.posexplode(listed(F.col("blocks"))).alias("block_index", "block"))
    level = level.withColumns({"item_id": F.format_string("p%03d-b%03d", F.col("page_index") + 1, "block_index"), "inside": own, "depth": F.lit(0)})
    out: DataFrame | None = None
    while True:
        level = written(level, "blocks")
        if level.limit(1).count() == 0:
            return level if out is None else out
        out = level if out is None else out.unionByName(level)
        below = level.select("document_id", "page_index", "block_index", "item_id", "inside", "depth", F.posexplode(listed(F.get_json_object("block", f"$.{children}"))).alias("i", "block"))
        level = below.select("document_id", "page_index", "block_index", "block", F.concat("item_id", F.format_string("-i%03d", "i")).alias("item_id"), (F.col("inside") | own).alias("inside"), (F.col("depth") + 1).alias("depth"))


def problems(docs: DataFrame) -> DataFrame:
    """(document_id, problem): broken rules of normalized documents with their path."""
    top = F.array_compact(F.array(
        F.when(~F.col("schema").eqNullSafe(F.lit(SCHEMA_NAME)), F.lit("schema: unexpected")),
        F.when(F.col("document_id").isNull(), F.lit("document_id: missing")),
        F.when(~F.col("page_count").eqNullSafe(F.size("pages").cast("long")), F.lit("page_count: differs from pages")),
    ))
    of_page = F.transform("pages", lambda p, i: F.when(~p["page_index"].eqNullSafe(i.cast("long")), F.concat(F.lit("pages["), i.cast("string"), F.lit("].page_index: not its position"))))
    return docs.select("document_id", F.explode(F.concat(top, F.array_compact(of_page))).alias("problem"))


ITEM_ID = "p%03d-b%03d"
__all__ = ["Adapters", "BLOCK", "DOCUMENT", "FLAT", "ITEM_ID", "column_signals", "default_adapters", "flatten", "pages", "problems", "read_documents", "signal_summary", "tree_items"]
