"""Roles of document blocks and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Role tables that results depend on.
LAYOUT_OF_SUB_TYPE = {"title": "title", "heading": "heading", "body": "paragraph", "header": "header", "footer": "footer", "page_number": "page_number", "footnote": "footnote"}
CAPTION_SUB_TYPES = ["caption", "figure_caption", "image_caption", "table_caption", "code_caption"]
CAPTION_TAGS = ["caption", "image_caption", "table_caption", "table_footnote", "image_footnote"]
REFERENCE_TAGS = ["reference_entry", "reference_zone"]
ANCILLARY = ["header", "footer", "page_number", "footnote", "caption"]
BODYLIKE_LAYOUT = ["title", "heading", "paragraph", "list_item"]
BODYLIKE_SEMANTIC = ["body", "abstract"]
STRUCTURE_OF_LAYOUT = {"title": "title", "heading": "heading", "paragraph": "body", "list_item": "body", "caption": "caption", "footnote": "footnote", "header": "metadata", "footer": "metadata", "page_number": "metadata"}


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def normalize_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def explicit(role: Column) -> Column:
    """A given role, unless blank or unknown."""
    r = F.lower(F.trim(role))
    return F.when((r != "") & (r != "unknown"), r)


def has_any(tags: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(normalize_tags(tags), F.array(*map(F.lit, wanted)))


def plain(c: Column) -> Column:
    """A name as it is compared: trimmed and in lower case, '' for null."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def first_role(rules: list[tuple[Column, Column | str]]) -> Column:
    """The role of the first rule that holds; a null role counts as not holding."""
    return F.coalesce(*[F.when(F.coalesce(p, F.lit(False)), r if isinstance(r, Column) else F.lit(r)) for p, r in rules])


def layout_role(given: Column, block_type: Column, sub_type: Column, derived: Column, tags: Column) -> Column:
    sub, role, text = plain(sub_type), plain(derived), plain(block_type) == "text"
    caption = (role == "caption") | has_any(tags, CAPTION_TAGS) | sub.isin(CAPTION_SUB_TYPES)
    rules = [(F.lit(True), explicit(given)), (text, lookup(LAYOUT_OF_SUB_TYPE, sub)), (text & caption, "caption"), (text, "paragraph"), (F.lit(True), "unknown")]
    return first_role(rules)


def semantic_role(given: Column, block_type: Column, sub_type: Column, derived: Column, tags: Column, layout: Column) -> Column:
    sub, role = plain(sub_type), plain(derived)
    rules = [
        (F.lit(True), explicit(given)),
        ((role == "abstract") | has_any(tags, ["abstract"]), "abstract"),
        ((role == "formula_number") | (sub == "formula_number"), "metadata"),
        ((role == "reference_entry") | has_any(tags, REFERENCE_TAGS) | (sub == "reference_entry"), "reference"),
        ((sub == "metadata") | (role == "metadata"), "metadata"),
        (role.isin("acknowledgments", "acknowledgements", "acknowledgement"), "acknowledgement"),
        (role == "affiliation", "affiliation"),
        (layout.isin(ANCILLARY), "metadata"),
        ((plain(block_type) == "text") & layout.isin("paragraph", "list_item"), "body"),
        (F.lit(True), "unknown"),
    ]
    return first_role(rules)


def structure_role(given: Column, sub_type: Column, layout: Column, semantic: Column, in_metadata: Column | None = None) -> Column:
    """The given role, else the one in the block's metadata, else what the other roles say."""
    sub = plain(sub_type)
    rules = [
        (F.lit(True), explicit(given)),
        (F.lit(True), explicit(in_metadata) if in_metadata is not None else F.lit(None).cast("string")),
        (sub.isin(CAPTION_SUB_TYPES[1:]), sub),
        ((sub == "reference_entry") | (semantic == "reference"), "reference_entry"),
        (semantic == "abstract", "body"),
        (layout == "caption", "caption"),
        (semantic == "metadata", "metadata"),
        (F.lit(True), lookup(STRUCTURE_OF_LAYOUT, layout)),
        (F.lit(True), ""),
    ]
    return first_role(rules)


def translate_reason(kind: Column, layout: Column, semantic: Column) -> Column:
    bodylike = layout.isin(BODYLIKE_LAYOUT)
    rules = [
        (plain(kind) != "text", "non_text"),
        (layout == "caption", "caption_text"),
        (layout.isin(ANCILLARY), F.concat(F.lit("layout_role="), layout)),
        (semantic.isin("reference", "metadata", "affiliation", "acknowledgement", "unknown"), F.concat(F.lit("semantic_role="), semantic)),
        (bodylike & (semantic == "abstract"), "semantic_role=abstract"),
        (bodylike & semantic.isin(BODYLIKE_SEMANTIC), "main_text"),
        (F.lit(True), "conservative_skip"),
    ]
    return first_role(rules)


def translates(reason: Column) -> Column:
    return reason.isin("caption_text", "semantic_role=abstract", "main_text")


# Roles of blocks whose text is translated, and the structure that a derived role stands for.
CAPTION_ROLES = ("caption", "figure_caption", "image_caption", "table_caption", "code_caption")
FOOTNOTE_ROLES = ("footnote", "image_footnote", "table_footnote")
PRIMARY_STRUCTURES = ("body", "abstract", "title", "heading", *CAPTION_ROLES, *FOOTNOTE_ROLES, "option_header", "option_description", "example_intro", "example_line")
DERIVED_STRUCTURES = ("title", "heading", *CAPTION_ROLES, *FOOTNOTE_ROLES, "abstract", "reference_entry")


def block_translates(explicit: Column, algorithm: Column, tags: Column, kind: Column, layout: Column, semantic: Column, structure: Column, derived: Column) -> Column:
    """Whether a block's text is translated.

    An explicit policy decides, but never lets algorithms through. Without one,
    text is translated if its structure says so (its own or that of its derived
    role), or its place in the layout, or if it is an abstract or a body
    paragraph; a skip tag and algorithms are left alone.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    inside = F.coalesce(algorithm, F.lit(False))
    effective = F.coalesce(F.nullif(low(structure), F.lit("")), F.when(low(derived).isin(*DERIVED_STRUCTURES), low(derived)), F.lit(""))
    body = low(semantic).isin("body", "abstract") & (effective == "body") & low(layout).isin("paragraph", "list_item", "unknown", "")
    primary = effective.isin(*PRIMARY_STRUCTURES) | low(layout).isin("title", "heading", "caption", "footnote") | (low(semantic) == "abstract") | body
    skipped = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: low(t) == "skip_translation")
    return F.when(explicit.isNotNull(), explicit & ~inside).otherwise(~inside & ~skipped & (low(kind) == "text") & primary)
