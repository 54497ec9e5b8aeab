"""Further functions on columns: failures, fields, fits, boxes and nested arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as X

# What failure texts are known by, in order, and literal field values.
FAILURES = [
    ("dns_resolution_failed", "failed to resolve|temporary failure in name resolution|nameresolutionerror|socket.gaierror"),
    ("upstream_timeout", "readtimeout|connecttimeout|timed out"),
    ("upstream_rate_limited", "rate limited|rate limit|too many requests|retry-after"),
    ("auth_failed", "unauthorized|forbidden|invalid api key|token expired|missing api key|missing or invalid x-api-key"),
    ("placeholder_unstable", "placeholderinventoryerror|unexpectedplaceholdererror|placeholder inventory mismatch|placeholder instability"),
    ("translation_protocol_shell", "translationprotocolerror|protocol/json shell"),
    ("typst_dependency_download_failed", "failed to download package|packages.typst.org|downloading @preview/"),
    ("render_failed", "typst compile|typst error|render failed|failed to render|font not found"),
    ("json_decode_failed", "jsondecodeerror|expecting value|extra data|invalid control character"),
    ("document_schema_validation_failed", "validationerror|normalized document schema validation failed"),
    ("source_pdf_missing", "source pdf not found"),
    ("source_pdf_open_failed", "fitz.fitzerror|pymupdf|cannot open broken document|file data error"),
]
FIELD_LABEL = r"(?:^|\s*[•\-]\s+)([A-Za-z][A-Za-z0-9 _./-]{1,40})\s*:"
LITERAL = r"""(?i)^(?:-?\d+(?:\.\d+)?(?:[Ee][+-]?\d+)?|true|false|null|none|yes|no|<[^<>\n]{1,80}>|"[^"]{0,120}"|'[^']{0,120}'|\[[^\]\n]{1,160}\])$"""


def failure(text: Column, status: Column) -> Column:
    """Failure type of a log text, first known sign wins; a status code counts in its place of the order."""
    s = F.lower(text)
    steps = []
    for name, pattern in FAILURES:
        sign = s.rlike(pattern)
        if name == "upstream_rate_limited":
            sign = sign | F.coalesce(status == 429, F.lit(False))
        if name == "auth_failed":
            sign = sign | F.coalesce(status.isin(401, 403), F.lit(False))
        steps.append(F.when(sign, F.lit(name)))
        if name == "auth_failed":
            steps.append(F.when(status == 400, F.lit("upstream_bad_request")))
    return F.coalesce(*steps, F.lit("python_unhandled_exception"))


def structured_block(c: Column) -> Column:
    """Two or more field labels, or one whose value is a short literal, in at most 1200 characters."""
    s = X.normalize_space(c)
    labels = F.regexp_count(s, F.lit(FIELD_LABEL))
    value = F.trim(F.regexp_extract(s, "^[^:]*:(.*)$", 1))
    return (s != "") & (F.length(s) <= 1200) & ((labels >= 2) | ((labels == 1) & value.rlike(LITERAL)))


def _em(font: Column) -> Column:
    """0.92 of a font size, rounded once: 9.2 of 10, where the product with 0.92 lies above and costs a line at the edge."""
    return font * 92 / 100


def box_capacity(x0: Column, y0: Column, x1: Column, y1: Column, font: Column, leading: Column) -> Column:
    """Characters that fit a box at a font size and leading."""
    width, height = F.greatest(F.lit(8.0), x1 - x0), F.greatest(F.lit(8.0), y1 - y0)
    step = F.greatest(font * 1.02, font * (1.0 + leading))
    return F.greatest(F.lit(1), F.floor(height / step)) * F.greatest(F.lit(4.0), width / F.greatest(_em(font), F.lit(1.0))) * 0.98


def required_lines(x0: Column, x1: Column, demand: Column, font: Column) -> Column:
    per_line = F.greatest(F.lit(4.0), F.greatest(F.lit(8.0), x1 - x0) / F.greatest(_em(font), F.lit(1.0)))
    return F.when(demand <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(demand / F.greatest(per_line * 0.98, F.lit(1.0)))))


def subtract_box(box: Column, hole: Column) -> Column:
    """Up to four pieces of a box outside a hole (structs x0, y0, x1, y1); pieces of area 0.5 or less go."""
    at = lambda b, n: b[n]
    hx0, hy0, hx1, hy1 = (F.greatest(at(box, "x0"), at(hole, "x0")), F.greatest(at(box, "y0"), at(hole, "y0")), F.least(at(box, "x1"), at(hole, "x1")), F.least(at(box, "y1"), at(hole, "y1")))
    piece = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    four = F.array(
        piece(at(box, "x0"), at(box, "y0"), at(box, "x1"), hy0), piece(at(box, "x0"), hy1, at(box, "x1"), at(box, "y1")),
        piece(at(box, "x0"), hy0, hx0, hy1), piece(hx1, hy0, at(box, "x1"), hy1),
    )
    pieces = F.when((hx0 < hx1) & (hy0 < hy1), four).otherwise(F.array(piece(*[at(box, n) for n in ("x0", "y0", "x1", "y1")])))
    return F.filter(pieces, lambda p: (p["x1"] > p["x0"]) & (p["y1"] > p["y0"]) & ((p["x1"] - p["x0"]) * (p["y1"] - p["y0"]) > 0.5))


def subtract_boxes(box: Column, holes: Column) -> Column:
    """Pieces of a box outside every hole of an array, by a fold."""
    return F.aggregate(holes, F.array(box), lambda acc, h: F.flatten(F.transform(acc, lambda p: subtract_box(p, h))))


def map_total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)


def pick_by_id(entries: Column, item_id: Column) -> Column:
    """Text of the entry with an id, or of the only entry."""
    mine = F.filter(entries, lambda e: e["item_id"] == item_id)
    return F.coalesce(F.get(mine, F.lit(0))["text"], F.when(F.size(entries) == 1, F.get(entries, F.lit(0))["text"]))


def job_id(now: Column, seed: int | None = None) -> Column:
    """A job's id: the UTC second and six random hex digits."""
    digits = F.lpad(F.lower(F.hex(F.floor(F.rand(seed) * (1 << 24)).cast("long"))), 6, "0")
    return F.concat(F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyyMMddHHmmss"), F.lit("-"), digits)


def iso_seconds(now: Column) -> Column:
    """A timestamp in UTC as RFC 3339 with seconds."""
    return F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def item_diagnostics(payload: Column, item_id: Column, page: Column, math_mode: Column) -> Column:
    """A payload (struct) with its missing fields filled from the item; what is there stays.

    The excerpt is the first text that there is: the payload's own raw texts,
    then those of its error trace in order.
    """
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    traced = F.filter(F.transform(F.coalesce(payload["error_trace"], F.array()), lambda e: some(e["raw_excerpt"], e["raw_output"], e["message"])), lambda x: x != "")
    excerpt = X.preview(some(payload["raw_excerpt"], payload["raw_output"], payload["raw_response"], F.get(traced, F.lit(0))), 260)
    return F.struct(
        F.coalesce(payload["item_id"], item_id).alias("item_id"), F.coalesce(payload["page_idx"], page).alias("page_idx"), F.coalesce(payload["provider"], some(payload["provider_family"], F.lit("translation"))).alias("provider"),
        F.coalesce(payload["prompt_mode"], some(math_mode)).alias("prompt_mode"), F.coalesce(payload["request_label"], F.lit("")).alias("request_label"), F.coalesce(payload["raw_excerpt"], excerpt).alias("raw_excerpt"),
    )


REPORT = (
    "provider string, detected_provider string, provider_was_explicit boolean, defaults struct<pages_seen:bigint,blocks_seen:bigint,document_defaults:map<string,bigint>,page_defaults:map<string,bigint>,block_defaults:map<string,bigint>>, "
    "validation struct<schema:string,schema_version:string,page_count:bigint,block_count:bigint>"
)


def normalization_view(report: Column) -> Column:
    """Counts and names of a normalization report in JSON, which may stand under ``normalization``."""
    r = F.from_json(F.coalesce(F.get_json_object(report, "$.normalization"), report), REPORT)
    text = lambda c: F.coalesce(c, F.lit(""))
    kinds = lambda m: F.coalesce(F.size(m), F.lit(0))
    d, v = r["defaults"], r["validation"]
    return F.struct(
        text(r["provider"]).alias("provider"), text(r["detected_provider"]).alias("detected_provider"), F.coalesce(r["provider_was_explicit"], F.lit(False)).alias("provider_was_explicit"), d["pages_seen"].alias("pages_seen"), d["blocks_seen"].alias("blocks_seen"),
        *[kinds(d[n]).alias(n) for n in ("document_defaults", "page_defaults", "block_defaults")], text(v["schema"]).alias("schema"), text(v["schema_version"]).alias("schema_version"), v["page_count"].alias("page_count"), v["block_count"].alias("block_count"),
    )
