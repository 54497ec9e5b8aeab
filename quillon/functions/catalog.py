"""Classification of stages, errors, providers and glossary settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name tables that results depend on.
USER_STAGES = {
    "ocr": "ocr_upload ocr_processing ocr_result_ready normalizing".split(),
    "translate": "translation_prepare translating translation_batches continuation_review page_policies domain_inference garbled_repair".split(),
    "render": "render_prepare rendering compile overlay saving".split(),
    "done": "finished done".split(),
}
UNITS = {
    "batch": "translating translation_batches".split(),
    "page": "ocr_processing continuation_review page_policies domain_inference garbled_repair rendering".split(),
    "step": "compile overlay saving render_prepare translation_prepare normalizing".split(),
}
ERRORS = [("rate_limit_error", "429|rate limit|retry-after"), ("transport_error", "timeout|connection|http|transport"), ("model_refusal", "refusal|refused|safety"), ("validation_error", "placeholder|segment|validation|inventory")]
LABELS = [("translation", "^book: batch"), ("classification", "^classification page"), ("continuation_review", "^continuation-review"), ("mixed_literal_split", "^mixed-split"), ("garbled_reconstruction", "^garbled-reconstruct"), ("domain_context", "^domain-infer"), ("typst_repair", " typst-repair|^typst-repair")]
LEVELS = {
    "preserve": "preserve keep keep_origin keep-original do_not_translate do-not-translate not_translate not-translate no_translate no-translate 不翻译 保留 原文保留".split(),
    "canonical": "canonical fixed fixed_translation fixed-translation required 强制翻译 固定翻译 专业译法 标准译法".split(),
}
MATCH_MODES = {"regex": ["regex"], "case_insensitive": "case_insensitive case-insensitive ci ignore_case ignore-case 大小写不敏感 忽略大小写".split()}


def member_of(table: dict[str, list[str]], key: Column) -> Column:
    """The name whose list holds key, or null."""
    return F.coalesce(*[F.when(key.isin(v), F.lit(k)) for k, v in table.items()])


def ladder(rules: list[tuple[str, str]], text: Column, otherwise: str) -> Column:
    """The name of the first pattern found in text."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules], F.lit(otherwise))


def user_stage(stage: Column) -> Column:
    return member_of(USER_STAGES, F.trim(stage))


def progress_unit(stage: Column, event: Column) -> Column:
    return F.coalesce(member_of(UNITS, F.trim(stage)), F.when(event == "stage_progress", "step"), F.lit("none"))


def error_class(text: Column, status: Column) -> Column:
    return F.when(status == 429, "rate_limit_error").when(status >= 500, "transport_error").otherwise(ladder(ERRORS, F.lower(text), "protocol_error"))


def request_stage(label: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(s == "", "unspecified").otherwise(ladder(LABELS, s, "other_llm"))


def provider_family(base_url: Column, model: Column) -> Column:
    b, m = F.lower(F.trim(base_url)), F.lower(F.trim(model))
    return F.when(b.contains("api.deepseek.com"), "deepseek_official").when(b.contains("deepseek") | m.startswith("deepseek"), "deepseek_compatible").otherwise("other")


def glossary_level(c: Column) -> Column:
    return F.coalesce(member_of(LEVELS, F.lower(F.trim(c))), F.lit("preferred"))


def match_mode(c: Column) -> Column:
    return F.coalesce(member_of(MATCH_MODES, F.lower(F.trim(c))), F.lit("exact"))
