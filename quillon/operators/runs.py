"""Runs of requests: advice, queues of batches, invocation counts, placeholder inventories, candidates, glued blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import more as M
from quillon.functions import text as X
from quillon.functions.geometry import width_overlap

# Limits and the advice that goes with them.
OTHER_PROVIDER = "Current provider is not DeepSeek; compare with DeepSeek official for baseline stability."
SATURATED = "Timeouts under high inflight translation suggest provider saturation; reduce workers for this provider."
QUEUEING = "High p95 latency plus timeouts suggests upstream queueing; inspect provider-side rate limits and retry budget."
STABLE = "Observed concurrency is stable; use this artifact as the baseline before changing workers or timeout values."
HIGH_INFLIGHT, HIGH_P95 = 32, 60_000
GLUE_CHARS, GLUE_RATIO, GLUE_GAP, GLUE_OVERLAP, GLUE_OVERFLOW, COLLISION_GAP = 1000, 15.0, 28.0, 0.6, 1.25, 0.9


def recommendations(family: Column, timeouts: Column, peak: Column, p95: Column) -> Column:
    """What a run's figures advise, in order; that all is stable only if nothing else is said."""
    said = F.array_compact(F.array(
        F.when(family == "other", OTHER_PROVIDER),
        F.when((timeouts > 0) & (peak >= HIGH_INFLIGHT), SATURATED),
        F.when((timeouts > 0) & (p95 >= HIGH_P95), QUEUEING),
    ))
    return F.when((F.size(said) == 0) & (peak > 0), F.array(F.lit(STABLE))).otherwise(said)


def run_summary(requests: DataFrame, run: str) -> DataFrame:
    """(run, requests, timeouts, retrying, max_attempt, peak_translation, peak_all, p95, advice) of each run.

    requests has family, stage, label, ts, seq, started (a request begins, else
    ends), timeout and ms. Attempts are the begun requests of a label. A run's
    rows are summed in order by one window, which Spark can spill.
    """
    begun = requests.filter("started").groupBy(run, "label").agg(F.count(F.lit(1)).alias("n"))
    tries = begun.groupBy(run).agg(F.count_if(F.col("n") > 1).alias("retrying"), F.max("n").alias("max_attempt"))
    step = F.when(F.col("started"), 1).otherwise(-1)
    w = Window.partitionBy(run).orderBy("ts", "seq")
    flying = requests.withColumns({"_all": F.sum(step).over(w), "_one": F.sum(F.when(F.col("stage") == "translation", step).otherwise(0)).over(w)})
    sums = flying.groupBy(run).agg(
        F.max("family").alias("family"), F.count_if("started").alias("requests"), F.count_if("timeout").alias("timeouts"), F.greatest(F.lit(0), F.max("_one")).alias("peak_translation"), F.greatest(F.lit(0), F.max("_all")).alias("peak_all"),
        F.floor(F.percentile(F.when(~F.col("started"), F.col("ms")), F.lit(0.95))).cast("long").alias("p95"),
    )
    advice = recommendations(F.col("family"), F.col("timeouts"), F.col("peak_translation"), F.coalesce("p95", F.lit(0)))
    joined = sums.join(tries, run, "left")
    return joined.select(run, "requests", "timeouts", F.coalesce("retrying", F.lit(0)).alias("retrying"), F.coalesce("max_attempt", F.lit(1)).alias("max_attempt"), "peak_translation", "peak_all", "p95", advice.alias("advice"))


def queues(items: DataFrame, batch: list[str], plain: Column, heavy: Column) -> DataFrame:
    """(batch, n, queue): several items or a plain candidate are batched, a lone heavy one is slow, other lone ones fast."""
    b = items.groupBy(*batch).agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(plain, F.lit(False))).alias("p"), F.max(F.coalesce(heavy, F.lit(False))).alias("h"))
    return b.select(*batch, "n", F.when((F.col("n") > 1) | F.col("p"), "batched_fast").when(F.col("h"), "single_slow").otherwise("single_fast").alias("queue"))


def invocation_counts(jobs: DataFrame, by: list[str], invocation: Column) -> DataFrame:
    """(by, stage_spec_count, unknown_count): jobs that were given as stages, and all others."""
    spec = F.coalesce(F.get_json_object(invocation, "$.input_protocol") == "stage_spec", F.lit(False))
    return jobs.groupBy(*by).agg(F.count_if(spec).alias("stage_spec_count"), F.count_if(~spec).alias("unknown_count"))


def same_inventory(source: Column, translated: Column) -> Column:
    """Whether two texts hold the same placeholders equally often, in whatever order."""
    held = lambda c: F.array_sort(X.placeholder_sequence(c))
    return held(source) == held(translated)


def rebuild_candidates(items: DataFrame, rebuilds: Column, unit_kind: Column, unit_id: Column, item_id: Column, by: list[str], order: str) -> DataFrame:
    """(by, key, members, representative): items to rebuild by their unit, a group's as one; the first represents it."""
    key = F.when((F.coalesce(unit_kind, F.lit("")) == "group") & (F.coalesce(unit_id, F.lit("")) != ""), F.concat(F.lit("group:"), unit_id)).otherwise(F.concat(F.lit("item:"), item_id))
    chosen = items.filter(F.coalesce(rebuilds, F.lit(False))).select(*by, key.alias("key"), item_id.alias("_item"), F.col(order).alias("_order"))
    return chosen.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("members"), F.min_by("_item", "_order").alias("representative"))


def glued_blocks(items: DataFrame, page: list[str]) -> DataFrame:
    """(page, item_id, next_id, source_chars, overflow): texts that hold far more than their box, close above another box.

    items has item_id, kind, group, unit_kind, direct_math, formulas, source,
    rendered, font, leading, demand, discount and x0 to y1. Pairs are neighbours
    among the page's texts that are rendered, from the top. Texts are measured
    before rows move, and only those that may be long enough; so no text moves.
    """
    c = F.col
    w = Window.partitionBy(*page).orderBy("y0", "x0", "item_id")
    nxt = F.lead(F.struct("item_id", "x0", "y0", "x1")).over(w)
    plain = (F.coalesce("group", F.lit("")) == "") & (F.coalesce("unit_kind", F.lit("")) != "group") & ~F.coalesce("direct_math", F.lit(False)) & (F.coalesce("formulas", F.lit(0)) == 0)
    gap, room = c("n.y0") - c("y1"), c("n.y0") - c("y0") - COLLISION_GAP
    estimate = M.required_lines(c("x0"), c("x1"), c("demand"), c("font")) * F.greatest(c("font") * 1.02, c("font") * (1.0 + c("leading"))) * c("discount")
    chars = F.length(F.regexp_replace("source", r"(?U)\s+", ""))
    i = items.filter((c("kind") == "text") & (F.trim(F.coalesce("rendered", F.lit(""))) != ""))
    i = i.select(*page, "item_id", "x0", "y0", "x1", "y1", F.when(plain & (F.length("source") >= GLUE_CHARS), chars).alias("source_chars"), estimate.alias("_estimate"))
    i = i.withColumn("n", nxt).withColumn("_room", room)
    hit = (
        (c("source_chars") >= GLUE_CHARS) & (c("source_chars") / F.greatest(F.lit(1.0), c("y1") - c("y0")) >= GLUE_RATIO) & (width_overlap(c("x0"), c("x1"), c("n.x0"), c("n.x1")) >= GLUE_OVERLAP)
        & gap.between(0, GLUE_GAP) & (c("_room") > 0) & (c("_estimate") > c("_room") * GLUE_OVERFLOW)
    )
    return i.filter(hit).select(*page, "item_id", c("n.item_id").alias("next_id"), "source_chars", F.round(c("_estimate") / c("_room"), 2).alias("overflow"))
