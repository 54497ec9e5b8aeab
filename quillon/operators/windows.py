"""Ordered operators: neighbours, islands, histories, changes and latest states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as X


def neighbours(df: DataFrame, by: list[str], order: list[str], text: str, size: int = 2, limit: int = 360) -> DataFrame:
    """df with ``before`` and ``after``: the texts of ``size`` rows on either side, joined and cut."""
    w = Window.partitionBy(*by).orderBy(*order)
    side = lambda low, high: X.trim_context(F.array_join(F.collect_list(text).over(w.rowsBetween(low, high)), " / "), limit)
    return df.withColumns({"before": side(-size, -1), "after": side(1, size)})


def zones(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with rank (from 0), size and head, middle, tail or single role of each row in its zone."""
    w = Window.partitionBy(*by).orderBy(*order)
    rank = (F.row_number().over(w) - 1).cast("long")
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    role = F.when(size == 1, "single").when(rank == 0, "head").when(rank == size - 1, "tail").otherwise("middle")
    return df.withColumns({"zone_rank": rank, "zone_size": size, "zone_role": role})


def column_split(df: DataFrame, by: list[str], centre: str, left: str, right: str, least_gap: float = 0.18, least_items: int = 3) -> DataFrame:
    """Per group: 'double' and where to cut if the widest gap of centres is wide and both sides are filled."""
    w = Window.partitionBy(*by).orderBy(centre)
    nxt = F.lead(centre).over(w)
    ranked = df.withColumn("_gap", nxt - F.col(centre)).withColumn("_mid", (nxt + F.col(centre)) / 2).withColumn("_i", F.row_number().over(w))
    g = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.max(right) - F.min(left)).alias("width"), F.max_by(F.struct("_gap", "_mid", "_i"), F.struct("_gap", -F.col("_i"))).alias("m"))
    ok = (F.col("n") >= 2 * least_items) & (F.col("width") > 0) & (F.col("m._gap") >= F.col("width") * least_gap) & (F.col("m._i") >= least_items) & (F.col("n") - F.col("m._i") >= least_items)
    ok = F.coalesce(ok, F.lit(False))
    return g.select(*by, F.when(ok, "double").otherwise("single").alias("mode"), F.when(ok, F.col("m._mid")).otherwise(0.0).alias("split_x"))


def page_layout(flow: DataFrame, by: list[str], centre: str, left: str, right: str) -> DataFrame:
    """Per page: extent and median width of its flowing items, mode and where to cut."""
    widths = flow.groupBy(*by).agg((F.max(right) - F.min(left)).alias("width"), F.median(F.col(right) - F.col(left)).alias("median_width"))
    return widths.join(column_split(flow, by, centre, left, right), by)


def join_score(df: DataFrame, by: list[str], order: list[str], text: str) -> DataFrame:
    """df with the scores and decision of each row against the next of its group.

    ``page_idx`` and the column box (x0, y0, x1, y1) are read from df; on one page a
    pair must be in neighbouring columns or end in a hyphen. A text's marks are
    found once, before rows move; the next row is known by its marks alone.
    """
    s = F.col("_s")
    marks = {
        "missing": F.col(text).isNull(), "blank": s == "", "even": X.dollar_balance(s, True) % 2 == 0, "starts": X.starts_like_continuation(s, True), "heading": X.starts_like_heading(s, True), "capital": s.rlike("^[A-Z]"),
        "terminal": X.ends_terminal(s, True), "sentence": s.rlike(r"[.!?]$"), "ends": X.ends_like_continuation(s, True), "hyphen": s.endswith("-"), "comma": s.endswith(","), "suspicious": X.last_word(s).isin(X.SUSPICIOUS_ENDS),
    }
    d = df.withColumn("_s", X.normalize_space(F.col(text))).withColumns({f"_{k}": v for k, v in marks.items()}).drop("_s")
    w = Window.partitionBy(*by).orderBy(*order)
    ahead = F.lead(F.struct("page_idx", "x0", "y0", "_missing", "_blank", "_even", "_starts", "_heading", "_capital")).over(w)
    d = d.withColumn("_next", ahead)
    a = {k: F.col(f"_{k}") for k in marks}
    b = {k: F.coalesce(F.col(f"_next._{k}"), F.lit(k in ("missing", "blank", "even"))) for k in ("missing", "blank", "even", "starts", "heading", "capital")}
    same = F.col("page_idx") == F.col("_next.page_idx")
    cross = (F.col("_next.x0") > F.col("x1") + 8) & (F.col("_next.x0") - F.col("x1") <= 96)
    near = (F.abs(F.col("_next.x0") - F.col("x0")) <= 28) & (F.col("_next.y0") - F.col("y1") <= 40)
    likely = F.when(F.col("_next.x0") > F.col("x1") + 8, F.col("_next.x0") - F.col("x1") <= 96).otherwise(near)
    fits = a["even"] & b["even"] & ~a["blank"] & ~b["blank"] & F.when(same, likely & (cross | a["hyphen"])).otherwise(F.col("_next.page_idx") - F.col("page_idx") == 1)
    point = lambda c, n: F.when(c, n).otherwise(0)
    score = point(b["starts"], 3) + point(a["terminal"] & b["starts"], 3) + point(a["ends"], 3) + point(a["hyphen"], 4) + point(a["comma"], 1) + point(a["suspicious"], 1)
    score = score + F.when(same, point(cross, 2)).otherwise(point(~a["terminal"], 2))
    brk = F.when(a["sentence"], 4).when(a["terminal"], 2).otherwise(0) - point(b["starts"], 3) + point(b["heading"], 3) + point(b["capital"] & ~b["starts"], 1) + point(same & ~likely, 2)
    d = d.withColumns({"join_score": F.when(F.coalesce(fits, F.lit(False)), score).otherwise(-999), "break_score": F.greatest(F.lit(0), brk)})
    j, k = F.col("join_score"), F.col("break_score")
    decision = F.when(b["missing"], None).when(j < 0, "break").when((j >= 4) & (j >= k + 2), "join").when((k >= 4) & (k >= j + 1), "break").otherwise("candidate")
    return d.select(*df.columns, "join_score", "break_score", decision.alias("decision"))


def islands(df: DataFrame, by: list[str], order: list[str], linked: Column) -> DataFrame:
    """df with ``island``, counted from 1: a row begins a new one unless the row before says it is linked to it."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_l", linked).withColumn("island", F.sum(F.when(F.coalesce(F.lag("_l").over(w), F.lit(False)), 0).otherwise(1)).over(w)).drop("_l")


def carry_anchor(df: DataFrame, by: list[str], order: list[str], anchor: Column) -> DataFrame:
    """df with ``anchor``: the last non-null anchor of an earlier row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("anchor", F.last(anchor, ignorenulls=True).over(w))


def stage_history(df: DataFrame, key: str, ts: str, stage: str, tie: str) -> DataFrame:
    """One row per run of a stage: when it began, how long it lasted in ms (null while open)."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    runs = df.withColumn("_new", F.coalesce(F.lag(stage).over(w) != F.col(stage), F.lit(True))).filter("_new")
    end = F.lead(ts).over(w)
    return runs.select(key, F.col(stage).alias("stage"), F.col(ts).alias("entered"), F.greatest(F.lit(0), F.timestamp_diff("MILLISECOND", F.col(ts), end)).alias("ms_raw"), end.isNull().alias("open")).select(key, "stage", "entered", F.when(~F.col("open"), F.col("ms_raw")).alias("duration_ms"))


def changes(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row per column that differs from the key's row before; a first row is 'created'."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(w) == 1
    kinds = [F.when(first, F.lit("created"))] + [F.when(~first & ~F.col(c).eqNullSafe(F.lag(c).over(w)), F.lit(f"{c}_changed")) for c in columns]
    return df.withColumn("_k", F.array_compact(F.array(*kinds))).select(*df.columns, F.explode("_k").alias("change"))


def latest(df: DataFrame, key: str, value: list[str], order: list[str]) -> DataFrame:
    """Per key the values of its greatest row in order."""
    return df.groupBy(key).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("v")).select(key, *[F.col(f"v.{c}") for c in value])


def gauge(df: DataFrame, key: str, ts: str, delta: Column, tie: str) -> DataFrame:
    """Per key the greatest running sum of delta and the sum at the end."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    run = df.withColumn("_d", delta).withColumn("_run", F.sum("_d").over(w))
    return run.groupBy(key).agg(F.max("_run").alias("peak"), F.sum("_d").alias("at_end"))


def numbered(df: DataFrame, by: list[str], run: Column, order: list[str], out: str) -> DataFrame:
    """df with ``out``: rows numbered from 1 in order within each group.

    A group may be large: its rows are ranked within runs (``run`` grows with
    the order), and only the runs' sizes are summed over the whole group.
    """
    d = df.withColumn("_run", run)
    own = F.row_number().over(Window.partitionBy(*by, "_run").orderBy(*order))
    sizes = d.groupBy(*by, "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).drop("_n")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_run")]
    joined = d.withColumn("_own", own).alias("a").join(sizes.alias("b"), on)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("b._before") + F.col("a._own")).alias(out))
