"""Operators whose state runs from row to row and has no window form: one ordered pass per group.

Each works on one document, page or key at a time, whose size is bounded by
what it is (a page of boxes, a paragraph's segments, one worker's requests).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ordered_pass(df: DataFrame, by: list[str], order: list[Column], schema: T.StructType, run: Callable[[pa.Table, list[int]], pa.Table]) -> DataFrame:
    """``run`` over whole groups in order, as many at a time as an Arrow batch holds: it gets their rows and where each group begins.

    Spark sorts and spills; a task holds a batch and the group that runs over its end.
    """

    def begins(t: pa.Table) -> list[int]:
        new = np.zeros(max(0, len(t) - 1), bool)
        for c in by:
            v = t.column(c).combine_chunks()
            a, b = v.slice(0, len(v) - 1), v.slice(1)
            differs = pc.fill_null(pc.not_equal(a, b), False)
            new |= np.asarray(pc.or_(differs, pc.not_equal(pc.is_null(a), pc.is_null(b))))
        return [0, *(np.flatnonzero(new) + 1).tolist()]

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the beginning of one group
        for batch in batches:
            if not batch.num_rows:
                continue
            edge = pa.Table.from_batches([*(h.slice(h.num_rows - 1) for h in held[-1:]), batch])
            last = begins(edge)[-1] - (1 if held else 0)  # where the batch's last group begins; below 1 if the held one goes on
            if last > 0 or (held and last == 0 and len(begins(edge.slice(0, 2))) > 1):
                t = pa.Table.from_batches([*held, batch.slice(0, last)])
                yield from run(t, begins(t)).to_batches()
                held = []
            held.append(batch.slice(max(0, last)))
        if held:
            t = pa.Table.from_batches(held)
            yield from run(t, begins(t)).to_batches()

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(passes, schema)


def pack(df: DataFrame, by: list[str], order: list[str], size: str, most_items: int, most_size: int) -> DataFrame:
    """df with ``window``: rows packed greedily in order, a new window where count or size would exceed its limit."""
    schema = T.StructType([*df.schema.fields, T.StructField("window", T.LongType())])

    def run(t: pa.Table, starts: list[int]) -> pa.Table:
        first, out = set(starts), []
        window = items = total = 0
        for i, n in enumerate(t.column(size).to_pylist()):
            if i in first:
                window = items = total = 0
            if items and (items >= most_items or total + n > most_size):
                window, items, total = window + 1, 0, 0
            items, total = items + 1, total + int(n)
            out.append(window)
        return t.append_column("window", pa.array(out, pa.int64()))

    return _ordered_pass(df, by, [F.col(c).asc_nulls_last() for c in order], schema, run)


def pack_array(sizes: Column, most_items: int, most_size: int) -> Column:
    """Window numbers of an array of sizes, by a fold inside the JVM."""
    zero = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("s"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["n"] > 0) & ((acc["n"] >= most_items) | (acc["s"] + x > most_size))
        w = acc["w"] + F.when(new, 1).otherwise(0)
        return F.struct(w.alias("w"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), F.when(new, x).otherwise(acc["s"] + x).cast("long").alias("s"), F.concat(acc["out"], F.array(w)).alias("out"))

    return F.aggregate(sizes, zero, step, lambda acc: acc["out"])


def chain_ids(df: DataFrame, by: list[str], order: list[str], decision: str) -> DataFrame:
    """df with ``group_no``: chains of rows joined to the next, numbered from 1; null for rows in none.

    After a chain ends the scan resumes behind its last row, so that row's own
    decision never opens a chain or a candidate.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("group_no", T.LongType())])

    def run(t: pa.Table, starts: list[int]) -> pa.Table:
        joins = [d == "join" for d in t.column(decision).to_pylist()]
        out: list[int | None] = [None] * len(joins)
        for i, n in zip(starts, [*starts[1:], len(joins)]):
            made = 0
            while i < n:
                j = i
                while j < n - 1 and joins[j]:
                    j += 1
                if j > i:
                    made += 1
                    out[i : j + 1] = [made] * (j + 1 - i)
                i = j + 1
        return t.append_column("group_no", pa.array(out, pa.int64()))

    return _ordered_pass(df, by, [F.col(c).asc_nulls_last() for c in order], schema, run)


def merge_boxes(df: DataFrame, by: list[str]) -> DataFrame:
    """Boxes of a group merged with those they overlap until none do: (by, x0, y0, x1, y1, n)."""
    edges = ["x0", "y0", "x1", "y1"]
    schema = T.StructType([*(f for f in df.schema.fields if f.name in by), *(T.StructField(e, T.DoubleType()) for e in edges), T.StructField("n", T.LongType())])

    def merged(todo: list[list]) -> list[list]:
        done: list[list] = []
        while todo:
            a = todo.pop()
            hit = next((i for i, b in enumerate(done) if a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]), None)
            if hit is None:
                done.append(a)
            else:
                b = done.pop(hit)
                todo.append([min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]])
        return done

    def run(t: pa.Table, starts: list[int]) -> pa.Table:
        rows = [[*map(float, r), 1] for r in zip(*(t.column(e).to_pylist() for e in edges))]
        at, out = [], []
        for i, n in zip(starts, [*starts[1:], len(rows)]):
            found = merged(rows[i:n])
            at += [i] * len(found)
            out += found
        keys = t.select(by).take(pa.array(at, pa.int64()))
        types = [pa.float64()] * 4 + [pa.int64()]
        return pa.table([*keys.columns, *(pa.array([b[k] for b in out], x) for k, x in enumerate(types))], names=[*by, *edges, "n"])

    return _ordered_pass(df, by, [F.col(c).asc_nulls_last() for c in edges], schema, run)


def adaptive_limit(df: DataFrame, key: str, order: list[str], slow_ms: str, failed: str, start: int = 8, least: int = 1) -> DataFrame:
    """df with ``limit_after``: halved on failure, one less on a slow answer, one more after 12 quick ones."""
    schema = T.StructType([*df.schema.fields, T.StructField("limit_after", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        limit, quick, out = start, 0, []
        for ms, bad in zip(pdf[slow_ms], pdf[failed]):
            if bad:
                limit, quick = max(least, limit // 2), 0
            elif ms >= 90_000:
                limit, quick = max(least, limit - 1), 0
            elif ms <= 15_000:
                quick += 1
                if quick >= 12:
                    limit, quick = min(start, limit + 1), 0
            else:
                quick = 0
            out.append(limit)
        return pdf.assign(limit_after=out)

    return df.groupBy(key).applyInPandas(run, schema)


def smooth(df: DataFrame, by: list[str], order: list[str], value: str, most_step: float) -> DataFrame:
    """df with ``smoothed``: each value moved towards the one before it until they differ by at most most_step."""
    schema = T.StructType([*df.schema.fields, T.StructField("smoothed", T.DoubleType())])

    def run(t: pa.Table, starts: list[int]) -> pa.Table:
        first, out, last = set(starts), [], 0.0
        for i, v in enumerate(t.column(value).to_pylist()):
            v = math.nan if v is None else float(v)
            last = v if i in first else min(last + most_step, max(last - most_step, v))
            out.append(last)
        return t.append_column("smoothed", pa.array(out, pa.float64()))

    return _ordered_pass(df, by, [F.col(c).asc_nulls_last() for c in order], schema, run)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts, 0 to 1 (1 for equal ones)."""
    import difflib

    return pd.Series([1.0 if x == y else difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.StringType())
def checksum(kind: pd.Series, text: pd.Series) -> pd.Series:
    """First three hex digits of a two-byte BLAKE2s digest of kind, a zero byte and text."""
    import hashlib

    return pd.Series([hashlib.blake2s(f"{k}\0{t}".encode(), digest_size=2).hexdigest()[:3] for k, t in zip(kind, text)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("term", T.StringType())])))
def term_spans(text: pd.Series, terms: pd.Series) -> pd.Series:
    """Occurrences of an array of terms, longest term first, none overlapping another."""

    def spans(t: str, words) -> list[dict]:
        low, taken, out = t.lower(), [False] * (len(t) + 1), []
        for w in sorted({x for x in words if x}, key=lambda x: (-len(x), x)):
            at = low.find(w.lower())
            while at >= 0:
                if not any(taken[at : at + len(w)]):
                    out.append({"start": at, "stop": at + len(w), "term": w})
                    taken[at : at + len(w)] = [True] * len(w)
                at = low.find(w.lower(), at + 1)
        return sorted(out, key=lambda s: s["start"])

    return pd.Series([spans(t or "", w if w is not None else ()) for t, w in zip(text, terms)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_by_weight(text: pd.Series, weights: pd.Series) -> pd.Series:
    """Words of a text cut into as many parts as there are weights, by their shares, moved to punctuation nearby."""

    def parts(t: str, w) -> list[str]:
        words, total, out, at, gone = t.split(), sum(w) or 1, [], 0, 0.0
        for i, x in enumerate(w):
            gone += x
            aim = len(words) if i == len(w) - 1 else round(len(words) * gone / total)
            if i < len(w) - 1:
                near = [k for k in range(max(at, aim - 36), min(len(words), aim + 36) + 1)]
                aim = min(near, key=lambda k: (abs(k - aim) - (2.0 if k and words[k - 1][-1:] in ".,;:!?" else 0.0), k)) if near else aim
            out.append(" ".join(words[at:aim]))
            at = max(at, aim)
        return out

    return pd.Series([parts(t or "", list(w)) for t, w in zip(text, weights)])


# Weights and limits of the split over boxes.
SPLIT_PUNCTUATION = (".", "。", "!", "！", "?", "？", ";", "；", ":", "：", ",", "，")
BOX_TOKEN = r"<[futnvc]\d+-[0-9a-z]{3}/>|\[\[FORMULA_\d+]]|\s+|[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*|[一-鿿]|."
MATH_TOKEN = r"(?<!\\)\$(?:\\.|[^$\\\n])+(?<!\\)\$|\s+|[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*|[一-鿿]|."
STYLE_COMMAND = r"\\(?:left|right|mathrm|mathbf|mathit|mathsf|mathtt|text|operatorname|displaystyle|textstyle|scriptstyle|scriptscriptstyle)\b"
SPLIT = {"window": 24, "fill": 0.98, "full": 1.01, "later_full": 1.03, "least_fill": 0.55, "underfill": 0.1, "no_punctuation": 1.25, "roomy": 2.0, "roomy_weights": (28.0, 140.0), "weights": (72.0, 108.0)}
REBALANCE = {"passes": 3, "window": 80, "tolerance": 3.5, "trigger": 12.0, "no_punctuation": 1.75, "least_move": 18.0, "ratio_gap": 0.08, "ratio_weight": 6.0}


class BoxText:
    """A text's tokens with their widths in character units, as sums up to each token."""

    def __init__(self, text: str, formulas: dict[str, str], direct: bool):
        self.tokens = [t for t in re.findall(MATH_TOKEN if direct else BOX_TOKEN, text, re.S) if t]
        self.upto = np.concatenate([[0.0], np.cumsum([self.units(t, formulas) for t in self.tokens])])
        solid = np.array([-1] + [-1 if t.isspace() else i for i, t in enumerate(self.tokens)])
        self.solid = np.maximum.accumulate(solid)  # the last token before a position that isn't space
        self.stops = np.array([t.endswith(SPLIT_PUNCTUATION) for t in self.tokens] + [False])

    @staticmethod
    def units(token: str, formulas: dict[str, str]) -> float:
        if token.isspace():
            return max(0.2, len(token) * 0.25)
        if re.fullmatch(r"<[futnvc]\d+-[0-9a-z]{3}/>|\[\[FORMULA_\d+]]|\$(?!\s)(?:\\.|[^$\n]){1,240}?\$", token):
            body = formulas.get(token, token.strip("$"))
            seen = re.sub(r"[{}~\s]", "", re.sub(r"\\[A-Za-z]+", "x", re.sub(STYLE_COMMAND, "", body)))
            return max(1.35, len(seen or re.sub(r"\s+", "", body)) * 0.42)
        if re.fullmatch(r"[一-鿿]", token):
            return 1.0
        return max(1.0, len(token) * 0.55) if re.fullmatch(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*", token) else 0.45

    def cost(self, start, end):
        return self.upto[end] - self.upto[start]

    def after_stop(self, start: int, ends: np.ndarray) -> np.ndarray:
        """Whether the text from start up to each end closes with punctuation."""
        last = self.solid[ends]
        return (last >= start) & self.stops[last]

    def cut(self, start: int, end: int) -> str:
        return "".join(self.tokens[start:end]).strip()


def _first_ends(t: BoxText, capacities: np.ndarray, shares: np.ndarray) -> list[int]:
    """Where each box but the last ends, one box after the other."""
    ends, at, n = [], 0, len(t.tokens)
    for i in range(len(capacities) - 1):
        most = n - (len(capacities) - i - 1)
        rest = t.cost(at, n)
        aim = rest * shares[i] / max(1.0, shares[i:].sum())
        soft = min(aim, capacities[i] * SPLIT["fill"])
        anchor = max(at + 1, min(most, int(np.searchsorted(t.upto, t.upto[at] + soft, "left"))))
        every = np.arange(at + 1, max(most, at + 1) + 1)
        every = every[every <= most]
        if not len(every):
            ends.append(min(at + 1, n))
            at = ends[-1]
            continue
        stop = t.after_stop(at, every)
        probe = every[stop | (np.abs(every - anchor) <= SPLIT["window"]) | (every == at + 1) | (every == most)]
        stop = t.after_stop(at, probe)
        later = capacities[i + 1 :].sum()
        now_weight, later_weight = SPLIT["roomy_weights"] if later > 0 and capacities[i] >= later * SPLIT["roomy"] else SPLIT["weights"]
        here = t.cost(at, probe)
        score = np.maximum(0.0, here - capacities[i] * SPLIT["full"]) * now_weight + np.maximum(0.0, rest - here - later * SPLIT["later_full"]) * later_weight
        score += np.abs(here - aim) + np.maximum(0.0, capacities[i] * SPLIT["least_fill"] - here) * SPLIT["underfill"] + np.where(stop, 0.0, SPLIT["no_punctuation"])
        at = int(probe[np.argmin(score)])
        ends.append(at)
    return ends


def _moved_end(t: BoxText, start: int, end: int, stop_at: int, left: float, right: float) -> int | None:
    """A better end of the left of two neighbouring boxes, or None."""
    a, b = t.cost(start, end), t.cost(end, stop_at)
    if start >= end or end >= stop_at or a + b <= 0:
        return None
    target = (a + b) * left / (left + right)
    if a - target <= REBALANCE["trigger"] or a / left <= b / right + REBALANCE["ratio_gap"]:
        return None
    back = end - 1 - np.arange(0, end - 1 - start)
    reached = np.flatnonzero(t.upto[end] - t.upto[back] >= a - target) if len(back) else np.zeros(0, int)
    ideal = int(back[reached[0]]) if len(reached) else end - 1
    probe = np.arange(start + 1, end)
    stop = t.after_stop(start, probe)
    probe = probe[(stop | (np.abs(probe - ideal) <= REBALANCE["window"]) | (probe == start + 1) | (probe == end - 1))]
    stop = t.after_stop(start, probe)
    moved = t.cost(probe, end)
    fine = (moved > 0) & (stop | (moved >= REBALANCE["least_move"]))
    probe, stop, moved = probe[fine], stop[fine], moved[fine]
    if not len(probe):
        return None
    new_left, new_right = t.cost(start, probe), moved + b
    score = np.abs(new_left - target) + np.abs(new_left / left - new_right / right) * REBALANCE["ratio_weight"] + np.where(stop, 0.0, REBALANCE["no_punctuation"])
    best = int(np.argmin(score))
    return int(probe[best]) if moved[best] > REBALANCE["tolerance"] else None


def split_for_boxes(text: str, formulas: dict[str, str], capacities: list[float], weights: list[float] | None = None, direct: bool = False) -> list[str]:
    """A text cut into one part for each box by capacity, at punctuation where it can, then evened out between neighbours.

    A formula's width is that of its visible characters; no text gives empty parts.
    """
    if len(capacities) <= 1:
        return [text.strip()]
    t = BoxText(text, formulas, direct)
    room = np.maximum(1.0, np.array(capacities, float))
    if not len(t.tokens) or t.upto[-1] <= 0:
        return [t.cut(0, len(t.tokens))] + [""] * (len(capacities) - 1)
    ends = [0, *_first_ends(t, room, np.maximum(1.0, np.array(weights, float)) if weights else room), len(t.tokens)]
    for _ in range(REBALANCE["passes"]):
        changed = False
        for i in range(len(room) - 1):
            new = _moved_end(t, ends[i], ends[i + 1], ends[i + 2], room[i], room[i + 1])
            if new is not None:
                ends[i + 1], changed = new, True
        if not changed:
            break
    return [t.cut(a, b) for a, b in zip(ends, ends[1:])]


@F.pandas_udf(T.ArrayType(T.StringType()))
def box_parts(text: pd.Series, formulas: pd.Series, capacities: pd.Series) -> pd.Series:
    """Parts of each text for its boxes; ``formulas`` are arrays of struct<placeholder, formula_text>."""
    known = lambda row: {e["placeholder"]: e["formula_text"] for e in row} if row is not None else {}
    return pd.Series([split_for_boxes(t or "", known(f), list(c)) for t, f, c in zip(text, formulas, capacities)])


@F.pandas_udf(T.StringType())
def lenient_json(text: pd.Series) -> pd.Series:
    """The JSON object in a reply: fences cut, curly quotes straightened, trailing commas dropped; null if none is left."""
    import json
    import re

    def fix(t: str | None) -> str | None:
        s = re.sub(r"^```[a-z]*\s*|\s*```$", "", (t or "").strip())
        s = s.translate({0x201C: '"', 0x201D: '"', 0x2018: "'", 0x2019: "'"})
        a, b = s.find("{"), s.rfind("}")
        if a < 0 or b < a:
            return None
        s = re.sub(r",\s*([}\]])", r"\1", s[a : b + 1])
        for attempt in (s, re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', s)):
            try:
                return json.dumps(json.loads(attempt, strict=False), ensure_ascii=False, sort_keys=True)
            except ValueError:
                continue
        return None

    return pd.Series([fix(t) for t in text])
