"""Fitting text into boxes: estimated lines and heights, the largest size that fits, and what to change."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Widths in ems, limits and patterns that results depend on.
CHINESE, ASCII, PUNCTUATION_WIDTH, SPACE = 1.0, 0.55, 0.62, 0.32
FORMULA_BASE, FORMULA_CHAR, FORMULA_MOST, FORMULA_HEIGHT = 0.65, 0.24, 4.8, 1.04
LINE_SAFETY, LINE_FLOOR, LEAST_SIZE, PRECISION = 0.98, 1.02, 7.8, 0.04
TARGET_FILL, MOST_GROWTH, MOST_SHRINK = 0.86, 0.35, 0.6
TOKEN = re.compile(
    r"(?P<placeholder>__FORMULA_\d+__|⟦FORMULA_\d+⟧|<FORMULA_\d+>)|(?P<dollar>\$(?!\s)(?:\\.|[^$\n]){1,240}?\$)|(?P<word>[A-Za-z0-9]+(?:[-_./][A-Za-z0-9]+)*)"
    r"|(?P<space>\s)|(?P<zh>[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff])|(?P<stop>[，。！？；：、,.!?;:()\[\]{}<>《》“”‘’\"'])|(?P<other>.)",
    re.S,
)
COMPLEX = r"\\(?:frac|dfrac|tfrac|sqrt|sum|prod|int|delta|Delta|partial|mathbf|begin|overline|underline)"
WIDTH = {"space": SPACE, "zh": CHINESE, "stop": PUNCTUATION_WIDTH, "other": ASCII}


def formula_width(text: str) -> float:
    return min(FORMULA_MOST, FORMULA_BASE + FORMULA_CHAR * len(re.sub(r"\\[A-Za-z]+|[\s{}]", "", text)))


@dataclass
class Ems:
    """The tokens of a text: their widths and which are formulas."""

    width: np.ndarray
    formula: np.ndarray

    def __post_init__(self):
        self.widths, self.formulas = self.width.tolist(), self.formula.tolist()
        self.upto, self.marks = [0.0, *accumulate(self.widths)], [0, *accumulate(map(int, self.formulas))]

    @staticmethod
    def of(text: str, formulas: dict[str, str]) -> Ems:
        width, formula = [], []
        for m in TOKEN.finditer(text):
            kind, body = m.lastgroup, m[0]
            formula.append(kind in ("placeholder", "dollar"))
            if kind == "placeholder":
                width.append(formula_width(formulas.get(body, body)))
            elif kind == "dollar":
                width.append(formula_width(body.strip("$")))
            else:
                width.append(max(0.8, len(body) * ASCII) if kind == "word" else WIDTH[kind])
        return Ems(np.array(width), np.array(formula, bool))

    def ratio(self) -> float:
        """Share of the width that formulas take."""
        total = self.width.sum()
        return float(self.width[self.formula].sum() / total) if total > 0 else 0.0

    def lines(self, box: float, size: float) -> tuple[int, int]:
        """(lines, lines with a formula) when every line is filled as far as it goes; a token wider than a line runs on over several."""
        if box <= 0 or size <= 0:
            return 1, 0
        room = max(1.0, box * LINE_SAFETY / size)
        width, formula, upto, marks = self.widths, self.formulas, self.upto, self.marks
        n, at, lines, marked, used, has = len(width), 0, 1, 0, 0.0, False
        while at < n:
            if used == 0.0 and width[at] > room:
                lines += math.ceil(width[at] / room) - 1
                used, has, at = width[at] % room, has or formula[at], at + 1
                continue
            to = max(at, bisect_right(upto, upto[at] + room - used + 1e-9, at) - 1)
            used, has, at = used + upto[to] - upto[at], has or marks[to] > marks[at], to
            if at < n:
                marked, lines, used, has = marked + has, lines + 1, 0.0, False
        return lines, marked + has

    def height(self, box: float, size: float, leading: float) -> tuple[float, int]:
        lines, marked = self.lines(box, size)
        return round(lines * max(size * LINE_FLOOR, size * (1.0 + leading)) + marked * size * (FORMULA_HEIGHT - 1.0), 2), lines


ESTIMATE = T.StructType([T.StructField("size", T.DoubleType()), T.StructField("height", T.DoubleType()), T.StructField("lines", T.IntegerType()), T.StructField("overflow", T.DoubleType()), T.StructField("formula_ratio", T.DoubleType())])


def _known(row) -> dict[str, str]:
    return {e["placeholder"]: e["formula_text"] or "" for e in row if e["placeholder"]} if row is not None else {}


@F.pandas_udf(ESTIMATE)
def estimate(width: pd.Series, height: pd.Series, text: pd.Series, formulas: pd.Series, size: pd.Series, leading: pd.Series) -> pd.DataFrame:
    """Height and lines of a text at a size; ``formulas`` are arrays of struct<placeholder, formula_text>."""
    out = []
    for w, h, t, f, s, lead in zip(width, height, text, formulas, size, leading):
        ems = Ems.of(t or "", _known(f))
        tall, lines = ems.height(w, s, lead)
        out.append((round(s, 2), tall, lines, 0.0, round(ems.ratio(), 3)))
    return pd.DataFrame(out, columns=["size", "height", "lines", "overflow", "formula_ratio"])


@F.pandas_udf(ESTIMATE)
def solve(width: pd.Series, height: pd.Series, text: pd.Series, formulas: pd.Series, leading: pd.Series, least: pd.Series, most: pd.Series) -> pd.DataFrame:
    """The largest size between two limits at which a text fits its box, by halving the interval; the least one if none does."""
    out = []
    for w, h, t, f, lead, low, high in zip(width, height, text, formulas, leading, least, most):
        ems = Ems.of(t or "", _known(f))
        low = max(LEAST_SIZE, low)
        high = max(low, high)
        best = (low, *ems.height(w, low, lead))
        while high - low > PRECISION:
            mid = (low + high) / 2.0
            tall, lines = ems.height(w, mid, lead)
            if tall <= h:
                best, low = (mid, tall, lines), mid
            else:
                high = mid
        out.append((round(best[0], 2), best[1], best[2], round(best[1] / max(h, 1.0), 3), round(ems.ratio(), 3)))
    return pd.DataFrame(out, columns=["size", "height", "lines", "overflow", "formula_ratio"])


def _force(x: Column, slope: float) -> Column:
    """0 for nothing or less, towards 1 for much."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1.0 / (1.0 + F.exp(-slope * x)) - 0.5) * 2.0))


def plan(height: Column, text: Column, formulas: Column, size: Column, estimated: Column, most_size: Column | None = None) -> Column:
    """What a text's size should change to, with the reasons: struct<size, mode, growth, shrink, overflow, reasons>.

    ``estimated`` is what ``estimate`` gives at the present size. The more of a
    text is formulas, the less the estimate is trusted.
    """
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    given = F.coalesce(formulas, F.array().cast("array<struct<placeholder:string,formula_text:string>>"))
    body = F.transform(given, lambda e: F.coalesce(e["formula_text"], F.lit("")))
    commands = F.transform(body, lambda f: F.regexp_count(f, F.lit(COMPLEX)))
    scripts = F.transform(body, lambda f: F.regexp_count(f, F.lit("[_^]")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    count = F.size(given)
    complex_ = F.size(F.filter(commands, lambda c: c > 0))
    complexity = total(F.transform(commands, lambda c: c * 0.16)) + total(F.transform(scripts, lambda c: F.least(F.lit(0.12), c * 0.025))) + total(F.transform(body, lambda f: F.least(F.lit(0.06), F.greatest(F.lit(0), F.length(f) - 48) * 0.0015)))
    chars = F.greatest(F.lit(1.0), F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")).cast("double"))
    share = F.when(count > 0, F.bround(unit(count / (count + chars / 12.0)), 3)).otherwise(0.0)
    complexity = F.when(count > 0, F.bround(unit(complexity), 3)).otherwise(0.0)
    ratio = estimated["formula_ratio"]
    weight = ratio * 0.65 + share * 0.55 + (count - complex_) * 0.055 + complex_ * 0.26 + complexity * 0.45
    trust = F.greatest(F.lit(0.22), F.exp(-1.35 * F.greatest(F.lit(0.0), weight)))
    discount = 1.0 - 0.18 * _force(ratio * 0.42 + share * 0.38 + complex_ * 0.05, 3.0)
    fill = estimated["height"] * discount / F.greatest(height, F.lit(1.0))
    room = F.lit(MOST_GROWTH) if most_size is None else F.least(F.lit(MOST_GROWTH), F.greatest(F.lit(0.0), most_size - size))
    safe = F.when(ratio <= 0.15, 0.6).when(ratio <= 0.35, 0.4).otherwise(0.2)
    growth = F.bround(room * _force((TARGET_FILL - fill) / TARGET_FILL, 5.0) * trust, 3)
    shrink = F.bround(F.least(F.lit(MOST_SHRINK), safe) * _force(fill - TARGET_FILL, 4.2) * trust * trust, 3)
    new = F.bround(size + growth - shrink, 2)
    new = new if most_size is None else F.least(new, most_size)
    new = F.bround(F.greatest(F.lit(LEAST_SIZE), new), 2)
    reasons = F.array_compact(F.array(F.when(growth > 0, "underfilled_body"), F.when(shrink > 0, "height_pressure"), F.when(ratio > 0, "formula_weighted"), F.when(complexity > 0, "formula_complexity"), F.when(count > 0, "formula_count_weighted")))
    mode = F.when(F.abs(new - size) >= 0.005, "continuous_fit").otherwise("fast_estimate")
    return F.struct(new.alias("size"), mode.alias("mode"), F.bround(growth, 2).alias("growth"), F.bround(shrink, 2).alias("shrink"), fill.alias("overflow"), trust.alias("trust"), reasons.alias("reasons"))
