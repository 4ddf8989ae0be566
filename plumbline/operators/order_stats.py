"""Exact quantiles of large numeric columns by narrowing ranges of ranks, never by holding all values."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranks that an approximate percentile of one pass may be off by, as a part of the values looked at.
ACCURACY = 10_000
#: Values that may be brought to the driver to finish a rank.
FINISH = 20_000


@dataclass
class _Open:
    """A rank that is looked for among the ``inside`` values of [low, high]; ``below`` values are smaller than ``low``."""

    rank: int
    low: float
    high: float
    below: int
    inside: int

    def within(self) -> Column:
        return F.col("v").between(self.low, self.high)


def _narrow(values: DataFrame, ranks: list[_Open]) -> None:
    """Close in on all ranks at once, in two passes: approximate percentiles around each, then exact counts at them."""
    some = F.lit(False)
    for r in ranks:
        some = some | r.within()
    near = []
    for n, r in enumerate(ranks):
        at = (r.rank - r.below + 0.5) / r.inside
        ends = F.array(F.lit(max(0.0, at - 2 / ACCURACY)), F.lit(min(1.0, at + 2 / ACCURACY)))
        near.append(F.percentile_approx(F.when(r.within(), F.col("v")), ends, ACCURACY).alias(f"p{n}"))
    cuts = values.filter(some).agg(*near).first()
    counts = []
    for n, r in enumerate(ranks):
        lo, hi = cuts[f"p{n}"]
        for name, c in (("a", F.col("v") < lo), ("b", F.col("v") == lo), ("c", F.col("v") == hi), ("d", F.col("v") > hi)):
            counts.append(F.sum((r.within() & c).cast("bigint")).alias(f"{name}{n}"))
        inner = r.within() & (F.col("v") > lo) & (F.col("v") < hi)
        counts += [F.min(F.when(inner, F.col("v"))).alias(f"l{n}"), F.max(F.when(inner, F.col("v"))).alias(f"h{n}")]
        counts += [F.max(F.when(r.within() & (F.col("v") < lo), F.col("v"))).alias(f"u{n}"), F.min(F.when(r.within() & (F.col("v") > hi), F.col("v"))).alias(f"o{n}")]
    c = values.filter(some).agg(*counts).first()
    for n, r in enumerate(ranks):
        lo, hi = cuts[f"p{n}"]
        under, at_lo, at_hi, over = (c[f"{x}{n}"] for x in "abcd")
        place = r.rank - r.below
        if place < under:
            r.high, r.inside = c[f"u{n}"], under
        elif place < under + at_lo:
            r.low = r.high = lo
        elif place >= r.inside - over:
            r.low, r.below, r.inside = c[f"o{n}"], r.below + r.inside - over, over
        elif lo == hi or place >= r.inside - over - at_hi:
            r.low = r.high = hi
        else:
            r.low, r.high, r.below, r.inside = c[f"l{n}"], c[f"h{n}"], r.below + under + at_lo, r.inside - under - at_lo - at_hi - over


def quantiles(df: DataFrame, col: str | Column, qs: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation between neighbouring ranks; None for a column without values.

    Null and NaN values are left out; infinities count as the smallest and largest values. All ranks are found together:
    one pass for the ends, then two passes for each step, which leaves about a 2,500th of the values; the last FINISH
    values of a rank are brought to the driver.
    """
    c = F.col(col) if isinstance(col, str) else col
    values = df.select(c.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not ends["n"]:
        return [None] * len(qs)
    wanted = sorted({r for q in qs for r in (math.floor(q * (ends["n"] - 1)), math.ceil(q * (ends["n"] - 1)))})
    ranks = [_Open(r, ends["lo"], ends["hi"], 0, ends["n"]) for r in wanted]
    while wide := [r for r in ranks if r.low != r.high and r.inside > FINISH]:
        _narrow(values, wide)
    found = {r.rank: r.low for r in ranks if r.low == r.high}
    for low, high, below in {(r.low, r.high, r.below) for r in ranks if r.low != r.high}:
        rest = np.sort(values.filter(F.col("v").between(low, high)).toArrow().column("v").to_numpy())  # at most FINISH values
        found |= {r.rank: float(rest[r.rank - below]) for r in ranks if (r.low, r.high, r.below) == (low, high, below)}
    out = []
    for q in qs:
        at = q * (ends["n"] - 1)
        low, high = found[math.floor(at)], found[math.ceil(at)]
        out.append(low if low == high else low + (high - low) * (at - math.floor(at)))
    return out


class Histogram:
    """Distinct values of a column of counts with their frequencies, on the driver.

    A column of non-negative whole numbers that add up to ``t`` has at most ``sqrt(2 t)`` distinct values, so this stays
    small for neighbour counts and cell sizes of any index. Nulls are left out.
    """

    def __init__(self, df: DataFrame, col: str):
        rows = sorted((r["v"], r["n"]) for r in df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n")).collect())
        self.v, self.c = (np.array([r[i] for r in rows], dtype=np.float64) for i in (0, 1))
        self.n, self.total = int(self.c.sum()), float((self.v * self.c).sum())
        self.mean = self.total / self.n if self.n else None

    def moment(self, k: int) -> float:
        return float((((self.v - self.mean) ** k) * self.c).sum() / self.n)

    def quantile(self, q: float, v: np.ndarray | None = None) -> float | None:
        """With linear interpolation; of other values at the same frequencies if ``v`` is given."""
        if not self.n:
            return None
        values = self.v if v is None else v
        order = np.argsort(values, kind="stable")
        ends = np.cumsum(self.c[order])
        at = q * (self.n - 1)
        low, high = (float(values[order][np.searchsorted(ends, math.floor(x), side="right")]) for x in (at, math.ceil(at)))
        return low + (high - low) * (at - math.floor(at))

    def share_of_largest(self, m: int) -> float:
        """Part of the total that the ``m`` largest rows hold; 0 if the total is 0."""
        c = self.c[::-1]
        before = np.concatenate([[0], np.cumsum(c)[:-1]]) if len(c) else c
        take = np.clip(m - before, 0, c)
        return float((take * self.v[::-1]).sum() / self.total) if self.total else 0.0

    def gini(self) -> float:
        if not self.total:
            return 0.0
        ends = np.cumsum(self.c)
        ranks = self.c * (2 * ends - self.c + 1) / 2  # sum of the ranks of equal values
        return float((2 * (ranks * self.v).sum() - (self.n + 1) * self.total) / (self.n * self.total))
