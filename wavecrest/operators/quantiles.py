"""Exact quantiles of columns of any size.

A rank is narrowed to an interval between two values of the column.  Each round takes three splitters near
the rank's place from an approximate percentile of the interval (a sketch of bounded size in each task),
counts exactly how many rows lie below, at and between them, and goes on where the rank lies; a splitter's
own value may be the answer.  An interval of few rows is fetched.  Counts are exact, so the sketch only
decides how many rounds it takes: two or three, each of two passes without a shuffle of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an interval that come to the driver, and the sketch's accuracy.
FEW, ACCURACY = 4096, 10_000


@dataclass
class _Rank:
    """The rank-th row of those strictly between low and high (None: unbounded), of which there are rows."""

    rank: int
    rows: int
    low: float | None = None
    high: float | None = None
    found: float | None = None

    def inside(self, x: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (x > self.low)
        if self.high is not None:
            out = out & (x < self.high)
        return out

    def places(self) -> list[float]:
        """Fractions before, at and behind the rank, as far apart as the sketch may err."""
        at, off = (self.rank + 0.5) / self.rows, 2 / ACCURACY
        return [min(1.0, max(0.0, f)) for f in (at - off, at, at + off)]

    def narrow(self, splitters: list[float], below: list[int], at: list[int]) -> None:
        """Splitters in order, with the rows of the interval below and at each."""
        for k, s in enumerate(splitters):
            if self.rank < below[k]:
                before = below[k - 1] + at[k - 1] if k else 0
                self.low, self.high = splitters[k - 1] if k else self.low, s
                self.rank, self.rows = self.rank - before, below[k] - before
                return
            if self.rank < below[k] + at[k]:
                self.found = s
                return
        before = below[-1] + at[-1]
        self.low, self.rank, self.rows = splitters[-1], self.rank - before, self.rows - before


def _value(rows: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    return rows.select(x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))


def values_at(df: DataFrame, column: str, ranks: list[int], few: int = FEW) -> list[float]:
    """The values at ranks from 0 in the column's order.  Nulls and NaN aren't in it; a rank past the end is an error."""
    rows, x = _value(df, column), F.col("_x")
    n = rows.count()
    if any(not 0 <= r < n for r in ranks):
        raise ValueError(f"no such rank among {n} rows")
    states = [_Rank(r, n) for r in ranks]
    while True:
        for s in states:
            if s.found is None and s.rows <= few:
                s.found = sorted(r[0] for r in rows.where(s.inside(x)).collect())[s.rank]
        todo = [s for s in states if s.found is None]
        if not todo:
            return [s.found for s in states]
        near = rows.agg(*(F.percentile_approx(F.when(s.inside(x), x), s.places(), ACCURACY).alias(f"p{k}") for k, s in enumerate(todo))).first()
        splitters = [sorted(set(p)) for p in near]
        counts = [F.count_if(s.inside(x) & c) for s, own in zip(todo, splitters, strict=True) for v in own for c in (x < v, x == v)]
        found = iter(rows.agg(*(c.alias(f"c{k}") for k, c in enumerate(counts))).first())
        for s, own in zip(todo, splitters, strict=True):
            both = [(next(found), next(found)) for _ in own]
            s.narrow(own, [b for b, _ in both], [a for _, a in both])


def exact_quantiles(df: DataFrame, column: str, fractions: list[float], few: int = FEW) -> list[float | None]:
    """Quantiles interpolated between the two rows around a fraction's place; None without rows."""
    if any(not 0 <= f <= 1 for f in fractions):
        raise ValueError("a fraction lies between 0 and 1")
    n = _value(df, column).count()
    if not n:
        return [None] * len(fractions)
    places = [f * (n - 1) for f in fractions]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    value = dict(zip(ranks, values_at(df, column, ranks, few), strict=True))
    return [value[math.floor(p)] + (p - math.floor(p)) * (value[math.ceil(p)] - value[math.floor(p)]) for p in places]
