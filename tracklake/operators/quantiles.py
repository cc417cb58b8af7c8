"""Exact medians of many columns by refinement: counted histograms narrow the interval of every column in the same passes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.session import settle

BINS = 4_096          # parts of an interval in one pass
PLAIN_ROWS = 10_000   # an interval of at most so many values is counted value by value, which ends the search


class _Search:
    """Where the two middle values of a column lie: among the values from ``low`` to ``high``, at ``ranks`` of them, counted from 0."""

    def __init__(self, n: int, low: float | None, high: float | None):
        self.n, self.low, self.high = n, low, high
        self.ranks = ((n - 1) // 2, n // 2)
        self.found: tuple[float, float] | None = None
        self.passes = 0

    def key(self, value: Column, plain_rows: int, bins: int) -> Column:
        """The ordered part of the interval that a value belongs to; null outside. Infinities and NaN, which sorts last, have parts of
        their own beside the finite interval. Halves are subtracted, as the width of an interval may exceed the largest double."""
        low, high = self.low, self.high
        inside = F.when((value >= low) & (value <= high), self._part(value, plain_rows, bins)) if low is not None else F.lit(None).cast("double")
        if self.passes:
            return inside
        return F.when(F.isnan(value) | (F.abs(value) == math.inf), value).otherwise(inside)

    def _part(self, value: Column, plain_rows: int, bins: int) -> Column:
        width = self.high / 2 - self.low / 2
        if not width:  # one value, or neighbours so close to zero that their halves agree
            return value
        if self.n <= plain_rows:
            return value
        if self.passes == 1:  # by powers of two, once: an interval then spans one of them, however unevenly its values are spread
            return F.signum(value) * F.coalesce(F.floor(F.log2(F.abs(value))) + 1_100, F.lit(0)).cast("double")
        return F.least(F.lit(float(bins - 1)), F.floor((value / 2 - F.lit(self.low / 2)) / F.lit(width) * bins).cast("double"))

    def narrow(self, parts: list) -> None:
        """``parts``: the one or two parts that hold the middle values, in order, as (seen, n, least, most)."""
        self.passes += 1
        if len(parts) > 1:
            self.found = (parts[0]["most"], parts[1]["least"])
        elif parts[0]["least"] == parts[0]["most"] or math.isnan(parts[0]["least"]):
            self.found = (parts[0]["least"], parts[0]["most"])
        else:
            before = parts[0]["seen"] - parts[0]["n"]
            self.ranks = tuple(r - before for r in self.ranks)
            self.n, self.low, self.high = parts[0]["n"], parts[0]["least"], parts[0]["most"]

    @property
    def median(self) -> float | None:
        if self.found is None:
            return None
        low, high = self.found
        return low if low == high else 0.5 * low + 0.5 * high


def medians(rows: DataFrame, columns: list[str], bins: int = BINS, plain_rows: int = PLAIN_ROWS) -> list[float | None]:
    """The median of every column (mean of the two middle values; nulls do not count; none without values).

    Every pass counts the values of all unfinished columns by parts of their intervals, before the shuffle, and keeps the parts that
    hold the middle ranks. A pass divides an interval by ``bins``, so whole numbers of a small range take one pass and any doubles
    at most seven; no buffer grows with the different values of a column. At most two rows per column come back from a pass."""
    numbers = settle(rows.select(*[F.col(c).cast("double").alias(f"_q{i}") for i, c in enumerate(columns)]))
    names = [f"_q{i}" for i in range(len(columns))]
    finite = {c: F.when(F.abs(F.col(c)) < math.inf, F.col(c)) for c in names}  # NaN is greater than any number
    ends = numbers.agg(*[F.count(c).alias(f"n{c}") for c in names], *[F.min(v).alias(f"l{c}") for c, v in finite.items()],
                       *[F.max(v).alias(f"h{c}") for c, v in finite.items()]).first()
    searches = {c: _Search(ends[f"n{c}"], ends[f"l{c}"], ends[f"h{c}"]) for c in names}
    while open_ := {c: s for c, s in searches.items() if s.n and s.found is None}:
        keyed = numbers.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("c"), s.key(F.col(c), plain_rows, bins).alias("part"), F.col(c).alias("value")) for c, s in open_.items()])).alias("e"))
        counted = (keyed.select("e.*").filter(F.col("part").isNotNull()).groupBy("c", "part")
                   .agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")))
        seen = counted.withColumn("seen", F.sum("n").over(Window.partitionBy("c").orderBy("part")))
        rank = [F.create_map(*[x for c, s in open_.items() for x in (F.lit(c), F.lit(s.ranks[i]).cast("long"))])[F.col("c")] for i in (0, 1)]
        held = seen.filter((F.col("seen") > rank[0]) & (F.col("seen") - F.col("n") <= rank[1])).collect()
        for c, search in open_.items():
            search.narrow(sorted((r for r in held if r["c"] == c), key=lambda r: r["seen"]))
    return [searches[c].median for c in names]
