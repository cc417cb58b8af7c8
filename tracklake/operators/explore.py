"""What the exploration views show: cluster lists and samples, axis scaling, neighbourhoods, outlines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracklake.constants import AXIS_MIN_PROXIMITY, AXIS_NEIGHBOURS, AXIS_RADIUS

NO_CLUSTER = "unclustered"


def cluster_text() -> Column:
    return F.coalesce(F.col("cluster").cast("string"), F.lit(NO_CLUSTER))


def focus(rows: DataFrame, cluster: str) -> DataFrame:
    return rows.filter(cluster_text() == F.lit(cluster))


def cluster_sizes(rows: DataFrame) -> DataFrame:
    """Clusters with their sizes, numbers in numeric order before other names."""
    return (rows.groupBy(cluster_text().alias("cluster")).agg(F.count("*").alias("tracks"))
            .orderBy(F.asc_nulls_last(F.col("cluster").try_cast("double")), "cluster"))


def totals(rows: DataFrame) -> DataFrame:
    numeric = sum(t in ("int", "bigint", "double", "float", "smallint", "tinyint") for _, t in rows.dtypes)
    return rows.agg(F.count("*").alias("tracks"), F.count_distinct(cluster_text()).alias("clusters"),
                    F.lit(numeric).alias("numeric_features"))


def cluster_detail(rows: DataFrame, order: list, sample: int = 5) -> DataFrame:
    """Size of each cluster and its first ``sample`` rows.

    Sizes are aggregated and the rank filter works before the shuffle, so no cluster is gathered in one task."""
    named = rows.withColumn("cluster", cluster_text())
    first = (named.withColumn("sample_no", F.row_number().over(W.partitionBy("cluster").orderBy(*order)))
             .filter(F.col("sample_no") <= sample))
    return first.join(named.groupBy("cluster").agg(F.count("*").alias("tracks")), "cluster")


def axis_normalise(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values within 0..100 map to [-1, 1] around 50; other columns by their range; constants to 0."""
    span = rows.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]).alias("s"))
    bounds = rows.withColumn("_s", span.scalar())

    def scaled(c: str) -> Column:
        v, lo, hi = F.col(c).cast("double"), F.col(f"_s.min_{c}").cast("double"), F.col(f"_s.max_{c}").cast("double")
        return (F.when((lo >= 0) & (hi <= 100), v / 50.0 - 1.0).when(lo == hi, 0.0)
                .otherwise(F.try_divide(v - lo, hi - lo) * 2.0 - 1.0))

    return bounds.withColumns({f"{c}_axis": scaled(c) for c in columns}).drop("_s")


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*0[xX][0-9a-fA-F]+\s*$|^\s*0[oO][0-7]+\s*$|^\s*0[bB][01]+\s*$"


def numeric_columns(rows: DataFrame, skip: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """(column_name, non_empty, numeric, is_numeric): a column of text is numeric if every value that is not empty is.

    One pass counts all columns. Blank-only text reads as the number 0."""
    columns = [c for c in rows.columns if c not in skip]

    def text(c: str) -> Column:
        return F.col(f"`{c}`").cast("string")

    def finite(c: str) -> Column:
        value = text(c).try_cast("double")
        plain = text(c).rlike(NUMBER) & (value.isNull() | (F.abs(value) < float("inf")))
        return plain | (F.length(F.trim(text(c))) == 0)

    filled = {c: text(c).isNotNull() & (text(c) != "") for c in columns}
    counts = rows.agg(*[x for i, c in enumerate(columns) for x in (
        F.count_if(filled[c]).alias(f"n{i}"), F.count_if(filled[c] & finite(c)).alias(f"m{i}"))])
    rows_out = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("non_empty"),
                                  F.col(f"m{i}").alias("numeric")) for i, c in enumerate(columns)])
    return (counts.select(F.explode(rows_out).alias("r")).select("r.*")
            .withColumn("is_numeric", (F.col("non_empty") > 0) & (F.col("non_empty") == F.col("numeric"))))


def cast_numeric(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Text to numbers; empty text is 0."""
    return rows.withColumns({c: F.when(F.trim(c) == "", 0.0).otherwise(F.col(c).try_cast("double")) for c in columns})


def axis_neighbours(rows: DataFrame, selected, axes: list[str], id_col: str = "track_id") -> DataFrame:
    """The up to twenty nearest rows of the selected row's cluster in the space of the given axes."""
    at = rows.filter(F.col(id_col) == F.lit(selected)).select(cluster_text().alias("c"), *axes).head()
    if at is None:
        raise ValueError(f"Unknown row: {selected}")
    squares = [(F.col(a) - F.lit(float(at[a]))) * (F.col(a) - F.lit(float(at[a]))) for a in axes]
    distance = F.sqrt(sum(squares[1:], squares[0]))
    proximity = F.greatest(F.lit(0.0), F.lit(1.0) - distance / F.lit(AXIS_RADIUS))
    return (focus(rows, at["c"]).filter(F.col(id_col) != F.lit(selected)).withColumn("proximity", proximity)
            .filter(F.col("proximity") > AXIS_MIN_PROXIMITY).orderBy(F.desc("proximity"), id_col).limit(AXIS_NEIGHBOURS))


def _outline(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Counter-clockwise hull of a sorted list of distinct points (monotone chain)."""
    if len(points) <= 2:
        return points

    def half(walk):
        chain = []
        for x, y in walk:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2:]
                if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                    break
                chain.pop()
            chain.append((x, y))
        return chain[:-1]

    return half(points) + half(points[::-1])


def cluster_hulls(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(cluster, corner, x, y): convex outline of each cluster in the plane of two features.

    The hull of a union is the hull of the hulls. Every partition is reduced to its hulls before anything is moved; the hulls
    of a cluster, one per partition at most, are merged in salted groups first, about the square root of their number."""
    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, part in pdf.groupby("cluster"):
            hull = _outline(sorted(set(zip(part["x"].tolist(), part["y"].tolist()))))
            out.append(pd.DataFrame({"cluster": name, "corner": range(1, len(hull) + 1),
                                     "x": [p[0] for p in hull], "y": [p[1] for p in hull]}))
        return pd.concat(out) if out else pdf.assign(corner=[])[["cluster", "corner", "x", "y"]]

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in parts:
            held = reduce(part if held is None else pd.concat([held[["cluster", "x", "y"]], part]))
        if held is not None:
            yield held

    schema = "cluster string, corner int, x double, y double"
    hulls = (rows.select(cluster_text().alias("cluster"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
             .dropna().mapInPandas(batches, schema))
    for groups in (math.ceil(math.sqrt(rows.rdd.getNumPartitions())), 1):
        salt = F.pmod(F.xxhash64("x", "y"), F.lit(groups)).alias("salt")
        hulls = hulls.groupBy("cluster", salt).applyInPandas(lambda pdf: reduce(pdf[["cluster", "x", "y"]]), schema)
    return hulls
