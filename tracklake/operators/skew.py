"""Joins and ranks that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracklake.session import settle

HOT_KEYS = 1000       # a key is hot above a thousandth of all rows, so there are fewer hot keys than this
HOT_ROWS = 100_000    # and never below this many rows


def hot_join(facts: DataFrame, lookup: DataFrame, on: list[str], weight: str = "weight", how: str = "inner",
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join stored ``facts`` to a stored ``lookup`` with one row per key, whose ``weight`` is the number of facts per key.

    The weights tell the hot keys beforehand. These few lookup rows are broadcast, so the facts of a hot key stay
    where they are; all other facts take an ordinary join. The weight is dropped."""
    sums = lookup.agg(F.sum(weight).alias("total"), F.max(weight).alias("most")).first()
    limit = max((sums["total"] or 0) / HOT_KEYS, hot_rows)
    if (sums["most"] or 0) <= limit:
        return facts.join(lookup.drop(weight), on, how)
    hot = lookup.filter(F.col(weight) > limit).drop(weight)
    cold = lookup.filter(F.col(weight) <= limit).drop(weight)
    rest = facts.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return facts.join(F.broadcast(hot), on).unionByName(rest)


def delivered_index(df: DataFrame, name: str = "pos") -> DataFrame:
    """Consecutive positions 0..n-1 in the order in which ``df`` delivers its rows, without one task that sees them all.

    The frame is settled, so that its partitions and their order stay; the sizes of the partitions before a row are added."""
    placed = settle(df.withColumn("_part", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id()))
    # monotonically_increasing_id is partition << 33 plus the row number inside the partition
    placed = placed.withColumn("_local", F.col("_local").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg((F.max("_local") + 1).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (placed.join(F.broadcast(before), "_part")
            .withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before"))


def global_index(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """Consecutive positions 0..n-1 in a total order: rows are range-partitioned and sorted within their partition."""
    return delivered_index(df.repartitionByRange(*order).sortWithinPartitions(*order), name)


def running_sum(df: DataFrame, order: list, column: str, name: str) -> DataFrame:
    """The sum of ``column`` over all rows before a row in ``order``: rows are range-partitioned and summed within their partition."""
    placed = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part").agg(F.sum(column).alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.sum(column).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(column)
    return (placed.withColumn(name, inside).join(F.broadcast(before), "_part")
            .withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before"))
