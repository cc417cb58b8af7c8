"""Stored similarity index: vectors with metadata in one Parquet table, statistics in a one-row one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.operators.search import build_index
from tracklake.operators.vectorise import STATS_SCHEMA, VectorStats
from tracklake.sources.library import path_exists


def snapshot(view: DataFrame) -> dict:
    """Row count and an order-free digest of the source, to tell whether an index still fits it."""
    mark = F.xxhash64(*view.columns)
    # Equal rows cancel in the exclusive or, so a sum stands beside it.
    row = view.agg(F.count("*").alias("source_rows"), F.bit_xor(mark).alias("source_digest"),
                   F.coalesce(F.sum(F.pmod(mark, F.lit(1 << 31))), F.lit(0)).alias("source_sum")).first()
    return row.asDict()


def save_index(spark: SparkSession, path: str, index: DataFrame, stats: VectorStats, source: dict, version: str | None = None) -> int:
    """The statistics are written last: their presence marks a complete index."""
    index.write.mode("overwrite").parquet(f"{path}/vectors")
    rows = spark.read.parquet(f"{path}/vectors").count()
    record = [{**asdict(stats), "source_rows": None, "source_digest": None, "source_sum": None, **source, "source_version": version, "indexed_rows": rows}]
    schema = f"{STATS_SCHEMA}, source_rows long, source_digest long, source_sum long, source_version string, indexed_rows long"
    spark.createDataFrame(record, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return rows


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, VectorStats]:
    return spark.read.parquet(f"{path}/vectors"), VectorStats.from_row(spark.read.parquet(f"{path}/stats").first())


def build(spark: SparkSession, path: str, view: DataFrame, missing: str = "defaults", version: str | None = None) -> dict:
    """``version`` names the snapshots the view is made from; without it the rows themselves are digested."""
    index, stats = build_index(view, missing)
    return {"tracks_indexed": save_index(spark, path, index, stats, {} if version else snapshot(view), version), "path": path}


def is_current(spark: SparkSession, path: str, view: DataFrame | None = None, version: str | None = None) -> bool:
    """Complete, of the right shape, and built from the rows the tables hold now. With ``version`` no row is read: the snapshot numbers are compared."""
    if not (path_exists(spark, f"{path}/vectors/_SUCCESS") and path_exists(spark, f"{path}/stats/_SUCCESS")):
        return False
    vectors, stats = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/stats").first().asDict()
    if "album_image_url" not in vectors.columns:
        return False
    if version is not None:
        return stats.get("source_version") == version
    return vectors.count() == stats["indexed_rows"] and {k: stats[k] for k in ("source_rows", "source_digest", "source_sum")} == snapshot(view)


def ensure_index(spark: SparkSession, path: str, view: Callable[[], DataFrame], version: str | None = None) -> tuple[DataFrame, VectorStats]:
    """The stored index, built anew where it does not fit. ``view`` is only called where its rows are needed."""
    source = None if version else view()
    if not is_current(spark, path, source, version):
        build(spark, path, view() if source is None else source, version=version)
    return load_index(spark, path)
