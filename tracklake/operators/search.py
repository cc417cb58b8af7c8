"""Exact cosine search over unit vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracklake.constants import MODEL_FEATURES, NUMERIC_FEATURES
from tracklake.functions.vectors import dot_literal
from tracklake.operators.vectorise import VectorStats, fit_vectors, vectorise

RESULT = ["rank", "track_id", "track_name", "artist_names", "album_name", "album_image_url", "score"]
FEATURE_TYPES = {c: "double" for c in NUMERIC_FEATURES} | {"key": "string", "mode": "string", "camelot": "string"}


def build_index(view: DataFrame, missing: str = "defaults") -> tuple[DataFrame, VectorStats]:
    """(view plus unit vector, statistics). ``view`` holds one row per track."""
    stats = fit_vectors(view.select(*MODEL_FEATURES), missing)
    return vectorise(view, stats), stats


def query_vector(spark: SparkSession, values: dict, stats: VectorStats) -> list[float]:
    """Vector of one query given as feature values; absent ones take the index defaults."""
    unknown = set(values) - set(MODEL_FEATURES)
    if unknown:
        raise ValueError(f"Unknown features: {sorted(unknown)}")
    row = spark.range(1).select(*[F.lit(values.get(c)).cast(FEATURE_TYPES[c]).alias(c) for c in MODEL_FEATURES])
    return vectorise(row, stats).first()["vector"]


def nearest(index: DataFrame, vector: list[float], k: int, exclude: DataFrame | None = None,
            exclude_ids: list | None = None, id_col: str = "track_id", score: str = "score") -> DataFrame:
    """The k best rows by inner product, ranked from 1; ties go to the smaller id.

    Excluded rows leave before the limit, so nothing is over-fetched. The query is a literal: the scan is one
    generated expression, and only k rows per task reach the final merge."""
    scored = index.withColumn(score, dot_literal(F.col("vector"), vector))
    if exclude_ids:
        scored = scored.filter(~F.col(id_col).isin(list(exclude_ids)))
    if exclude is not None:
        scored = scored.join(exclude.select(id_col), id_col, "left_anti")
    top = scored.orderBy(F.desc(score), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), id_col)))


def search_by_vector(index: DataFrame, vector: list[float], k: int = 5, **kw) -> DataFrame:
    return nearest(index, vector, k, **kw).select(*RESULT)


def search_by_track_id(index: DataFrame, track_id: str, k: int = 5, stats: VectorStats | None = None,
                       fresh: DataFrame | None = None) -> DataFrame:
    """Tracks most similar to one track, which itself is left out.

    A track the index does not hold yet is looked up in ``fresh`` and placed with the index statistics."""
    row = index.filter(F.col("track_id") == track_id).select("vector").head()
    if row is None and fresh is not None and stats is not None:
        row = vectorise(fresh.filter(F.col("track_id") == track_id), stats).select("vector").head()
    if row is None:
        raise ValueError(f"Track id not found: {track_id}")
    return search_by_vector(index, row["vector"], k, exclude_ids=[track_id])


def search_by_features(index: DataFrame, stats: VectorStats, k: int = 5, **features) -> DataFrame:
    """Tracks most similar to any subset of the thirteen feature values."""
    given = {name: value for name, value in features.items() if value is not None}
    if not given:
        raise ValueError("Provide at least one feature value.")
    return search_by_vector(index, query_vector(index.sparkSession, given, stats), k)


