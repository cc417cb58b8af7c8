"""Model outputs to track features: pooled class scores, key features, composite scores, genres."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracklake.constants import GENRE_MIN_SCORE, GENRE_TOP
from tracklake.functions.music import key_features, unit_scale


def mean_pool(frames: DataFrame, keys: list[str], scores: str = "scores") -> DataFrame:
    """(keys, pos, mean): column means of a frame-by-class matrix.

    A frame stays one row: vectors are summed up before the shuffle, so a track of any length is fine. Frames with gaps, and only these,
    are unrolled; frames of different widths are summed apart and then added position by position."""
    plain = frames.select(*keys, F.col(scores).cast("array<double>").alias("_s")).filter(F.col("_s").isNotNull() & (F.size("_s") > 0))
    gap = F.exists("_s", lambda x: x.isNull())
    sums = (plain.filter(~gap).groupBy(*keys, F.size("_s").alias("_w"))
            .agg(F.count("*").alias("_n"), vector_to_array(Summarizer.sum(array_to_vector("_s"))).alias("_t"))
            .select(*keys, "_n", F.posexplode("_t").alias("pos", "_v")))
    loose = plain.filter(gap).select(*keys, F.posexplode("_s").alias("pos", "_v")).groupBy(*keys, "pos").agg(F.count("_v").alias("_n"), F.sum("_v").alias("_v"))
    return sums.unionByName(loose).groupBy(*keys, "pos").agg(F.try_divide(F.sum("_v"), F.sum("_n")).alias("mean"))


def label_scores(pooled: DataFrame, keys: list[str], labels: Column) -> DataFrame:
    """(keys, label, pos, score): labels paired with pooled scores by position, the shorter list deciding."""
    return (pooled.withColumn("label", F.get(labels, F.col("pos"))).filter(F.col("label").isNotNull())
            .select(*keys, "label", "pos", F.col("mean").alias("score")))


def score_map(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scores map): one entry per class of the model."""
    return scores.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("label", "score"))).alias("scores"))


def top_labels(scores: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k best labels per key, ties in label order."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), "pos")
    return scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def genres(scores: DataFrame, keys: list[str], k: int = GENRE_TOP, least: float = GENRE_MIN_SCORE) -> DataFrame:
    """(keys, genre, genre_order): of the best k labels those with a sufficient score."""
    return (top_labels(scores, keys, k).filter(F.col("score") >= least)
            .select(*keys, F.col("label").alias("genre"), (F.col("place") - 1).alias("genre_order")))


def key_enrichment(rows: DataFrame, key: str = "key", scale: str = "scale", strength: str = "strength") -> DataFrame:
    """Detected key, scale and strength to pitch number, note, mode, camelot code and score."""
    kept = [c for c in rows.columns if c not in (key, scale, strength)]
    return rows.select(*kept, *key_features(F.col(key), F.col(scale), F.col(strength)))


def half_up(value: Column, digits: int = 4) -> Column:
    """Rounds half up as written in decimals: binary noise around a half is cut off first."""
    return F.round(F.round(value, 10), digits)


def composite_scores(rows: DataFrame) -> DataFrame:
    """Sixteen scores from pooled class scores.

    Input columns: danceable, aggressive, happy, party, relaxed, sad, acoustic, instrumental, voice (an absent
    class counts 0), valence_raw and arousal_raw on [1, 9], and the key score. Later scores build on the
    rounded earlier ones."""
    def cls(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    def r(value: Column) -> Column:
        return half_up(value)

    first = rows.withColumns({
        "_arousal": unit_scale(F.col("arousal_raw")), "danceability": r(cls("danceable")),
        "acousticness": r(cls("acoustic")), "instrumentalness": r(cls("instrumental")),
        "valence": r(unit_scale(F.col("valence_raw"))), "happy": r(cls("happy")), "sad": r(cls("sad")),
        "chill": r(cls("relaxed")), "aggressive": r(cls("aggressive")), "vocal_risk": r(cls("voice")),
        "_party": cls("party")})
    second = first.withColumns({
        "energy": r(F.col("_arousal")),
        "dance_floor": r(0.6 * F.col("danceability") + 0.4 * F.col("_arousal")),
        "hype": r(0.5 * F.col("_party") + 0.5 * F.col("_arousal")),
        "warmup": r(0.5 * F.col("chill") + 0.5 * (1.0 - F.col("aggressive"))),
        "blendability": r(0.5 * F.col("score") + 0.5 * (1.0 - F.col("aggressive")))})
    return second.withColumns({
        "groove": r(0.6 * F.col("danceability") + 0.4 * F.col("dance_floor")),
        "peak_time": F.col("hype")}).drop("_arousal", "_party")
