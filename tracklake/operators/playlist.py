"""Mood ranking, candidate rounds and playlist continuation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracklake.constants import (CANDIDATE_POOL, CANDIDATE_SAMPLE, COSINE_WEIGHT, MOOD_WEIGHT, MOODS,
                                 NUMERIC_FEATURES, PLAYLIST_DEFAULT, STRONG_MATCH, STRONG_MINIMUM)
from tracklake.functions.music import clamp_length, mood_score
from tracklake.functions.vectors import dot_literal
from tracklake.operators.search import nearest, query_vector
from tracklake.operators.vectorise import VectorStats


def mood_scores(tracks: DataFrame) -> DataFrame:
    """Score of every track under every mood, one column per mood."""
    return tracks.withColumns({mood: mood_score(mood) for mood in MOODS})


def sample_by_seed(rows: DataFrame, n: int, seed: int = 0, id_col: str = "track_id") -> DataFrame:
    """``n`` rows in an order shuffled by the seed; the same seed gives the same rows."""
    return rows.orderBy(F.md5(F.concat(F.col(id_col), F.lit(f":{seed}"))), id_col).limit(n)


def first_candidates(tracks: DataFrame, mood: str, taken: DataFrame | None = None) -> DataFrame:
    """The nine best tracks by mood score; only the strong ones among them if there are at least three."""
    scored = tracks.withColumn("score", mood_score(mood))
    if taken is not None:
        scored = scored.join(taken.select("track_id"), "track_id", "left_anti")
    pool = scored.orderBy(F.desc("score"), F.asc_nulls_first("track_name"), "track_id").limit(CANDIDATE_POOL)
    # Strong matches rank first, so those within the pool are the best nine strong ones.
    strong = F.col("score") >= STRONG_MATCH
    everyone = W.partitionBy()
    enough = F.count_if(strong).over(everyone) >= STRONG_MINIMUM
    return pool.withColumn("_keep", strong | ~enough).filter("_keep").drop("_keep")


def mood_candidates(tracks: DataFrame, mood: str, taken: DataFrame | None = None, seed: int = 0) -> DataFrame:
    return sample_by_seed(first_candidates(tracks, mood, taken), CANDIDATE_SAMPLE, seed)


def candidates_by_mood(tracks: DataFrame, moods: list[str], seed: int = 0) -> DataFrame:
    """(mood, track_id, score): ``mood_candidates`` of several moods from one pass over the tracks.

    Scores are exploded and ranked per mood; the rank filter leaves nine rows per mood and task before the shuffle."""
    scored = tracks.select("track_id", "track_name", F.explode(F.array(*[
        F.struct(F.lit(m).alias("mood"), mood_score(m).alias("score")) for m in moods])).alias("s")).select("track_id", "track_name", "s.*")
    mood = W.partitionBy("mood")
    ranked = scored.withColumn("_rank", F.row_number().over(mood.orderBy(F.desc("score"), F.asc_nulls_first("track_name"), "track_id")))
    pool = ranked.filter(F.col("_rank") <= CANDIDATE_POOL)
    strong = F.col("score") >= STRONG_MATCH
    kept = pool.withColumn("_keep", strong | (F.count_if(strong).over(mood) < STRONG_MINIMUM)).filter("_keep")
    drawn = kept.withColumn("_draw", F.row_number().over(mood.orderBy(F.md5(F.concat("track_id", F.lit(f":{seed}"))), "track_id")))
    return drawn.filter(F.col("_draw") <= CANDIDATE_SAMPLE).select("mood", "track_id", "score")


def followup_pool(index: DataFrame, mood: str, previous: str, taken: DataFrame | None = None) -> DataFrame:
    """The nine best tracks by likeness to the previous pick and mood together; empty if that pick is unknown."""
    pick = index.filter(F.col("track_id") == previous).select("vector").head()
    if pick is None:
        return index.withColumn("score", F.lit(0.0)).limit(0)
    score = F.lit(COSINE_WEIGHT) * dot_literal(F.col("vector"), pick["vector"]) + F.lit(MOOD_WEIGHT) * mood_score(mood)
    rest = index.filter(F.col("track_id") != previous).withColumn("score", score)
    if taken is not None:
        rest = rest.join(taken.select("track_id"), "track_id", "left_anti")
    return rest.orderBy(F.desc("score"), F.asc_nulls_first("track_name"), "track_id").limit(CANDIDATE_POOL)


def followup_candidates(index: DataFrame, mood: str, previous: str, taken: DataFrame | None = None,
                        seed: int = 0) -> DataFrame:
    return sample_by_seed(followup_pool(index, mood, previous, taken), CANDIDATE_SAMPLE, seed)


def seed_average(seeds: DataFrame) -> DataFrame:
    """Mean of each numeric feature over the seeds; an absent value counts as 0."""
    return seeds.agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in NUMERIC_FEATURES])


def playlist_continuation(index: DataFrame, stats: VectorStats, seeds: DataFrame,
                          length: int = PLAYLIST_DEFAULT) -> DataFrame:
    """Seeds first, then the tracks nearest to their average, cut to the wanted length.

    Key, mode and camelot are not part of the average: the query takes the index defaults for them.
    ``seeds`` holds ``seed_no`` and the track columns of the index."""
    length = clamp_length(length)
    averages = seed_average(seeds).first()
    if averages[NUMERIC_FEATURES[0]] is None:
        raise ValueError("No seed tracks provided.")
    chosen = seeds.orderBy("seed_no").limit(length)
    head = chosen.select("track_id", "track_name", "artist_names", F.lit(None).cast("double").alias("score"),
                         F.row_number().over(W.orderBy("seed_no")).alias("rank"))
    vector = query_vector(index.sparkSession, averages.asDict(), stats)
    tail = nearest(index, vector, length, exclude=seeds.select("track_id"))
    taken = head.agg(F.count("*").alias("n")).scalar()
    tail = tail.select("track_id", "track_name", "artist_names", "score", (F.col("rank") + taken).cast("int").alias("rank"))
    return head.unionByName(tail).filter(F.col("rank") <= length)
