"""The import run: landed pages to stored tables, then the refresh list and the scraped features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.constants import MODEL_FEATURES
from tracklake.operators import views
from tracklake.operators.flatten import (flatten_played, flatten_playlist_items, flatten_playlists,
                                         normalise_features)
from tracklake.operators.ingest import append_new, fill_stored, ingest
from tracklake.operators.scrape import feature_pairs, feature_rows
from tracklake.schemas import table_schema
from tracklake.session import settle
from tracklake.sources.library import ParquetLibrary
from tracklake.sources.pages import read_pages


def import_pages(spark: SparkSession, landed: str, tables: str, user_id: str) -> dict[str, DataFrame]:
    """Plays, the user's playlists and the items of playlists not stored yet; returns rejected rows per table."""
    rejected = {f"played.{k}": v for k, v in
                ingest(spark, tables, flatten_played(read_pages(spark, f"{landed}/played", "played"), settled=True)).items()}
    mine = flatten_playlists(read_pages(spark, f"{landed}/playlists", "playlists"), user_id)
    stored = ParquetLibrary(spark, tables)
    seen = views.playlists_seen(mine.select("playlist_id"), stored.playlist_tracks)
    todo = settle(views.playlists_todo(mine.select("playlist_id").distinct(), seen))
    rejected["playlists"] = append_new(spark, tables, "playlists", mine)
    items = read_pages(spark, f"{landed}/playlist_items", "playlist_items").join(todo, "playlist_id", "left_semi")
    rejected.update({f"items.{k}": v for k, v in ingest(spark, tables, flatten_playlist_items(items, settled=True)).items()})
    return rejected


def refresh_features(spark: SparkSession, feature_pages: DataFrame, tables: str, on_conflict: str = "keep",
                     offset: int = 0, limit: int | None = None) -> None:
    """Read the features of tracks on the refresh list from landed pages (track_id, html).

    ``keep`` leaves stored rows as they are; ``fill_nulls`` lets a new page complete a stored row."""
    stored = ParquetLibrary(spark, tables)
    todo = views.refresh_slice(views.refresh_list(stored.tracks, stored.track_features), offset, limit)
    pages = feature_pages.join(todo.select(F.col("id").alias("track_id")), "track_id", "left_semi")
    raw = feature_rows(feature_pairs(pages, "track_id"), "track_id", MODEL_FEATURES)
    typed = normalise_features(raw).select(*[
        F.col(f.name).try_cast(f.dataType).alias(f.name) for f in table_schema("track_features")])
    rows = typed.withColumns({"page_no": F.lit(0), "item_pos": F.lit(0), "source_rank": F.lit(0), "pos": F.lit(0)})
    if on_conflict == "keep":
        append_new(spark, tables, "track_features", rows, reject_nulls=False)
    elif on_conflict == "fill_nulls":
        fill_stored(spark, tables, "track_features", rows)
    else:
        raise ValueError(f"unknown on_conflict {on_conflict}")
