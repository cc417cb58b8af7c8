"""Nested pages to relational rows.

Each page is exploded once; every output is a projection of that one frame. Order columns
(``page_no``, ``item_pos``, ``source_rank``, ``pos``) travel with the rows for the first-writer rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions.music import clean_key
from tracklake.session import settle

ORDER = ["page_no", "item_pos", "source_rank", "pos"]
TRACK_RANK, ALBUM_RANK = 0, 1


def _entries(pages: DataFrame, kept: list, entry: str) -> DataFrame:
    """The entries of pages with their place on the page; pages without entries give none.

    For a plain explode Spark tests the array for being empty below it, which for pages held as text parses each of them three times."""
    return pages.select(*kept, F.posexplode_outer("items").alias("item_pos", entry)).filter(F.col("item_pos").isNotNull())


def _order(rank: int, pos: Column | None = None) -> list[Column]:
    return [F.col("page_no"), F.col("item_pos"), F.lit(rank).alias("source_rank"),
            (F.lit(0) if pos is None else pos).alias("pos")]


def track_rows(items: DataFrame) -> DataFrame:
    t = F.col("track")
    return items.select(
        t.id.alias("id"), t["name"].alias("name"), t.album.id.alias("album_id"), t.disc_number.alias("disc_number"),
        t.duration_ms.alias("duration_ms"), t.explicit.alias("explicit"), t.track_number.alias("track_number"),
        t.external_urls.spotify.alias("track_url"), *_order(TRACK_RANK))


def album_rows(items: DataFrame) -> DataFrame:
    a = F.col("track.album")
    return items.select(
        a.id.alias("id"), a["name"].alias("name"), a.album_type.alias("album_type"),
        a.release_date.alias("release_date"), a.total_tracks.alias("total_tracks"),
        F.get(a.images, 0).url.alias("image_url"), a.external_urls.spotify.alias("album_url"), *_order(ALBUM_RANK))


def credit_rows(items: DataFrame) -> DataFrame:
    """Artists credited on the tracks and on the albums of exploded items, both sides from one pass over them."""
    def side(name: str, rank: int, owner: str, path: str) -> Column:
        listed = F.transform(F.col(path), lambda artist, pos: F.struct(
            F.lit(name).alias("side"), F.lit(rank).alias("source_rank"), F.col(owner).alias("owner_id"), pos.alias("pos"), artist.alias("artist")))
        return F.coalesce(listed, F.array().cast(items.select(listed).schema[0].dataType))

    both = F.concat(side("track", TRACK_RANK, "track.id", "track.artists"), side("album", ALBUM_RANK, "track.album.id", "track.album.artists"))
    return items.select("page_no", "item_pos", F.explode_outer(both).alias("c")).filter(F.col("c").isNotNull()).select("page_no", "item_pos", "c.*")


def artist_rows(credits: DataFrame) -> DataFrame:
    return credits.select(F.col("artist.id").alias("id"), F.col("artist.name").alias("name"),
                          F.col("artist.external_urls.spotify").alias("artist_url"), *ORDER)


def bridge_rows(credits: DataFrame) -> DataFrame:
    """The bridges of both sides (``side``: track or album) in one table."""
    return credits.select("side", "owner_id", F.col("artist.id").alias("artist_id"), F.col("pos").alias("artist_order"), *ORDER)


def _one_bridge(items: DataFrame, side: str, path: str, owner: Column, rank: int) -> DataFrame:
    listed = items.select("page_no", "item_pos", owner.alias(f"{side}_id"), F.posexplode(path).alias("apos", "artist"))
    return listed.select(f"{side}_id", F.col("artist.id").alias("artist_id"), F.col("apos").alias("artist_order"), *_order(rank, F.col("apos")))


def relational(items: DataFrame) -> dict[str, DataFrame]:
    """Tracks, albums, artists and both ordered bridges from exploded items (page_no, item_pos, track)."""
    return {
        "tracks": track_rows(items),
        "albums": album_rows(items),
        "artists": artist_rows(credit_rows(items)),
        "track_artists": _one_bridge(items, "track", "track.artists", F.col("track.id"), TRACK_RANK),
        "album_artists": _one_bridge(items, "album", "track.album.artists", F.col("track.album.id"), ALBUM_RANK),
    }


def played_items(pages: DataFrame) -> DataFrame:
    return (_entries(pages, ["page_no"], "item")
            .select("page_no", "item_pos", "item.played_at", "item.track"))


def event_rows(items: DataFrame) -> DataFrame:
    return items.select(F.col("track.id").alias("track_id"), F.try_to_timestamp("played_at").alias("played_at"),
                        *_order(TRACK_RANK))


def flatten_played(pages: DataFrame, settled: bool = False) -> dict[str, DataFrame]:
    """Recently-played pages to tracks, albums, artists, bridges and play events.

    ``settled`` parses the pages once into a nested table that all outputs then read, each its own fields."""
    items = settle(played_items(pages)) if settled else played_items(pages)
    return {**relational(items), "track_events": event_rows(items)}


def played_bridges(pages: DataFrame) -> DataFrame:
    """The rows of both bridges of ``flatten_played`` in one table, from one pass over the pages."""
    return bridge_rows(credit_rows(played_items(pages)))


def playlist_items(pages: DataFrame) -> DataFrame:
    """Playable items of playlist pages; positions count skipped items, so these leave gaps."""
    placed = _entries(pages, ["page_no", "playlist_id", "offset"], "entry")
    track = F.col("entry.item")
    return (placed.filter(track.isNotNull() & F.coalesce(track.is_playable, F.lit(False))
                          & F.coalesce(track.track, F.lit(False)))
            .select("page_no", "item_pos", "playlist_id", (F.col("offset") + F.col("item_pos")).alias("playlist_order"),
                    track.alias("track")))


def playlist_track_rows(items: DataFrame) -> DataFrame:
    return items.select("playlist_id", "playlist_order", F.col("track.id").alias("track_id"), *_order(TRACK_RANK))


def flatten_playlist_items(pages: DataFrame, settled: bool = False) -> dict[str, DataFrame]:
    """Playlist-item pages to tracks, albums, artists, bridges and playlist positions."""
    items = settle(playlist_items(pages)) if settled else playlist_items(pages)
    return {**relational(items), "playlist_tracks": playlist_track_rows(items)}


def flatten_playlists(pages: DataFrame, user_id: str) -> DataFrame:
    """Playlists owned by the user; those of others are left out."""
    p = F.col("playlist")
    return (_entries(pages, ["page_no"], "playlist")
            .filter(p.owner.id == F.lit(user_id))
            .select(p.id.alias("playlist_id"), p["name"].alias("name"), p["items"].total.alias("tracks"),
                    p.external_urls.spotify.alias("playlist_url"), F.get(p.images, 0).url.alias("image_url"),
                    *_order(TRACK_RANK)))


def track_queries(tracks: DataFrame) -> DataFrame:
    """Search text of a track: its name and its first artist."""
    return tracks.select(F.col("id").alias("track_id"), F.col("external_ids.isrc").alias("isrc"),
                         F.concat(F.col("name"), F.lit(" - "), F.get("artists", F.lit(0))["name"]).alias("query"))


def normalise_features(raw: DataFrame) -> DataFrame:
    """Lower-case column names and mode; write accidentals as b and #."""
    df = raw.withColumnsRenamed({c: c.lower() for c in raw.columns})
    changes = {}
    if "key" in df.columns:
        changes["key"] = clean_key(F.col("key"))
    if "mode" in df.columns:
        changes["mode"] = F.lower("mode")
    return df.withColumns(changes)
