"""Joined views over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracklake.constants import MODEL_FEATURES, REFRESH_FEATURES
from tracklake.operators.skew import delivered_index, global_index, running_sum


def _credits(bridge: DataFrame, artists: DataFrame, owner: str, prefix: str) -> DataFrame:
    """Bridge rows with the artist's columns, named after the side they describe."""
    a = artists.select(F.col("id").alias("artist_id"), F.col("id").alias(f"{prefix}_artist_id"),
                       F.col("name").alias(f"{prefix}_artist_name"), F.col("artist_url").alias(f"{prefix}_artist_url"))
    return (bridge.withColumnRenamed("artist_order", f"{prefix}_artist_order")
            .join(a, "artist_id", "left").drop("artist_id"))


# The columns of the play history, in order.
PLAY_HISTORY = [
    "played_at", "track_id", "track_name", "disc_number", "duration_ms", "explicit", "track_number", "track_url",
    "album_id", "album_name", "album_type", "release_date", "total_tracks", "image_url", "album_url",
    "track_artist_order", "track_artist_id", "track_artist_name", "track_artist_url",
    "album_artist_order", "album_artist_id", "album_artist_name", "album_artist_url",
]


def _album_side(albums: DataFrame, album_artists: DataFrame, artists: DataFrame) -> DataFrame:
    """Albums with their artists, one row per artist, one for an album without."""
    return (albums.select(F.col("id").alias("album_id"), F.col("name").alias("album_name"), "album_type",
                          "release_date", "total_tracks", "image_url", "album_url")
            .join(_credits(album_artists, artists, "album_id", "album"), "album_id", "left"))


def _track_side(tracks: DataFrame) -> DataFrame:
    # A track may name an album that is not stored: its album columns, id included, are then null.
    return tracks.select(F.col("id").alias("track_id"), F.col("name").alias("track_name"),
                         F.col("album_id").alias("_album"), "disc_number", "duration_ms", "explicit",
                         "track_number", "track_url")


def _by_place(credits: DataFrame) -> DataFrame:
    """Per track its artists as an array in order, ``track_list``. An entry holds the artists of one place and the number of those before them (``before``)."""
    who = [c for c in credits.columns if c not in ("track_id", "track_artist_order")]
    places = credits.groupBy("track_id", "track_artist_order").agg(F.collect_list(F.struct(*who)).alias("who"))
    before = F.sum(F.size("who")).over(W.partitionBy("track_id").orderBy(F.asc_nulls_first("track_artist_order"))) - F.size("who")
    entry = F.struct("track_artist_order", before.alias("before"), "who")
    return (places.select("track_id", entry.alias("entry")).groupBy("track_id")
            .agg(F.sort_array(F.collect_list("entry")).alias("track_list"), F.sum(F.size("entry.who")).alias("track_rows")))


def _distinct_plays(events: DataFrame) -> DataFrame:
    return events.groupBy("played_at", "track_id").agg(F.count("*").alias("_times"))


def _who(rows: DataFrame) -> DataFrame:
    """The artists of a place as ``_who``, repeated for a play that is stored ``_times``; one unknown artist for a track without."""
    who = F.coalesce("_place.who", F.array(F.lit(None).cast(rows.schema["_place"].dataType["who"].dataType.elementType)))
    return rows.withColumn("_who", F.when(F.col("_times") == 1, who).otherwise(F.flatten(F.array_repeat(who, F.col("_times").cast("int")))))


def _by_album(album_side: DataFrame) -> DataFrame:
    """Per album its rows as an array in the order of its artists, ``album_list``."""
    rest = [c for c in album_side.columns if c != "album_artist_order"]
    return (album_side.groupBy(F.col("album_id").alias("_album"))
            .agg(F.sort_array(F.collect_list(F.struct("album_artist_order", *rest))).alias("album_list"), F.count("*").alias("album_rows")))


LISTED_ROWS = 200_000  # (album, artist) rows that are kept in memory beside the sorted plays


def _short_lists(tracks: DataFrame, album_side: DataFrame, limit: int) -> bool:
    """Whether plays can be sorted before their artists are listed: no track is stored twice and the album lists fit into memory."""
    twice = tracks.filter(F.col("id").isNotNull()).groupBy("id").count().filter("count > 1").limit(1)
    return not twice.count() and album_side.limit(limit + 1).count() <= limit


def _one_each(track_side: DataFrame, albums: DataFrame) -> bool:
    """Whether no place of a track holds two artists and no album is stored twice."""
    shared = track_side.groupBy("track_id", "track_artist_order").count().filter("count > 1").limit(1)
    twice = albums.filter(F.col("id").isNotNull()).groupBy("id").count().filter("count > 1").limit(1)
    return not shared.count() and not twice.count()


def _album_cards(album_side: DataFrame) -> DataFrame:
    """Per album, each stored once, its columns and its artists as an array in order, ``owners``."""
    artist = ["album_artist_order", "album_artist_id", "album_artist_name", "album_artist_url"]
    return (album_side.groupBy(F.col("album_id").alias("_album"))
            .agg(F.sort_array(F.collect_list(F.struct(*artist))).alias("owners"), *[F.first(c).alias(c) for c in album_side.columns if c not in artist]))


def play_history(events: DataFrame, tracks: DataFrame, albums: DataFrame, track_artists: DataFrame,
                 album_artists: DataFrame, artists: DataFrame, ordered: bool = True, listed_rows: int = LISTED_ROWS) -> DataFrame:
    """Events with track, album and both artist lists, most recent first.

    A play has a row for every pair of a track artist and an album artist, so the result grows with the length of both lists. Only the
    plays are moved and sorted: a track's artists are a sorted list in its play, an album's are looked up after the sort, and the pairs
    are listed where the play lies. Where album lists are too large to look up, or a track is stored twice, the pairs themselves are sorted.
    Where every place has one artist and every album one row, a row differs from the next in the album's artist alone: the list of a place holds nothing else."""
    album_side = _album_side(albums, album_artists, artists)
    if not ordered or not _short_lists(tracks, album_side, listed_rows):
        cards = _track_side(tracks).join(album_side, F.col("_album") == F.col("album_id"), "left").drop("_album")
        cards = cards.join(_credits(track_artists, artists, "track_id", "track"), "track_id", "left")
        history = events.join(cards, "track_id").select(*PLAY_HISTORY)
        return history.orderBy(F.desc("played_at"), "track_id", "track_artist_order", "album_artist_order") if ordered else history
    track_side = _credits(track_artists, artists, "track_id", "track")
    cards = _track_side(tracks).join(_by_place(track_side).drop("track_rows"), "track_id", "left")
    # Spark drops a sort below a join unless something depends on where the rows lie. The broadcast join and the lists keep the order.
    plays = (_distinct_plays(events).join(cards, "track_id").orderBy(F.desc("played_at"), "track_id")
             .withColumn("_at", F.monotonically_increasing_id()).filter("_at >= 0").drop("_at"))
    placed = plays.select("*", F.explode_outer("track_list").alias("_place")).drop("track_list")
    if _one_each(track_side, albums):
        placed = placed.select("*", "_place.track_artist_order", F.inline_outer("_place.who")).drop("_place")
        pairs = placed.join(F.broadcast(_album_cards(album_side)), "_album", "left")
        unknown = F.array(F.lit(None).cast(pairs.schema["owners"].dataType.elementType))
        repeated = F.sort_array(F.flatten(F.array_repeat(F.coalesce("owners", unknown), F.col("_times").cast("int"))))
        owners = F.when(F.col("_times") == 1, F.col("owners")).otherwise(repeated)
        return pairs.select("*", F.inline_outer(owners)).select(*PLAY_HISTORY)
    placed = _who(placed)
    pairs = (placed.join(F.broadcast(_by_album(album_side).drop("album_rows")), "_album", "left")
             .select("*", F.inline_outer("album_list")).drop("_album", "album_list"))
    # Artists of one place come last, so that they share the order of the album's artists.
    return pairs.select("*", "_place.track_artist_order", F.inline("_who")).select(*PLAY_HISTORY)


def play_history_positions(events: DataFrame, tracks: DataFrame, albums: DataFrame, track_artists: DataFrame,
                           album_artists: DataFrame, artists: DataFrame, listed_rows: int = LISTED_ROWS) -> DataFrame:
    """The place (``position``, from 0) at which the play history delivers each of its rows.

    Plays are numbered with the rows they have; a row's place in its play follows from the places in both lists. No row of the history is stored."""
    columns = ["played_at", "track_id", "track_artist_id", "album_artist_id"]
    album_side = _album_side(albums, album_artists, artists)
    if not _short_lists(tracks, album_side, listed_rows):
        return delivered_index(play_history(events, tracks, albums, track_artists, album_artists, artists).select(*columns), "position")
    track_lists = _by_place(_credits(track_artists, artists, "track_id", "track").select("track_id", "track_artist_order", "track_artist_id"))
    album_lists = F.broadcast(_by_album(album_side.select("album_id", "album_artist_order", "album_artist_id")))
    one = F.lit(1).cast("bigint")
    cards = (_track_side(tracks).select("track_id", "_album").join(track_lists, "track_id", "left").join(album_lists.drop("album_list"), "_album", "left")
             .withColumns({"track_rows": F.coalesce("track_rows", one), "album_rows": F.coalesce("album_rows", one)}))
    sizes = cards.select("track_id", (F.col("track_rows") * F.col("album_rows")).alias("_rows"))
    counted = _distinct_plays(events).join(sizes, "track_id").withColumn("_rows", F.col("_rows") * F.col("_times"))
    plays = running_sum(counted, [F.desc("played_at"), F.asc("track_id")], "_rows", "_start").drop("_rows")
    placed = _who(plays.join(cards, "track_id").select("*", F.explode_outer("track_list").alias("_place")).drop("track_list"))
    pairs = (placed.join(album_lists.drop("album_rows"), "_album", "left")
             .select("*", F.posexplode_outer("album_list").alias("_second", "_owner")).drop("album_list"))
    rows = pairs.select("*", F.posexplode("_who").alias("_first", "_artist"))
    place = (F.col("_start") + F.coalesce("_place.before", F.lit(0)) * F.col("_times") * F.col("album_rows")
             + F.size("_who") * F.coalesce("_second", F.lit(0)) + F.col("_first"))
    return rows.select("played_at", "track_id", F.col("_artist.track_artist_id").alias("track_artist_id"),
                       F.col("_owner.album_artist_id").alias("album_artist_id"), place.alias("position"))


def artist_names(track_artists: DataFrame, artists: DataFrame) -> DataFrame:
    """Comma-joined artist names per track, in artist order; null when none is known."""
    named = track_artists.join(artists.select(F.col("id").alias("artist_id"), "name"), "artist_id", "left")
    return named.groupBy("track_id").agg(F.expr(
        "listagg(name, ', ') within group (order by artist_order, artist_id)").alias("artist_names"))


def first_per_track(df: DataFrame, order: list) -> DataFrame:
    """First row per track_id in ``order``."""
    w = W.partitionBy("track_id").orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def track_feature_view(features: DataFrame, tracks: DataFrame, albums: DataFrame, track_artists: DataFrame,
                       artists: DataFrame) -> DataFrame:
    """One row per feature row with track, album and artist names.

    Artist names are grouped before the join; the wide group-by the fan-out would need falls away."""
    t = tracks.select(F.col("id").alias("track_id"), F.col("name").alias("track_name"), "album_id")
    al = albums.select(F.col("id").alias("album_id"), F.col("name").alias("album_name"),
                       F.col("image_url").alias("album_image_url"))
    return (features.join(t, "track_id", "left").join(artist_names(track_artists, artists), "track_id", "left")
            .join(al, "album_id", "left")
            .select("track_id", "track_name", "album_name", "album_image_url", "artist_names", *MODEL_FEATURES))


def count_features(view: DataFrame) -> DataFrame:
    available = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in MODEL_FEATURES])
    return (view.withColumn("available_feature_count", available)
            .withColumn("missing_feature_count", F.lit(len(MODEL_FEATURES)) - F.col("available_feature_count")))


def complete_tracks(view: DataFrame) -> DataFrame:
    """Rows with all thirteen features, with their counts."""
    return count_features(view).filter(F.col("missing_feature_count") == 0)


def in_library_order(view: DataFrame) -> DataFrame:
    return view.orderBy(F.asc_nulls_first("track_name"), "track_id")


def tracks_without_features(tracks: DataFrame, features: DataFrame) -> DataFrame:
    return tracks.join(features.select(F.col("track_id").alias("id")), "id", "left_anti").select("id")


def incomplete_features(features: DataFrame, tracks: DataFrame) -> DataFrame:
    """Stored tracks whose feature row lacks any refreshable value; orphan feature rows are dropped."""
    gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in REFRESH_FEATURES])
    return (features.filter(gap).select(F.col("track_id").alias("id"))
            .join(tracks.select("id"), "id", "left_semi"))


def refresh_list(tracks: DataFrame, features: DataFrame) -> DataFrame:
    return tracks_without_features(tracks, features).union(incomplete_features(features, tracks)).distinct()


def refresh_slice(ids: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A stable slice of the refresh list. Without a limit the rows are numbered where they lie, as an offset alone would
    take all of them through one task."""
    if limit is not None:
        return ids.orderBy("id").offset(offset).limit(limit)
    return ids.orderBy("id") if not offset else global_index(ids, ["id"]).filter(F.col("pos") >= offset).drop("pos").orderBy("id")


def playlists_seen(playlists: DataFrame, playlist_tracks: DataFrame) -> DataFrame:
    """Playlists with stored items. Their ids are reduced before the join: a huge playlist counts as one row."""
    placed = playlist_tracks.filter(F.col("playlist_order").isNotNull()).select("playlist_id").distinct()
    return playlists.select("playlist_id").join(placed, "playlist_id", "left_semi").distinct()


def playlists_todo(playlists: DataFrame, seen: DataFrame) -> DataFrame:
    return playlists.join(seen.select("playlist_id"), "playlist_id", "left_anti")
