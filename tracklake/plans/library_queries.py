"""Registered queries: views, set operations, page flattening, ingestion, files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.constants import MODEL_FEATURES
from tracklake.operators import flatten, ingest, selection, views
from tracklake.operators.skew import delivered_index
from tracklake.plans import importing
from tracklake.plans.registry import query, shared
from tracklake.session import scratch_path
from tracklake.sources import csv_files, labels, pages
from tracklake.sources.library import ParquetLibrary, StarLibrary, spread
from tracklake.streaming.plays import ingest_keyed_stream, ingest_played_stream

FEATURES_SQL = ", ".join(f"f.{c}" for c in MODEL_FEATURES)

shared("feature_view", f"""
    SELECT f.track_id, t.name AS track_name, al.name AS album_name, al.image_url AS album_image_url,
           n.artist_names, {FEATURES_SQL}
    FROM track_features f
    LEFT JOIN tracks t ON t.id = f.track_id
    LEFT JOIN albums al ON al.id = t.album_id
    LEFT JOIN (SELECT ta.track_id, string_agg(ar.name, ', ' ORDER BY ta.artist_order, ta.artist_id) AS artist_names
               FROM track_artists ta LEFT JOIN artists ar ON ar.id = ta.artist_id GROUP BY ta.track_id) n
      ON n.track_id = f.track_id""")
_AVAILABLE = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in MODEL_FEATURES)


def feature_view(lib: StarLibrary) -> DataFrame:
    return views.track_feature_view(lib.track_features, lib.tracks, lib.albums, lib.track_artists, lib.artists)


# ---------------------------------------------------------------- views

# Written from the star schema itself, so that it shares nothing with the derived tables of the engine.
_HISTORY = """
    WITH brand AS (SELECT p_brand AS b, min(p_type) AS kind, CAST(count(*) AS INT) AS pieces FROM part GROUP BY p_brand),
    played AS (SELECT l_partkey AS p, l_shipdate AS played_at FROM lineitem GROUP BY ALL),
    credit AS (SELECT l_partkey AS p, list_distinct(list(l_suppkey)) AS who FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY ALL),
    house AS (SELECT concat('Brand#', s_nationkey + 1) AS b, list(s_suppkey) AS who FROM supplier WHERE s_acctbal < 0 GROUP BY ALL),
    card AS (SELECT p_partkey AS p, p_name, p_size, p_brand, kind, pieces, unnest(coalesce(credit.who, [NULL])) AS performer, house.who AS owners
             FROM part JOIN brand ON b = p_brand LEFT JOIN credit ON credit.p = p_partkey LEFT JOIN house ON house.b = p_brand),
    pair AS (SELECT * EXCLUDE (owners), unnest(coalesce(owners, [NULL])) AS owner FROM card)
    SELECT played_at, concat('t', p) AS track_id, p_name AS track_name, 1 AS disc_number, 10000 * p_size AS duration_ms, mod(p, 7) = 0 AS explicit,
           CAST(mod(p, 20) + 1 AS INT) AS track_number, concat('urn:t:', p) AS track_url, p_brand AS album_id, p_brand AS album_name,
           kind AS album_type, '2000' AS release_date, pieces AS total_tracks, concat('urn:img:', p_brand) AS image_url,
           concat('urn:al:', p_brand) AS album_url, CAST(performer AS INT) AS track_artist_order, 'ar' || performer AS track_artist_id,
           one.s_name AS track_artist_name, 'urn:ar:' || performer AS track_artist_url, CAST(owner AS INT) AS album_artist_order,
           'ar' || owner AS album_artist_id, two.s_name AS album_artist_name, 'urn:ar:' || owner AS album_artist_url
    FROM played JOIN pair USING (p) LEFT JOIN supplier one ON one.s_suppkey = performer LEFT JOIN supplier two ON two.s_suppkey = owner"""


@query(_HISTORY)
def play_history(lib):
    return views.play_history(lib.track_events, lib.tracks, lib.albums, lib.track_artists, lib.album_artists, lib.artists)


@query(f"""SELECT row_number() OVER (ORDER BY played_at DESC, track_id, track_artist_order NULLS FIRST, album_artist_order NULLS FIRST) - 1 AS position,
                  played_at, track_id, track_artist_id, album_artist_id FROM ({_HISTORY}) h""")
def play_history_order(lib):
    """The place at which the play history delivers each of its rows."""
    return views.play_history_positions(lib.track_events, lib.tracks, lib.albums, lib.track_artists, lib.album_artists, lib.artists)


@query(f"""
    SELECT *, CAST({_AVAILABLE} AS INT) AS available_feature_count,
           CAST(13 - ({_AVAILABLE}) AS INT) AS missing_feature_count
    FROM feature_view""")
def track_feature_view(lib):
    return views.in_library_order(views.count_features(feature_view(lib)))


@query("SELECT row_number() OVER (ORDER BY track_name NULLS FIRST, track_id) - 1 AS position, track_id, track_name FROM feature_view")
def track_feature_view_order(lib):
    """The place at which the view delivers each track."""
    return delivered_index(track_feature_view(lib).select("track_id", "track_name"), "position")


@query(f"""
    SELECT *, 13 AS available_feature_count, 0 AS missing_feature_count
    FROM feature_view WHERE {' AND '.join(f'{c} IS NOT NULL' for c in MODEL_FEATURES)}""")
def complete_tracks(lib):
    return views.in_library_order(views.complete_tracks(feature_view(lib)))


@query("""SELECT ta.track_id, string_agg(ar.name, ', ' ORDER BY ta.artist_order, ta.artist_id) AS artist_names
          FROM track_artists ta LEFT JOIN artists ar ON ar.id = ta.artist_id GROUP BY ta.track_id""")
def artist_names(lib):
    return views.artist_names(lib.track_artists, lib.artists)


@query("""SELECT track_id, played_at FROM (
            SELECT track_id, played_at, row_number() OVER (PARTITION BY track_id ORDER BY played_at DESC) AS rn
            FROM track_events) r WHERE rn = 1""")
def first_row_per_track(lib):
    return views.first_per_track(lib.track_events, [F.desc("played_at")])


@query("SELECT t.id FROM tracks t LEFT JOIN track_features f ON t.id = f.track_id WHERE f.track_id IS NULL")
def tracks_missing_features(lib):
    return views.tracks_without_features(lib.tracks, lib.track_features)


# From the star schema: parts that are too large, not ordered at all, or whose valence is left out.
_REFRESH = """
    SELECT concat('t', p_partkey) AS id FROM part
    WHERE p_size >= 48 OR mod(p_partkey, 11) = 0 OR p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)"""


@query(_REFRESH)
def refresh_list(lib):
    return views.refresh_list(lib.tracks, lib.track_features)


@query(f"SELECT id FROM ({_REFRESH}) r ORDER BY id LIMIT 50 OFFSET 20")
def refresh_slice(lib):
    return views.refresh_slice(views.refresh_list(lib.tracks, lib.track_features), 20, 50)


@query("SELECT DISTINCT p.playlist_id FROM playlists p JOIN playlist_lines l ON p.playlist_id = l.playlist_id "
       "WHERE l.playlist_order IS NOT NULL")
def playlists_seen(lib):
    return views.playlists_seen(lib.playlists, lib.playlist_lines)


@query("SELECT p.* FROM playlists p LEFT JOIN playlist_lines l ON p.playlist_id = l.playlist_id WHERE l.playlist_id IS NULL")
def playlists_todo(lib):
    return views.playlists_todo(lib.playlists, views.playlists_seen(lib.playlists, lib.playlist_lines))


# ---------------------------------------------------------------- pages

def _url(prefix: str, key) -> F.Column:
    return F.struct(F.concat(F.lit(prefix), key).alias("spotify"))


def _lines(lib: StarLibrary) -> DataFrame:
    """Order lines with their part and supplier."""
    return (spread(lib.lineitem).join(lib.part, F.col("l_partkey") == F.col("p_partkey"))
            .join(lib.supplier, F.col("l_suppkey") == F.col("s_suppkey")))


def _nested_track(col, name: F.Column, number: F.Column, playable: F.Column) -> F.Column:
    """A line's nested track: the part, its brand as album, supplier and brand as artists. ``col`` gives the line's columns."""
    brand = F.struct(col("p_brand").alias("id"), col("p_brand").alias("name"), _url("urn:ar:", col("p_brand")).alias("external_urls"))
    maker = F.struct(F.concat(F.lit("ar"), col("s_suppkey").cast("string")).alias("id"), col("s_name").alias("name"),
                     _url("urn:ar:", col("s_suppkey").cast("string")).alias("external_urls"))
    album = F.struct(
        col("p_brand").alias("id"), col("p_brand").alias("name"), col("p_type").alias("album_type"),
        F.lit("2000").alias("release_date"), col("p_size").alias("total_tracks"),
        F.when(col("p_size") > 2, F.array(F.struct(F.concat(F.lit("urn:img:"), col("p_brand")).alias("url"))))
        .otherwise(F.expr("array()").cast("array<struct<url:string>>")).alias("images"),
        _url("urn:al:", col("p_brand")).alias("external_urls"), F.array(brand).alias("artists"))
    return F.struct(
        F.concat(F.lit("t"), col("p_partkey").cast("string")).alias("id"), name.alias("name"),
        F.lit(1).alias("disc_number"), (col("p_size") * 10000).alias("duration_ms"),
        (col("p_partkey") % 7 == 0).alias("explicit"), number.alias("track_number"),
        _url("urn:t:", col("p_partkey").cast("string")).alias("external_urls"),
        playable.alias("is_playable"), F.lit(True).alias("track"), album.alias("album"),
        F.array(maker, brand).alias("artists"))


def _line_tracks(lib: StarLibrary) -> DataFrame:
    """One nested track per order line."""
    def track(playable) -> F.Column:
        return _nested_track(F.col, F.col("p_name"), F.col("l_linenumber"), playable)

    return _lines(lib).withColumns({"good": track(F.lit(True)), "maybe": track(F.col("l_returnflag") != "R")})


def _played_pages(lib: StarLibrary) -> DataFrame:
    item = F.struct(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("played_at"), F.col("good").alias("track"))
    raw = _line_tracks(lib).select("l_orderkey", F.to_json(F.struct(F.array(item).alias("items"))).alias("body"))
    return pages.parse_pages(raw, "body", "played", F.col("l_orderkey"))


def _item_pages(lib: StarLibrary) -> DataFrame:
    """Pages of three entries: an empty one, a playable one, and one that is playable unless returned."""
    empty = F.struct(F.lit(None).cast(_line_tracks(lib).schema["good"].dataType).alias("item"))
    body = F.struct(
        F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("playlist_id"),
        (F.col("l_linenumber") * 3).alias("offset"), F.lit(100).alias("total"),
        F.array(empty, F.struct(F.col("good").alias("item")), F.struct(F.col("maybe").alias("item"))).alias("items"))
    raw = _line_tracks(lib).select("l_orderkey", F.to_json(body).alias("body"))
    return pages.parse_pages(raw, "body", "playlist_items", F.col("l_orderkey"))


def _drop_order(df: DataFrame) -> DataFrame:
    return df.drop(*flatten.ORDER)


@query("""SELECT concat('p', CAST(l_orderkey AS STRING)) AS playlist_id, CAST(l_linenumber * 3 + 1 AS INT) AS playlist_order,
                 concat('t', CAST(l_partkey AS STRING)) AS track_id
          FROM lineitem
          UNION ALL
          SELECT concat('p', CAST(l_orderkey AS STRING)), CAST(l_linenumber * 3 + 2 AS INT), concat('t', CAST(l_partkey AS STRING))
          FROM lineitem WHERE l_returnflag <> 'R'""")
def flatten_playlist_pages(lib):
    return _drop_order(flatten.flatten_playlist_items(_item_pages(lib))["playlist_tracks"])


@query("SELECT concat('t', CAST(l_partkey AS STRING)) AS track_id, l_shipdate AS played_at FROM lineitem")
def flatten_played_pages(lib):
    return _drop_order(flatten.flatten_played(_played_pages(lib))["track_events"])


@query("""SELECT concat('t', CAST(p_partkey AS STRING)) AS id, p_name AS name, p_brand AS album_id, 1 AS disc_number,
                 p_size * 10000 AS duration_ms, p_partkey % 7 = 0 AS explicit, l_linenumber AS track_number,
                 concat('urn:t:', CAST(p_partkey AS STRING)) AS track_url
          FROM lineitem JOIN part ON l_partkey = p_partkey""")
def flatten_track_rows(lib):
    return _drop_order(flatten.flatten_played(_played_pages(lib))["tracks"])


@query("""SELECT p_brand AS id, p_brand AS name, p_type AS album_type, '2000' AS release_date, p_size AS total_tracks,
                 CASE WHEN p_size > 2 THEN concat('urn:img:', p_brand) END AS image_url, concat('urn:al:', p_brand) AS album_url
          FROM lineitem JOIN part ON l_partkey = p_partkey""")
def flatten_album_rows(lib):
    return _drop_order(flatten.flatten_played(_played_pages(lib))["albums"])


@query("""SELECT concat('ar', CAST(s_suppkey AS STRING)) AS id, s_name AS name, concat('urn:ar:', CAST(s_suppkey AS STRING)) AS artist_url
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
          UNION ALL
          SELECT p_brand, p_brand, concat('urn:ar:', p_brand) FROM lineitem JOIN part ON l_partkey = p_partkey
          UNION ALL
          SELECT p_brand, p_brand, concat('urn:ar:', p_brand) FROM lineitem JOIN part ON l_partkey = p_partkey""")
def flatten_artist_rows(lib):
    return _drop_order(flatten.flatten_played(_played_pages(lib))["artists"])


@query("""SELECT 'track' AS side, concat('t', CAST(l_partkey AS STRING)) AS owner_id, concat('ar', CAST(l_suppkey AS STRING)) AS artist_id, 0 AS artist_order
          FROM lineitem
          UNION ALL
          SELECT 'track', concat('t', CAST(l_partkey AS STRING)), p_brand, 1 FROM lineitem JOIN part ON l_partkey = p_partkey
          UNION ALL
          SELECT 'album', p_brand, p_brand, 0 FROM lineitem JOIN part ON l_partkey = p_partkey""")
def flatten_bridge_rows(lib):
    return _drop_order(flatten.played_bridges(_played_pages(lib)))


@query("""SELECT concat('p', CAST(o_orderkey AS STRING)) AS playlist_id, concat('order ', CAST(o_orderkey AS STRING)) AS name,
                 CAST(floor(o_totalprice) AS INT) AS tracks, concat('urn:p:', CAST(o_orderkey AS STRING)) AS playlist_url,
                 CASE WHEN o_orderstatus <> 'P' THEN concat('urn:img:', CAST(o_orderkey AS STRING)) END AS image_url
          FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)""")
def owned_playlists(lib):
    key = F.col("o_orderkey").cast("string")
    entry = F.struct(
        F.concat(F.lit("p"), key).alias("id"), F.concat(F.lit("order "), key).alias("name"),
        F.struct(F.col("o_custkey").cast("string").alias("id")).alias("owner"),
        F.struct(F.floor("o_totalprice").cast("int").alias("total")).alias("items"),
        F.when(F.col("o_orderstatus") != "P", F.array(F.struct(F.concat(F.lit("urn:img:"), key).alias("url"))))
        .otherwise(F.expr("array()").cast("array<struct<url:string>>")).alias("images"),
        _url("urn:p:", key).alias("external_urls"))
    raw = lib.orders.select("o_orderkey", F.to_json(F.struct(F.array(entry).alias("items"))).alias("body"))
    user = lib.orders.agg(F.min("o_custkey")).first()[0]
    return _drop_order(flatten.flatten_playlists(pages.parse_pages(raw, "body", "playlists", F.col("o_orderkey")), str(user)))


@query("""SELECT concat('t', CAST(p_partkey AS STRING)) AS track_id, concat('ISRC', CAST(p_partkey AS STRING)) AS isrc,
                 concat(p_name, ' - ', p_brand) AS query FROM part""")
def track_queries(lib):
    track = F.struct(
        F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"),
        F.struct(F.concat(F.lit("ISRC"), F.col("p_partkey").cast("string")).alias("isrc")).alias("external_ids"),
        F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.col("p_type").alias("name"))).alias("artists"))
    raw = lib.part.select("p_partkey", F.to_json(track).alias("body"))
    return flatten.track_queries(pages.parse_pages(raw, "body", "track", F.col("p_partkey")))


@query("SELECT track_id, key, mode, camelot FROM track_features")
def normalise_feature_rows(lib):
    raw = lib.track_features.select(
        "track_id", F.replace("key", F.lit("b"), F.lit("♭")).alias("KEY"), F.initcap("mode").alias("Mode"), F.col("camelot").alias("Camelot"))
    raw = raw.withColumn("KEY", F.replace("KEY", F.lit("#"), F.lit("♯")))
    return flatten.normalise_features(raw)


# ---------------------------------------------------------------- ingestion

_LINE_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
_FIRST = """SELECT playlist_id, playlist_order, track_id FROM (
    SELECT playlist_id, playlist_order, track_id, row_number() OVER (
      PARTITION BY playlist_id, playlist_order ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn
    FROM playlist_lines) r WHERE rn = 1"""


@query(_FIRST)
def ingest_first_wins(lib):
    lines = lib.playlist_lines
    fresh, _ = ingest.insert_if_absent(lines.limit(0), lines, ["playlist_id", "playlist_order"], _LINE_ORDER)
    return fresh


@query(f"""SELECT n.* FROM ({_FIRST}) n LEFT JOIN (
              SELECT DISTINCT concat('p', CAST(l_orderkey AS STRING)) AS playlist_id, l_linenumber AS playlist_order
              FROM lineitem WHERE l_returnflag = 'A') s
            ON n.playlist_id = s.playlist_id AND n.playlist_order = s.playlist_order
          WHERE s.playlist_id IS NULL""")
def ingest_into_existing(lib):
    stored = lib.lineitem.filter("l_returnflag = 'A'").select(
        F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("playlist_id"), F.col("l_linenumber").alias("playlist_order")).distinct()
    fresh, _ = ingest.insert_if_absent(stored, lib.playlist_lines, ["playlist_id", "playlist_order"], _LINE_ORDER)
    return fresh


@query("SELECT * FROM track_features WHERE valence IS NULL")
def ingest_rejects(lib):
    rows = lib.track_features.withColumn("n", F.lit(0))
    _, rejected = ingest.insert_if_absent(rows.limit(0), rows, ["track_id"], ["n"])
    return rejected


@query("""SELECT coalesce(f.track_id, t.id) AS track_id, coalesce(f.valence, CAST(t.duration_ms / 10000 AS INT)) AS valence,
                 coalesce(f.energy, t.track_number) AS energy
          FROM track_features f FULL JOIN tracks t ON f.track_id = t.id""")
def ingest_fill_nulls(lib):
    incoming = lib.tracks.select(F.col("id").alias("track_id"), (F.col("duration_ms") / 10000).cast("int").alias("valence"),
                                 F.col("track_number").alias("energy"), F.lit(0).alias("n"))
    return ingest.fill_nulls(lib.track_features.select("track_id", "valence", "energy"), incoming, ["track_id"], ["n"])


@query("""SELECT user_id, ts, event_id, event_type, value FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS rn FROM events) r WHERE rn = 1""")
def ingest_plays_stream(lib):
    """The event files are streamed twice; the second pass must add nothing."""
    spark = lib.spark
    folder = scratch_path(spark, "plays")
    schema = lib.events.select("event_id", "user_id", "ts", "event_type", "value").schema
    for round_no in (1, 2):
        stream = (spark.readStream.schema(schema).parquet(f"{lib.path}/events.parquet*")
                  .withColumn("seen_order", F.col("event_id")))
        ingest_keyed_stream(stream, f"{folder}/table", f"{folder}/progress{round_no}", ["user_id", "ts"], "ts", ["seen_order"])
    return spark.read.parquet(f"{folder}/table").drop("day")


# ---------------------------------------------------------------- landed files

_PAGE_ORDERS = 200  # orders on a landed page


def _land(lib: StarLibrary, folder: str, round_no: int) -> None:
    """Files of one landing: played pages of many items, the first customer's playlists, and their items on pages at two offsets.

    Round 1 leaves out every third order and gives names one ending; round 2 has all orders, so it repeats plays and gives known tracks another name.
    Tracks of large parts have no name."""
    key = F.col("l_orderkey").cast("string")
    name = F.when(F.col("p_size") <= 45, F.concat("p_name", F.lit(f" r{round_no}")))
    lines = _lines(lib).withColumns({
        "played_at": F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "track_id": F.concat(F.lit("t"), F.col("p_partkey").cast("string")), "name": name,
        "maker_id": F.col("s_suppkey").cast("string")})
    # What an entry is made of, in the order of its fields.
    made_of = ["track_id", "name", "p_size", "p_brand", "p_type", "maker_id", "s_name", "p_partkey", "s_suppkey"]

    def nested(x) -> F.Column:
        return _nested_track(lambda c: x[c], x["name"], x["p_size"], F.lit(True))

    def write(rows: DataFrame, kind: str, page, columns: list, entry, **head) -> None:
        """Lines are dealt to pages and sorted as plain columns; entries are nested and turned to text where the page is written."""
        names = list(head)
        entries = rows.select(page.alias("page"), *[c.alias(n) for n, c in head.items()], F.struct("l_orderkey", "l_linenumber", *columns).alias("e"))
        whole = entries.repartition("page").groupBy("page", *names).agg(F.sort_array(F.collect_list("e")).alias("e"))  # a page is bounded
        body = F.to_json(F.struct(*[F.col(n) for n in names], F.transform("e", entry).alias("items")))
        (whole.sortWithinPartitions("page").select("page", body.alias("body"))
         .write.partitionBy("page").option("compression", "gzip").text(f"{folder}/{kind}/round={round_no}"))

    write(lines.filter("l_orderkey % 3 <> 0") if round_no == 1 else lines, "played", F.floor(F.col("l_orderkey") / _PAGE_ORDERS), ["played_at", *made_of],
          lambda x: F.struct(x["played_at"].alias("played_at"), nested(x).alias("track")))
    user = lib.orders.agg(F.min("o_custkey")).first()[0]
    mine = lib.orders.filter(F.col("o_custkey") == user)
    lists = mine.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.struct(
        F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit(f"r{round_no} "), F.col("o_orderkey").cast("string")).alias("name"),
        F.struct(F.col("o_custkey").cast("string").alias("id")).alias("owner"), F.struct(F.lit(1).alias("total")).alias("items"),
        F.array(F.struct(F.lit("urn:img").alias("url"))).alias("images"), _url("urn:p:", F.col("o_orderkey").cast("string")).alias("external_urls")).alias("entry"))
    write(lists, "playlists", F.lit(0), ["entry"], lambda x: x["entry"])
    owned = lines.join(mine.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").filter(F.lit(round_no == 1) | (F.col("l_linenumber") % 2 == 1))
    offset = F.when(F.col("l_linenumber") <= 3, 0).otherwise(50)
    write(owned, "playlist_items", F.concat_ws("_", key, offset.cast("string")), made_of, lambda x: F.struct(nested(x).alias("item")),
          playlist_id=F.concat(F.lit("p"), key), offset=offset, total=F.lit(51))


def _stored_tracks(spark, tables: str) -> DataFrame:
    """Per track with a play: its stored name and number of plays."""
    stored = ParquetLibrary(spark, tables)
    plays = stored.track_events.groupBy("track_id").agg(F.count("*").alias("n"))
    return plays.join(stored.tracks.select(F.col("id").alias("track_id"), "name"), "track_id", "left").select(F.lit("track").alias("kind"), F.col("track_id").alias("id"), "name", "n")


shared("line", """SELECT l_orderkey, l_linenumber, l_shipdate, concat('t', CAST(p_partkey AS STRING)) AS track_id, p_name, p_size,
    o_custkey = (SELECT min(o_custkey) FROM orders) AS mine, l_orderkey % 3 <> 0 AS early
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey""")


def _tracks_sql(early: str) -> str:
    return f"""SELECT 'track' AS kind, track_id AS id, max(CASE WHEN p_size <= 45 THEN concat(p_name, CASE WHEN early THEN ' r1' ELSE ' r2' END) END) AS name,
        count(DISTINCT l_shipdate) AS n
      FROM (SELECT track_id, p_name, p_size, l_shipdate, bool_or({early}) OVER (PARTITION BY track_id) AS early FROM line) l GROUP BY track_id"""


@query(f"""{_tracks_sql('early OR mine')}
      UNION ALL
      SELECT 'item', concat('p', CAST(l_orderkey AS STRING), ':', CAST(CASE WHEN spot <= 3 THEN place ELSE 50 + place END AS STRING)), track_id, 1 FROM (
        SELECT l_orderkey, track_id, CASE WHEN l_linenumber <= 3 THEN 3 ELSE 9 END AS spot,
          row_number() OVER (PARTITION BY l_orderkey, l_linenumber <= 3 ORDER BY l_linenumber, track_id) - 1 AS place FROM line WHERE mine) p
      UNION ALL
      SELECT 'list', concat('p', CAST(o_orderkey AS STRING)), concat('r1 ', CAST(o_orderkey AS STRING)), 1 FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)
      UNION ALL
      SELECT 'rerun adds snapshots', '', '', 0""")
def import_run(lib):
    """Two landings are imported one after the other, the second one twice: pages of many items, playlists over two pages, repeated plays, other names for
    known tracks, refused rows, other items for stored playlists."""
    spark, landed, tables = lib.spark, scratch_path(lib.spark, "landed"), scratch_path(lib.spark, "tables")
    user = str(lib.orders.agg(F.min("o_custkey")).first()[0])
    for round_no in (1, 2):
        _land(lib, landed, round_no)
        importing.import_pages(spark, landed, tables, user)
    stored, names = ParquetLibrary(spark, tables), ("tracks", "artists", "albums", "track_artists", "album_artists", "track_events", "playlists", "playlist_tracks")
    before = stored.version(*names)
    importing.import_pages(spark, landed, tables, user)
    items = stored.playlist_tracks.select(F.lit("item"), F.concat_ws(":", "playlist_id", F.col("playlist_order").cast("string")), "track_id", F.lit(1).cast("bigint"))
    lists = stored.playlists.select(F.lit("list"), "playlist_id", "name", F.lit(1).cast("bigint"))
    rerun = spark.range(1).select(F.lit("rerun adds snapshots"), F.lit(""), F.lit(""), F.lit(int(stored.version(*names) != before)).cast("bigint"))
    return _stored_tracks(spark, tables).union(items).union(lists).union(rerun)


@query(f"""{_tracks_sql('early')}
      UNION ALL
      SELECT 'refused tracks', '', '', 2 * count(*) FILTER (WHERE early AND p_size > 45) + 2 * count(*) FILTER (WHERE p_size > 45) FROM line""")
def played_pages_stream(lib):
    """Played pages are streamed as they land: one landing, a second one with the progress kept, and all pages again with the progress lost."""
    spark, landed, tables, rejects = lib.spark, scratch_path(lib.spark, "landed"), scratch_path(lib.spark, "tables"), scratch_path(lib.spark, "refused")
    progress = scratch_path(lib.spark, "progress")
    for step in (1, 2, 3):
        if step < 3:
            _land(lib, landed, step)
        ingest_played_stream(spark, f"{landed}/played", tables, f"{progress}/{step // 3}", f"{rejects}/{step}")
    refused = spark.read.schema("id string").option("recursiveFileLookup", True).parquet(*[f"{rejects}/{step}/tracks" for step in (1, 2, 3)]).agg(F.count("*").alias("n"))
    return _stored_tracks(spark, tables).union(refused.select(F.lit("refused tracks"), F.lit(""), F.lit(""), "n"))


# ---------------------------------------------------------------- files

_TRICKY = """concat('say "', p_name, '", ', p_type, chr(10), p_brand)"""


@query(f"""SELECT CAST(p_partkey AS STRING) AS part_id, {_TRICKY} AS text,
                  CASE WHEN p_size > 2 THEN p_brand ELSE '' END AS maybe FROM part""")
def csv_roundtrip(lib):
    path = scratch_path(lib.spark, "csv")
    rows = lib.part.select(F.col("p_partkey").cast("string").alias("part_id"), F.expr(_TRICKY.replace("chr(10)", "char(10)")).alias("text"),
                           F.when(F.col("p_size") > 2, F.col("p_brand")).alias("maybe"))
    csv_files.write_csv(rows, path)
    return csv_files.read_csv(lib.spark, path)


_RUNS = {"kmeans_k2": 2, "kmeans_k5": 5, "birch_k3": 3}


def _bpm_labels(lib: StarLibrary) -> DataFrame:
    """Runs that cut the tracks by tempo; the fastest are noise."""
    runs = F.array(*[F.struct(F.lit(n).alias("algorithm"), F.lit(k).alias("k")) for n, k in _RUNS.items()])
    return (lib.track_features.select("track_id", "bpm", F.explode(runs).alias("r"))
            .select("r.algorithm", "track_id", F.when(F.col("bpm") > 170, -1).otherwise(F.col("bpm") % F.col("r.k")).alias("cluster")))


_ASSIGNED = ("SELECT track_id, track_name, artist_names, album_name, album_image_url, " + ", ".join(MODEL_FEATURES)
             + ", CASE WHEN bpm > 170 THEN -1 ELSE bpm % {k} END AS cluster, '{name}' AS algorithm FROM feature_view")


@query(" UNION ALL ".join(_ASSIGNED.format(k=k, name=n) for n, k in _RUNS.items()))
def assignments_all_runs(lib):
    return selection.assignments(feature_view(lib), _bpm_labels(lib))


@query(_ASSIGNED.format(k=5, name="kmeans_k5"))
def assignments_write_read(lib):
    path = scratch_path(lib.spark, "assignments")
    selection.write_assignments(selection.assignments(feature_view(lib), _bpm_labels(lib)), path)
    return selection.read_assignment(lib.spark, path, "kmeans", k=5)


_LABEL_META = ("CASE n_nationkey % 5 WHEN 0 THEN concat('{{\"classes\": ', l, '}}') "
               "WHEN 1 THEN concat('{{\"classes\": [], \"schema\": {{\"classes\": ', o, '}}}}') "
               "WHEN 2 THEN concat('{{\"classes\": {{\"names\": ', l, '}}}}') "
               "WHEN 3 THEN concat('{{\"model\": {{\"classes\": ', l, '}}}}') "
               "ELSE concat('{{\"annotations\": ', o, '}}') END").replace("{{", "{").replace("}}", "}")


@query("""SELECT n_nationkey, 0 AS pos, n_name AS label FROM nation
          UNION ALL SELECT n_nationkey, 1, concat('region ', CAST(n_regionkey AS STRING)) FROM nation""")
def model_labels(lib):
    names = ["n_name", "concat('region ', cast(n_regionkey as string))"]
    as_list = F.expr("to_json(array(" + ", ".join(names) + "))")
    as_objects = F.expr("to_json(array(" + ", ".join(f"named_struct('name', {n})" for n in names) + "))")
    meta = lib.nation.withColumns({"l": as_list, "o": as_objects}).select("n_nationkey", F.expr(_LABEL_META).alias("meta"))
    return meta.select("n_nationkey", F.posexplode(labels.labels_from_metadata(F.col("meta"))).alias("pos", "label"))
