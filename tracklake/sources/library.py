"""Table scans: the relational tables from Parquet, or derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracklake.schemas import KEYS, TABLES, table_schema
from tracklake.sources.snapshots import MANIFESTS, SnapshotTable

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

# One SQL text per table, valid on Spark and on the oracle engine alike. Integer arithmetic only, so that
# both give the same bits. Artist and track positions are arithmetic, not windows: a supplier or part
# that owns a third of the rows costs no more than any other.
DERIVED = {
    "artists": """
        SELECT concat('ar', CAST(s_suppkey AS STRING)) AS id, s_name AS name,
               concat('urn:ar:', CAST(s_suppkey AS STRING)) AS artist_url
        FROM supplier""",
    "albums": """
        SELECT p_brand AS id, p_brand AS name, min(p_type) AS album_type, '2000' AS release_date,
               CAST(count(*) AS INT) AS total_tracks, concat('urn:img:', p_brand) AS image_url,
               concat('urn:al:', p_brand) AS album_url
        FROM part GROUP BY p_brand""",
    # Artists of an album: the indebted suppliers of the nation it is numbered for.
    "album_artists": """
        SELECT concat('Brand#', CAST(1 + s_nationkey AS STRING)) AS album_id,
               concat('ar', CAST(s_suppkey AS STRING)) AS artist_id, CAST(s_suppkey AS INT) AS artist_order
        FROM supplier WHERE s_acctbal < 0""",
    "tracks": """
        SELECT concat('t', CAST(p_partkey AS STRING)) AS id, p_name AS name, p_brand AS album_id,
               1 AS disc_number, p_size * 10000 AS duration_ms, p_partkey % 7 = 0 AS explicit,
               CAST(1 + p_partkey % 20 AS INT) AS track_number,
               concat('urn:t:', CAST(p_partkey AS STRING)) AS track_url
        FROM part""",
    # Suppliers credited on a part: those with a returned line of more than forty pieces.
    "track_artists": """
        SELECT DISTINCT concat('t', CAST(l_partkey AS STRING)) AS track_id,
               concat('ar', CAST(l_suppkey AS STRING)) AS artist_id, CAST(l_suppkey AS INT) AS artist_order
        FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40""",
    "track_events": """
        SELECT DISTINCT concat('t', CAST(l_partkey AS STRING)) AS track_id, l_shipdate AS played_at
        FROM lineitem""",
    "playlists": """
        SELECT concat('p', CAST(o_orderkey AS STRING)) AS playlist_id,
               concat('order ', CAST(o_orderkey AS STRING)) AS name, CAST(o_custkey AS STRING) AS owner_id
        FROM orders""",
    # Every line of an order; several lines may claim one position (see insert_if_absent).
    "playlist_lines": """
        SELECT concat('p', CAST(l_orderkey AS STRING)) AS playlist_id, l_linenumber AS playlist_order,
               concat('t', CAST(l_partkey AS STRING)) AS track_id, l_partkey, l_suppkey, l_shipdate,
               l_extendedprice
        FROM lineitem""",
    # The largest parts carry no features, every eleventh valence is absent, and H is no note name.
    "track_features": """
        SELECT concat('t', CAST(p_partkey AS STRING)) AS track_id,
          CAST(60 + (p_partkey * 37) % 120 AS INT) AS bpm,
          CASE p_partkey % 13 WHEN 0 THEN 'C' WHEN 1 THEN 'C#' WHEN 2 THEN 'D' WHEN 3 THEN 'Eb'
               WHEN 4 THEN 'E' WHEN 5 THEN 'F' WHEN 6 THEN 'F#' WHEN 7 THEN 'G' WHEN 8 THEN 'Ab'
               WHEN 9 THEN 'A' WHEN 10 THEN 'Bb' WHEN 11 THEN 'B' ELSE 'H' END AS key,
          CASE WHEN p_partkey % 2 = 0 THEN 'major' ELSE 'minor' END AS mode,
          concat(CAST(1 + p_partkey % 12 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE 'A' END) AS camelot,
          CAST(least(100, n * 2) AS INT) AS popularity,
          CAST(floor(qty / n) AS INT) AS loudness,
          CAST(floor(100 * r / n) AS INT) AS acousticness,
          CAST(floor(10 * disc / n) AS INT) AS danceability,
          CAST(floor(100 * o / n) AS INT) AS energy,
          p_size * 2 AS instrumentalness,
          CAST(floor(12 * tax / n) AS INT) AS liveness,
          CAST((p_partkey * 13) % 40 AS INT) AS speechiness,
          CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(floor(100 * nn / n) AS INT) END AS valence
        FROM part JOIN (
          SELECT l_partkey, count(*) AS n,
            sum(CAST(l_quantity AS INT)) AS qty,
            sum(CAST(round(l_discount * 100) AS INT)) AS disc,
            sum(CAST(round(l_tax * 100) AS INT)) AS tax,
            sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r,
            sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS nn,
            sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS o
          FROM lineitem GROUP BY l_partkey) a ON l_partkey = p_partkey
        WHERE p_size < 48""",
}


class Library:
    """Lazy access to the tables of one folder by attribute."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _scan(self, name: str) -> DataFrame:
        raise NotImplementedError

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._scan(name)


class ParquetLibrary(Library):
    """The relational tables as Parquet folders, read with their declared schema.

    A table nobody has written yet reads as empty."""

    def _scan(self, name):
        if name not in TABLES:
            raise AttributeError(name)
        folder = f"{self.path}/{name}"
        if path_exists(self.spark, f"{folder}/{MANIFESTS}"):
            return self.snapshots(name).read()
        if not path_exists(self.spark, folder):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(folder)


    def snapshots(self, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.path}/{name}", table_schema(name), KEYS[name])

    def version(self, *names: str) -> str:
        """Snapshot numbers of tables, to compare with those something was made from."""
        return ",".join(f"{n}={self.snapshots(n).version()}" for n in names)


class StarLibrary(Library):
    """The same tables derived from the star-schema Parquet files."""

    def _scan(self, name):
        if name in DERIVED:
            text = DERIVED[name]
            used = {t: self._raw(t) for t in ("supplier", "part", "orders", "lineitem") if t in text}
            for t in used:
                text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
            return self.spark.sql(text, **used)
        if name in DRIVER_TABLES:
            return self._raw(name)
        raise AttributeError(name)

    def _raw(self, name):
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """Deal out a plain scan that comes in fewer pieces than there are cores; larger inputs pass unchanged.

    For work that is heavy per row, such as building or parsing nested text."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
