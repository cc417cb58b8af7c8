"""Registered queries: feature functions, vectors, similarity search, playlists, exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.constants import (CAMELOT_MAJOR, CAMELOT_MINOR, FLAT_TO_SHARP, MODEL_FEATURES, MOODS,
                                 NUMERIC_FEATURES, PITCH_CLASS, SEARCH_PITCH)
from tracklake.functions import music
from tracklake.operators import enrich, ingest, explore, playlist, scrape, search
from tracklake.operators.flatten import normalise_features
from tracklake.operators.neighbours import nearest_all, search_batch
from tracklake.operators.vectorise import feature_defaults as defaults_row
from tracklake.operators.vectorise import fit_vectors, vectorise
from tracklake.plans.library_queries import feature_view
from tracklake.plans.registry import query, shared
from tracklake.session import scratch_path, settle
from tracklake.sources import cell_index, index_store
from tracklake.sources.library import ParquetLibrary, StarLibrary

TWO_PI = "2 * pi()"


def _case(column: str, values: dict, text: bool = False) -> str:
    quote = "'{}'".format if text else str
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in values.items()) + " END"


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Rounded for comparison between engines; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# ---------------------------------------------------------------- feature functions

_MODE_SQL = "CASE mode WHEN 'major' THEN 1.0 WHEN 'minor' THEN 0.0 END"
_NUMBER_SQL = "CAST(regexp_extract(camelot, '([0-9]+)', 1) AS INT) - 1"
_LETTER_SQL = "CASE WHEN camelot LIKE '%B' THEN 1.0 ELSE 0.0 END"
_PITCH_SQL = _case("key", SEARCH_PITCH)


@query(f"""SELECT track_id, CAST({_MODE_SQL} AS DOUBLE) AS mode_value, {_NUMBER_SQL} AS camelot_number,
                  CAST({_LETTER_SQL} AS DOUBLE) AS camelot_letter, {_PITCH_SQL} AS pitch,
                  round(sin({TWO_PI} * ({_PITCH_SQL}) / 12), 6) + 0.0 AS pitch_sin, round(cos({TWO_PI} * ({_PITCH_SQL}) / 12), 6) + 0.0 AS pitch_cos
           FROM track_features""")
def key_columns(lib):
    pitch = music.pitch_class(F.col("key"))
    sin, cos = music.circular(pitch)
    df = lib.track_features.select(
        "track_id", music.parse_mode(F.upper("mode")).alias("mode_value"), music.camelot_number(F.concat(F.lit(" "), "camelot")).alias("camelot_number"),
        music.camelot_letter(F.lower("camelot")).alias("camelot_letter"), pitch.alias("pitch"), sin.alias("pitch_sin"), cos.alias("pitch_cos"))
    return rounded(df, ["pitch_sin", "pitch_cos"])


@query(f"""SELECT track_id, {_case('note', PITCH_CLASS)} AS key, note, mode,
                  CASE WHEN mode = 'minor' THEN {_case('note', CAMELOT_MINOR, True)} ELSE {_case('note', CAMELOT_MAJOR, True)} END AS camelot,
                  round(strength, 4) AS score
           FROM (SELECT track_id, coalesce({_case('key', FLAT_TO_SHARP, True)}, key) AS note, mode, speechiness / 40 AS strength
                 FROM track_features) k""")
def key_enrich(lib):
    rows = lib.track_features.select("track_id", "key", F.col("mode").alias("scale"), (F.col("speechiness") / 40).alias("strength"))
    return enrich.key_enrichment(rows)


_MODE_OF = ("(SELECT {c} FROM (SELECT {c}, count(*) AS n FROM track_features WHERE {c} IS NOT NULL GROUP BY {c}) m "
            "ORDER BY n DESC, {c} LIMIT 1)")


@query("SELECT " + ", ".join(f"CAST((SELECT median({c}) FROM track_features) AS DOUBLE) AS {c}" for c in NUMERIC_FEATURES) + f""",
         k AS key_default, coalesce({_case('k', SEARCH_PITCH)}, 0) AS pitch_class_default,
         CAST(coalesce(CASE m WHEN 'major' THEN 1.0 WHEN 'minor' THEN 0.0 END, 0.0) AS DOUBLE) AS mode_default,
         CAST(regexp_extract(c, '([0-9]+)', 1) AS INT) - 1 AS camelot_number_default,
         CAST(CASE WHEN c LIKE '%B' THEN 1.0 ELSE 0.0 END AS DOUBLE) AS camelot_letter_default
         FROM (SELECT {_MODE_OF.format(c='key')} AS k, {_MODE_OF.format(c='mode')} AS m, {_MODE_OF.format(c='camelot')} AS c) d""")
def feature_defaults(lib):
    return defaults_row(lib.track_features)


# ---------------------------------------------------------------- vectors

def _vector_ctes(name: str, numeric_default, pitch: str, mode: str) -> None:
    """Shared sub-queries: raw components, their moments, standardised components, unit components."""
    numeric = ", ".join(f"CAST(coalesce({c}, {numeric_default(c)}) AS DOUBLE) AS r{i}" for i, c in enumerate(NUMERIC_FEATURES))
    shared(f"{name}_raw", f"""
        SELECT track_id, {numeric}, sin({TWO_PI} * p / 12) AS r10, cos({TWO_PI} * p / 12) AS r11, CAST({mode} AS DOUBLE) AS r12,
               sin({TWO_PI} * n / 12) AS r13, cos({TWO_PI} * n / 12) AS r14, CAST({_LETTER_SQL} AS DOUBLE) AS r15
        FROM (SELECT *, {pitch} AS p, {_NUMBER_SQL} AS n FROM track_features) f""")
    moments = ", ".join(f"avg(r{i}) AS m{i}, CASE WHEN stddev_pop(r{i}) < 1e-9 THEN 1.0 ELSE stddev_pop(r{i}) END AS s{i}" for i in range(16))
    shared(f"{name}_moments", f"SELECT {moments} FROM {name}_raw")
    shared(f"{name}_scaled", "SELECT track_id, " + ", ".join(f"(r{i} - m{i}) / s{i} AS z{i}" for i in range(16))
           + f" FROM {name}_raw, (SELECT * FROM {name}_moments) mo")
    length = "sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(16)) + ")"
    shared(f"{name}_vec", "SELECT track_id, " + ", ".join(f"z{i} / len AS v{i}" for i in range(16))
           + f" FROM (SELECT *, CASE WHEN {length} = 0 THEN 1 ELSE {length} END AS len FROM {name}_scaled) s")


_vector_ctes("idx", lambda c: f"(SELECT median({c}) FROM track_features)",
             f"coalesce({_PITCH_SQL}, coalesce({_case(_MODE_OF.format(c='key'), SEARCH_PITCH)}, 0))", _MODE_SQL)
_vector_ctes("zero", lambda c: "0", f"coalesce({_PITCH_SQL}, 0)", _MODE_SQL)
_COMPONENTS = ", ".join(f"round(v{i}, 6) + 0.0 AS v{i}" for i in range(16))
_DOT = " + ".join(f"a.v{i} * q.v{i}" for i in range(16))


def _unpacked(df: DataFrame) -> DataFrame:
    return rounded(df.select("track_id", *[F.get("vector", F.lit(i)).alias(f"v{i}") for i in range(16)]), [f"v{i}" for i in range(16)])


@query(f"SELECT track_id, {_COMPONENTS} FROM idx_vec")
def vector_build(lib):
    return _unpacked(vectorise(lib.track_features, fit_vectors(lib.track_features)))


@query(f"SELECT track_id, {_COMPONENTS} FROM zero_vec")
def vector_build_zero(lib):
    return _unpacked(vectorise(lib.track_features, fit_vectors(lib.track_features, missing="zero")))


def _index(lib: StarLibrary, missing: str = "defaults"):
    """The view is settled once, as a stored index would be, and then read by the fit and by the search."""
    return search.build_index(settle(feature_view(lib)), missing)


_META = "f.track_id, f.track_name, f.artist_names, f.album_name, f.album_image_url"
_FIRST_TRACK = "(SELECT min(track_id) FROM track_features)"


@query(f"""SELECT CAST(row_number() OVER (ORDER BY s DESC, track_id) AS INT) AS rank, track_id, track_name, artist_names, album_name,
                  album_image_url, round(s, 6) + 0.0 AS score
           FROM (SELECT {_META}, {_DOT} AS s FROM idx_vec a JOIN feature_view f ON f.track_id = a.track_id
                 JOIN (SELECT * FROM idx_vec WHERE track_id = {_FIRST_TRACK}) q ON a.track_id <> q.track_id
                 ORDER BY s DESC, f.track_id LIMIT 10) t""")
def similar_by_id(lib):
    index, _ = _index(lib)
    first = lib.track_features.agg(F.min("track_id")).first()[0]
    return rounded(search.search_by_track_id(index, first, 10), ["score"])


@query(f"""SELECT CAST(row_number() OVER (ORDER BY s DESC, track_id) AS INT) AS rank, track_id, track_name, artist_names, album_name,
                  album_image_url, round(s, 6) + 0.0 AS score
           FROM (SELECT {_META}, {_DOT} AS s FROM idx_vec a JOIN feature_view f ON f.track_id = a.track_id
                 JOIN (SELECT * FROM idx_vec WHERE track_id = {_FIRST_TRACK}) q ON a.track_id <> q.track_id
                 ORDER BY s DESC, f.track_id LIMIT 10) t""")
def similar_by_cells(lib):
    """The same search on the index stored by cells: cells are opened best bound first until no other can hold a better row."""
    index, _ = _index(lib)
    path = scratch_path(lib.spark, "cells")
    cell_index.write_cells(settle(index), path, cell_rows=64)
    first = lib.track_features.agg(F.min("track_id")).first()[0]
    return rounded(cell_index.CellIndex(lib.spark, path).search_by_track_id(first, 10).rows, ["score"])


def _query_sql(values: dict[str, str]) -> str:
    """Unit components of a query given as SQL text per raw component; the others are index defaults."""
    raw = {i: f"(SELECT median({c}) FROM track_features)" for i, c in enumerate(NUMERIC_FEATURES)}
    pitch = f"coalesce({_case(_MODE_OF.format(c='key'), SEARCH_PITCH)}, 0)"
    camelot = _MODE_OF.format(c="camelot")
    number = f"(CAST(regexp_extract({camelot}, '([0-9]+)', 1) AS INT) - 1)"
    raw.update({10: f"sin({TWO_PI} * {pitch} / 12)", 11: f"cos({TWO_PI} * {pitch} / 12)",
                12: f"(CASE {_MODE_OF.format(c='mode')} WHEN 'major' THEN 1.0 ELSE 0.0 END)",
                13: f"sin({TWO_PI} * {number} / 12)", 14: f"cos({TWO_PI} * {number} / 12)",
                15: f"(CASE WHEN {camelot} LIKE '%B' THEN 1.0 ELSE 0.0 END)"})
    raw.update({int(k): v for k, v in values.items()})
    z = ", ".join(f"(CAST({raw[i]} AS DOUBLE) - m{i}) / s{i} AS z{i}" for i in range(16))
    length = "sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(16)) + ")"
    return "SELECT " + ", ".join(f"z{i} / {length} AS v{i}" for i in range(16)) + f" FROM (SELECT {z} FROM idx_moments) y"


shared("query_vec", _query_sql({"0": "120", "5": "60", "10": f"sin({TWO_PI} * 9 / 12)", "11": f"cos({TWO_PI} * 9 / 12)", "12": "0.0"}))


@query(f"""SELECT CAST(row_number() OVER (ORDER BY s DESC, track_id) AS INT) AS rank, track_id, track_name, artist_names, album_name,
                  album_image_url, round(s, 6) + 0.0 AS score
           FROM (SELECT {_META}, {_DOT} AS s FROM idx_vec a JOIN feature_view f ON f.track_id = a.track_id, (SELECT * FROM query_vec) q
                 ORDER BY s DESC, f.track_id LIMIT 10) t""")
def similar_by_features(lib):
    index, stats = _index(lib)
    return rounded(search.search_by_features(index, stats, 10, bpm=120, energy=60, key="A", mode="minor"), ["score"])


def _points(lib: StarLibrary) -> DataFrame:
    return lib.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


shared("points", "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings")


@query("""SELECT CAST(row_number() OVER (ORDER BY s DESC, id) AS INT) AS rank, id, label, round(s, 6) + 0.0 AS score
          FROM (SELECT a.id, a.label, list_dot_product(a.vector, q.vector) AS s FROM points a
                JOIN (SELECT * FROM points WHERE id = (SELECT min(vec_id) FROM embeddings)) q ON a.id <> q.id
                ORDER BY s DESC, a.id LIMIT 10) t""")
def embedding_search(lib):
    points = _points(lib)
    first = points.agg(F.min("id")).first()[0]
    vector = points.filter(F.col("id") == first).first()["vector"]
    return rounded(search.nearest(points, vector, 10, exclude_ids=[first], id_col="id").select("rank", "id", "label", "score"), ["score"])


@query("""SELECT id, nid, CAST(rn AS INT) AS rank, round(s, 6) + 0.0 AS score FROM (
            SELECT id, nid, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, nid) AS rn FROM (
              SELECT a.id, b.id AS nid, list_dot_product(a.vector, b.vector) AS s FROM points a JOIN points b ON a.id <> b.id) p) r
          WHERE rn <= 5""")
def knn_all_pairs(lib):
    return rounded(nearest_all(_points(lib).select("id", "vector"), 5), ["score"])


@query("""SELECT id, nid, CAST(rn AS INT) AS rank, round(s, 6) + 0.0 AS score FROM (
            SELECT id, nid, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, nid) AS rn FROM (
              SELECT CAST(a.label AS BIGINT) AS id, b.id AS nid, list_dot_product(a.vector, b.vector) AS s
              FROM (SELECT label, list(m ORDER BY pos) AS vector FROM (
                      SELECT label, pos, avg(v) AS m FROM (
                        SELECT label, unnest(vector) AS v, generate_subscripts(vector, 1) AS pos FROM points) u
                      GROUP BY label, pos) c GROUP BY label) a, points b) p) r
          WHERE rn <= 5""")
def search_label_centers(lib):
    """The five embeddings closest to the mean of every label: a batch of queries against the index."""
    points = settle(_points(lib))
    pooled = enrich.mean_pool(points, ["label"], "vector")
    centers = pooled.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("vector"))
    return rounded(search_batch(points, settle(centers.select(F.col("label").cast("bigint").alias("id"), "vector")), 5), ["score"])


@query(f"SELECT track_id, {_COMPONENTS}, TRUE AS is_current FROM idx_vec")
def index_save_load(lib):
    path, view = scratch_path(lib.spark, "index"), settle(feature_view(lib))
    index_store.ensure_index(lib.spark, path, lambda: view)
    index, _ = index_store.load_index(lib.spark, path)
    return _unpacked(index).withColumn("is_current", F.lit(index_store.is_current(lib.spark, path, view)))


@query("""SELECT step, n, current FROM (VALUES ('built', TRUE), ('nothing new', TRUE), ('valence filled', FALSE), ('built again', TRUE)) s(step, current),
          (SELECT count(*) AS n FROM track_features) c
          UNION ALL SELECT 'without valence', count(*) FILTER (WHERE valence IS NULL), TRUE FROM track_features
          UNION ALL SELECT 'filled', 0, TRUE""")
def index_freshness(lib):
    """An index over snapshot tables: fresh after an insert that adds nothing, stale after a page has completed stored rows, and built again then. Freshness
    is told from the snapshot numbers; completing rows rewrites the buckets of their keys alone."""
    spark, tables, path = lib.spark, scratch_path(lib.spark, "tables"), scratch_path(lib.spark, "index")
    names = ("track_features", "tracks", "albums", "track_artists", "artists")
    order = ["page_no", "item_pos", "source_rank", "pos"]
    numbered = lambda df: df.withColumns({c: F.lit(0) for c in order})
    features = settle(lib.track_features)  # comes twice
    for name in names:
        ingest.append_new(spark, tables, name, numbered(features if name == "track_features" else getattr(lib, name)), reject_nulls=False)
    stored = ParquetLibrary(spark, tables)
    make = lambda: settle(feature_view(stored))  # noqa: E731  (an index passes over its view several times)
    steps = []

    def note(step: str) -> None:
        index, _ = index_store.load_index(spark, path)
        steps.append((step, index.count(), index_store.is_current(spark, path, version=stored.version(*names))))

    index_store.ensure_index(spark, path, make, stored.version(*names))
    note("built")
    ingest.append_new(spark, tables, "track_features", numbered(features), reject_nulls=False)
    note("nothing new")
    gaps = stored.track_features.filter("valence IS NULL")
    steps.append(("without valence", gaps.count(), True))
    ingest.fill_stored(spark, tables, "track_features", numbered(gaps.withColumn("valence", F.lit(50))))
    note("valence filled")
    index_store.ensure_index(spark, path, make, stored.version(*names))
    note("built again")
    steps.append(("filled", stored.track_features.filter("valence IS NULL").count(), True))
    return spark.createDataFrame(steps, "step string, n long, current boolean")


# ---------------------------------------------------------------- moods and playlists

def _range_sql(column: str, low: int, high: int) -> str:
    v, middle, half = f"CAST(coalesce({column}, 0) AS DOUBLE)", (low + high) / 2, max((high - low) / 2, 1)
    return f"(CASE WHEN {v} BETWEEN {low} AND {high} THEN 1.0 ELSE greatest(0.0, 1.0 - abs({v} - {middle}) / {half}) END)"


def _mood_sql(mood: str) -> str:
    return "CAST(" + " + ".join(_range_sql(*r) for r in MOODS[mood]) + " AS DOUBLE) / 5.0"


@query("SELECT track_id, " + ", ".join(f"round({_mood_sql(m)}, 6) + 0.0 AS {m}" for m in MOODS) + " FROM track_features")
def mood_scores(lib):
    return rounded(playlist.mood_scores(lib.track_features).select("track_id", *MOODS), list(MOODS))


def _sampled_sql(pool: str, kept: str = "TRUE") -> str:
    return f"""SELECT track_id, round(score, 6) + 0.0 AS score FROM (
        SELECT *, count(*) FILTER (WHERE score >= 0.72) OVER () AS strong FROM ({pool}) p) s
        WHERE {kept} ORDER BY md5(concat(track_id, ':7')), track_id LIMIT 3"""


@query("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS mood, x.* FROM (" + _sampled_sql(
        f"SELECT track_id, {_mood_sql(m)} AS score FROM feature_view ORDER BY score DESC, track_name NULLS FIRST, track_id LIMIT 9",
        "strong < 3 OR score >= 0.72") + ") x" for m in MOODS) + ") r")
def mood_candidates(lib):
    return rounded(playlist.candidates_by_mood(feature_view(lib), list(MOODS), seed=7), ["score"])


@query(_sampled_sql(f"""SELECT f.track_id, 0.72 * ({_DOT}) + 0.28 * ({_mood_sql('party')}) AS score
        FROM zero_vec a JOIN feature_view f ON f.track_id = a.track_id
        JOIN (SELECT * FROM zero_vec WHERE track_id = {_FIRST_TRACK}) q ON a.track_id <> q.track_id
        ORDER BY score DESC, f.track_name NULLS FIRST, f.track_id LIMIT 9"""))
def followup_candidates(lib):
    index, _ = _index(lib, "zero")
    first = lib.track_features.agg(F.min("track_id")).first()[0]
    return rounded(playlist.followup_candidates(index, "party", first, seed=7).select("track_id", "score"), ["score"])


@query("SELECT " + ", ".join(f"round(avg(CAST(coalesce({c}, 0) AS DOUBLE)), 6) AS {c}" for c in NUMERIC_FEATURES) + " FROM track_features")
def seed_average(lib):
    return rounded(playlist.seed_average(lib.track_features), NUMERIC_FEATURES)


_SEEDS = "SELECT * FROM feature_view ORDER BY popularity DESC, track_id LIMIT 5"
shared("seeds", _SEEDS)
shared("seed_vec", _query_sql({str(i): f"(SELECT avg(CAST(coalesce({c}, 0) AS DOUBLE)) FROM seeds)" for i, c in enumerate(NUMERIC_FEATURES)}))


@query(f"""SELECT CAST(row_number() OVER (ORDER BY popularity DESC, track_id) AS INT) AS rank, track_id, track_name, artist_names,
                  CAST(NULL AS DOUBLE) AS score FROM seeds
           UNION ALL
           SELECT CAST(5 + row_number() OVER (ORDER BY s DESC, track_id) AS INT), track_id, track_name, artist_names, round(s, 6) + 0.0
           FROM (SELECT f.track_id, f.track_name, f.artist_names, {_DOT} AS s
                 FROM idx_vec a JOIN feature_view f ON f.track_id = a.track_id, (SELECT * FROM seed_vec) q
                 WHERE a.track_id NOT IN (SELECT track_id FROM seeds)
                 ORDER BY s DESC, f.track_id LIMIT 15) t""")
def playlist_continue(lib):
    index, stats = _index(lib)
    seeds = index.orderBy(F.desc("popularity"), "track_id").limit(5)
    seeds = seeds.withColumn("seed_no", F.struct(-F.col("popularity"), F.col("track_id")))
    return rounded(playlist.playlist_continuation(index, stats, seeds, 20), ["score"])


# ---------------------------------------------------------------- exploration

@query(f"""SELECT track_id, {", ".join(
    f"CASE WHEN lo_{c} >= 0 AND hi_{c} <= 100 THEN round({c} / 50.0 - 1.0, 6) + 0.0 WHEN lo_{c} = hi_{c} THEN 0.0 "
    f"ELSE round(CAST({c} - lo_{c} AS DOUBLE) / (hi_{c} - lo_{c}) * 2.0 - 1.0, 6) + 0.0 END AS {c}_axis" for c in NUMERIC_FEATURES)}
    FROM track_features, (SELECT {", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NUMERIC_FEATURES)} FROM track_features) b""")
def axis_normalise(lib):
    names = [f"{c}_axis" for c in NUMERIC_FEATURES]
    return rounded(explore.axis_normalise(lib.track_features, NUMERIC_FEATURES).select("track_id", *names), names)


_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_NUMERIC_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE CAST({c} AS STRING) <> '') AS non_empty,
               count(*) FILTER (WHERE regexp_matches(CAST({c} AS STRING), '{_NUMERIC_RE}')) AS "numeric",
               count(*) FILTER (WHERE CAST({c} AS STRING) <> '') > 0 AND count(*) FILTER (WHERE CAST({c} AS STRING) <> '')
                 = count(*) FILTER (WHERE regexp_matches(CAST({c} AS STRING), '{_NUMERIC_RE}')) AS is_numeric
        FROM customer""" for c in _CUSTOMER))
def numeric_inference(lib):
    return explore.numeric_columns(lib.customer.select(*[F.col(c).cast("string") for c in _CUSTOMER]))


def _clustered(lib: StarLibrary) -> DataFrame:
    """Embeddings by label, without a cluster where the label is 9."""
    return lib.embeddings.withColumn("cluster", F.when(F.col("label") < 9, F.col("label")))


@query("""SELECT coalesce(CAST(CASE WHEN label < 9 THEN label END AS STRING), 'unclustered') AS cluster, count(*) AS tracks
          FROM embeddings GROUP BY 1""")
def cluster_sizes(lib):
    return explore.cluster_sizes(_clustered(lib))


@query("""SELECT count(*) AS tracks, count(DISTINCT label) AS clusters, 3 AS numeric_features FROM embeddings""")
def cluster_totals(lib):
    return explore.totals(_clustered(lib))


@query("""SELECT cluster, tracks, CAST(rn AS INT) AS sample_no, vec_id FROM (
            SELECT coalesce(CAST(CASE WHEN label < 9 THEN label END AS STRING), 'unclustered') AS cluster, vec_id,
                   count(*) OVER (PARTITION BY label) AS tracks, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn
            FROM embeddings) r WHERE rn <= 5""")
def cluster_detail(lib):
    return explore.cluster_detail(_clustered(lib), ["vec_id"]).select("cluster", "tracks", "sample_no", "vec_id")


@query("SELECT vec_id, label FROM embeddings WHERE label >= 9")
def cluster_focus(lib):
    return explore.focus(_clustered(lib), explore.NO_CLUSTER).select("vec_id", "label")


_AXES = ["x", "y", "z"]
shared("plane", """SELECT vec_id, coalesce(CAST(CASE WHEN label < 9 THEN label END AS STRING), 'unclustered') AS cluster,
    CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings""")


@query("""SELECT vec_id, round(p, 6) + 0.0 AS proximity FROM (
            SELECT a.vec_id, greatest(0.0, 1.0 - sqrt((a.x - q.x) * (a.x - q.x) + (a.y - q.y) * (a.y - q.y) + (a.z - q.z) * (a.z - q.z)) / 0.75) AS p
            FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings) a
            JOIN (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings
                  WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q ON a.label = q.label AND a.vec_id <> q.vec_id) r
          WHERE p > 0.24 ORDER BY p DESC, vec_id LIMIT 20""")
def neighbours_in_axes(lib):
    rows = lib.embeddings.select("vec_id", F.col("label").alias("cluster"), *[F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate(_AXES)])
    first = rows.agg(F.min("vec_id")).first()[0]
    return rounded(explore.axis_neighbours(rows, first, _AXES, "vec_id").select("vec_id", "proximity"), ["proximity"])


# A pair of points is an outline edge when no point of the cluster lies to its right.
@query("""SELECT DISTINCT a.cluster, a.x, a.y FROM plane a JOIN plane b ON a.cluster = b.cluster AND a.vec_id <> b.vec_id
          LEFT JOIN plane c ON c.cluster = a.cluster AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
                           AND c.vec_id <> a.vec_id AND c.vec_id <> b.vec_id
          WHERE c.vec_id IS NULL""")
def cluster_hull(lib):
    rows = _clustered(lib).withColumns({"x": F.get("embedding", F.lit(0)), "y": F.get("embedding", F.lit(1))})
    return explore.cluster_hulls(rows, "x", "y").select("cluster", "x", "y")


# ---------------------------------------------------------------- enrichment

_PAGE = "concat('<dl>', chr(10), ' <dt>Popularity</dt>', chr(10), '<dd>', length(html), '%</dd>', chr(10), '<dt>Key</dt>', chr(10), '<dd>', " \
        "CASE WHEN page_id % 2 = 0 THEN 'C♯ Minor' ELSE 'E♭ Major' END, '</dd>', chr(10), html)"


@query("""SELECT page_id, 'Popularity' AS name, CAST(length(html) AS STRING) AS value FROM pages
          UNION ALL SELECT page_id, 'key', CASE WHEN page_id % 2 = 0 THEN 'C♯' ELSE 'E♭' END FROM pages
          UNION ALL SELECT page_id, 'mode', CASE WHEN page_id % 2 = 0 THEN 'Minor' ELSE 'Major' END FROM pages""")
def html_features(lib):
    wrapped = lib.pages.select("page_id", F.expr(_PAGE.replace("chr(10)", "char(10)")).alias("html"))
    return scrape.feature_pairs(wrapped, "page_id").drop("line")


@query("""SELECT page_id, length(html) AS popularity, CASE WHEN page_id % 2 = 0 THEN 'C#' ELSE 'Eb' END AS key,
                 CASE WHEN page_id % 2 = 0 THEN 'minor' ELSE 'major' END AS mode FROM pages""")
def html_feature_rows(lib):
    wrapped = lib.pages.select("page_id", F.expr(_PAGE.replace("chr(10)", "char(10)")).alias("html"))
    rows = scrape.feature_rows(scrape.feature_pairs(wrapped, "page_id"), "page_id", ["Popularity", "key", "mode"])
    return normalise_features(rows).withColumn("popularity", F.col("popularity").try_cast("bigint"))


@query("SELECT page_id, CAST(5 + page_id % 20 AS STRING) AS \"Energy\" FROM pages")
def html_repeated_names(lib):
    """A name that a page repeats, with values of one and two digits: the last one holds."""
    html = F.concat(F.lit("<dt>Energy</dt>\n<dd>"), F.col("page_id") % 90 + 9, F.lit("%</dd>\n<dt>Energy</dt>\n<dd>"), F.col("page_id") % 20 + 5,
                    F.lit("%</dd>\n"), F.col("html"))
    return scrape.feature_rows(scrape.feature_pairs(lib.pages.select("page_id", html.alias("html")), "page_id"), "page_id", ["Energy"])


_POOLED = """SELECT label, pos - 1 AS pos, avg(v) AS m FROM (
    SELECT label, unnest(vector) AS v, generate_subscripts(vector, 1) AS pos FROM points) u GROUP BY label, pos"""


@query(f"SELECT label, CAST(pos AS INT) AS pos, round(m, 6) + 0.0 AS mean FROM ({_POOLED}) p")
def mean_pool(lib):
    return rounded(enrich.mean_pool(_points(lib), ["label"], "vector"), ["mean"])


# The key column is itself called label, so the oracle names the class ``genre``.
# The 25 nations name all positions, with a number behind every further round.
_SCORED = f"""SELECT p.label, concat(n.n_name, ' ', CAST(p.pos // 25 AS STRING)) AS genre, p.pos, abs(p.m) * 10 AS score
    FROM ({_POOLED}) p JOIN nation n ON n.n_nationkey = p.pos % 25"""


def _by_group(lib: StarLibrary) -> DataFrame:
    points = _points(lib).withColumnRenamed("label", "track_id")
    width = points.agg(F.max(F.size("vector"))).first()[0]
    nations = lib.nation.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x.n_name).alias("names"))
    names = nations.select(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.concat(
        F.get("names", i % 25), F.lit(" "), F.floor(i / 25).cast("string")))).scalar()
    return enrich.label_scores(enrich.mean_pool(points, ["track_id"], "vector"), ["track_id"], names).withColumn("score", F.abs("score") * 10)


@query(f"SELECT label AS track_id, genre AS label, CAST(pos AS INT) AS pos, round(score, 6) AS score FROM ({_SCORED}) s")
def label_scores(lib):
    return rounded(_by_group(lib), ["score"])


@query(f"""SELECT label AS track_id, count(*) AS labels, round(max(CASE WHEN pos = 0 THEN score END), 6) + 0.0 AS first_score,
                  round(max(CASE WHEN pos = 63 THEN score END), 6) + 0.0 AS last_score, round(max(score), 6) + 0.0 AS best_score
           FROM ({_SCORED}) s GROUP BY label""")
def score_map_lookup(lib):
    """The map of all class scores of a track, asked for two labels, its size and its largest value."""
    scored = settle(_by_group(lib))
    ends = scored.filter(F.col("pos").isin(0, 63)).groupBy("track_id").agg(F.min_by("label", "pos").alias("a"), F.max_by("label", "pos").alias("z"))
    maps = enrich.score_map(scored, ["track_id"]).join(ends, "track_id")
    return rounded(maps.select("track_id", F.size("scores").cast("bigint").alias("labels"), F.try_element_at("scores", "a").alias("first_score"),
                               F.try_element_at("scores", "z").alias("last_score"), F.array_max(F.map_values("scores")).alias("best_score")),
                   ["first_score", "last_score", "best_score"])


@query(f"""SELECT label AS track_id, genre, CAST(rn - 1 AS INT) AS genre_order FROM (
             SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, pos) AS rn FROM ({_SCORED}) s) r
           WHERE rn <= 5 AND score >= 0.15""")
def genres_topk(lib):
    return enrich.genres(_by_group(lib), ["track_id"])


_CLASS_NAMES = ["danceable", "aggressive", "happy", "party", "relaxed", "sad", "acoustic", "instrumental", "voice"]


def _r4(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(24, 10)), 4) AS DOUBLE)"


@query(f"""SELECT id, danceability, energy, acousticness, instrumentalness, valence, dance_floor, happy, sad, chill, aggressive, hype,
                  {_r4('0.6 * danceability + 0.4 * dance_floor')} AS groove, {_r4('0.5 * chill + 0.5 * (1.0 - aggressive)')} AS warmup,
                  hype AS peak_time, {_r4('0.5 * score + 0.5 * (1.0 - aggressive)')} AS blendability, vocal_risk
           FROM (SELECT *, {_r4('0.6 * danceability + 0.4 * arousal')} AS dance_floor FROM (
             SELECT id, arousal, {", ".join(f"{_r4(src)} AS {name}" for name, src in [
                 ("danceability", "danceable"), ("energy", "arousal"), ("acousticness", "acoustic"), ("instrumentalness", "instrumental"),
                 ("valence", "val"), ("happy", "happy0"), ("sad", "sad0"), ("chill", "relaxed"), ("aggressive", "aggressive0"),
                 ("hype", "0.5 * party + 0.5 * arousal"), ("score", "score0"), ("vocal_risk", "voice")])}
             FROM (SELECT id, abs(vector[1]) AS danceable, abs(vector[2]) AS aggressive0, abs(vector[3]) AS happy0, abs(vector[4]) AS party,
                          abs(vector[5]) AS relaxed, abs(vector[6]) AS sad0, abs(vector[7]) AS acoustic, abs(vector[8]) AS instrumental,
                          CASE WHEN label > 0 THEN abs(vector[9]) ELSE 0.0 END AS voice, abs(vector[10]) AS score0,
                          greatest(0.0, least(1.0, (vector[11] * 40 + 3 - 1.0) / 8.0)) AS val,
                          greatest(0.0, least(1.0, (vector[12] * 40 + 3 - 1.0) / 8.0)) AS arousal
                   FROM points) a) b) c""")
def composite_scores(lib):
    v = F.col("vector")
    classes = {n: F.abs(F.get(v, F.lit(i))) for i, n in enumerate(_CLASS_NAMES)}
    classes["voice"] = F.when(F.col("label") > 0, classes["voice"])
    rows = _points(lib).select("id", *[c.alias(n) for n, c in classes.items()], F.round(F.abs(F.get(v, F.lit(9))), 4).alias("score"),
                               (F.get(v, F.lit(10)) * 40 + 3).alias("valence_raw"), (F.get(v, F.lit(11)) * 40 + 3).alias("arousal_raw"))
    return enrich.composite_scores(rows).select(
        "id", "danceability", "energy", "acousticness", "instrumentalness", "valence", "dance_floor", "happy", "sad", "chill",
        "aggressive", "hype", "groove", "warmup", "peak_time", "blendability", "vocal_risk")


@query("""SELECT q.query, coalesce(m.url, '') AS url FROM (SELECT DISTINCT concat(source, ' - ', lang) AS query FROM documents) q
          LEFT JOIN (SELECT query, min_by(url, doc_id) AS url FROM (
              SELECT concat(source, ' - ', lang) AS query, doc_id, concat('urn:d:', CAST(doc_id AS STRING)) AS url
              FROM documents WHERE contains(lower(text), lower(source)) OR contains(lower(text), lower(lang))) h GROUP BY query) m
          ON m.query = q.query""")
def match_candidates(lib):
    landed = lib.documents.select(
        F.concat("source", F.lit(" - "), "lang").alias("query"), F.col("doc_id").alias("source_priority"), F.lit(None).cast("string").alias("title"),
        F.col("text").alias("description"), F.concat(F.lit("urn:d:"), F.col("doc_id").cast("string")).alias("url"))
    return scrape.match_candidates(landed.select("query"), landed)
