import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.constants import NUMERIC_FEATURES
from tracklake.functions import music
from tracklake.operators import enrich, explore, scrape, search
from tracklake.operators.playlist import first_candidates, playlist_continuation, seed_average
from tracklake.operators.skew import global_index, hot_join
from tracklake.operators.vectorise import fit_vectors, vectorise
from tracklake.sources import index_store
from tracklake.sources.labels import labels_from_metadata, read_labels


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_"))
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("text, number, letter", [
    ("12b", 11, 1.0), (" 3 A ", 2, 0.0), ("13A", None, None), ("0A", None, None), ("1C", None, None), ("\t7B\n", 6, 1.0), ("", None, None)])
def test_camelot(spark, text, number, letter):
    assert one(spark, music.camelot_number(F.col("c")), c=text) == number
    assert one(spark, music.camelot_letter(F.col("c")), c=text) == letter


@pytest.mark.parametrize("text, value", [(" Major\n", 1.0), ("MINOR", 0.0), ("dorian", None)])
def test_mode(spark, text, value):
    assert one(spark, music.parse_mode(F.col("c")), c=text) == value


@pytest.mark.parametrize("value, low, high, score", [(45, 0, 45, 1.0), (46, 0, 45, 0.0), (5.5, 5, 5, 0.5), (7, 5, 5, 0.0)])
def test_range_score(spark, value, low, high, score):
    assert one(spark, music.range_score(F.col("v"), low, high), v=value) == pytest.approx(score)


def test_unknown_mood_and_length(spark):
    assert one(spark, music.mood_score("dance")) == 0.0
    assert [music.clamp_length(n) for n in (1, 20, 500)] == [5, 20, 100]


FEATURES = "track_id string, " + ", ".join(f"{c} int" for c in NUMERIC_FEATURES) + ", key string, mode string, camelot string"


def feature_rows(spark, rows):
    return spark.createDataFrame([(r[0], *r[1], *r[2]) for r in rows], FEATURES)


@pytest.fixture()
def features(spark):
    rng = np.random.default_rng(0)
    rows = [(f"t{i}", [int(x) for x in rng.integers(0, 100, 9)] + [50], ("C#", "major", "3B")) for i in range(20)]
    rows.append(("gap", [None] * 10, (" H", None, "13A")))
    return feature_rows(spark, rows)


def test_vectors_have_length_one_or_zero(spark, features):
    stats = fit_vectors(features)
    out = {r["track_id"]: np.array(r["vector"]) for r in vectorise(features, stats).collect()}
    assert stats.stds[9] == 1.0  # no spread
    for v in out.values():
        assert v.shape == (16,) and (abs(np.linalg.norm(v) - 1) < 1e-12 or not v.any())
    # everything missing: medians, and the most frequent key, mode and camelot
    raw = np.array([*[np.median([r[c] for r in features.collect() if r[c] is not None]) for c in NUMERIC_FEATURES],
                    math.sin(2 * math.pi / 12), math.cos(2 * math.pi / 12), 1.0,
                    math.sin(4 * math.pi / 12), math.cos(4 * math.pi / 12), 1.0])
    z = (raw - np.array(stats.means)) / np.array(stats.stds)
    assert np.allclose(out["gap"], z / (np.linalg.norm(z) or 1.0), atol=1e-9)


def test_zero_policy_clamps(spark):
    rows = feature_rows(spark, [("a", [1] * 10, ("C", "major", "13A")), ("b", [None] * 10, ("?", "x", "3 A")), ("c", [5] * 10, ("D", "minor", "12b"))])
    stats = fit_vectors(rows, missing="zero")
    assert stats.means[0] == 2.0
    assert stats.means[15] == pytest.approx(1 / 3)
    assert stats.means[13] == pytest.approx((math.sin(2 * math.pi * 11 / 12) * 2 + 0.0) / 3)


def named(features):
    return features.withColumns({"track_name": F.col("track_id"), "artist_names": F.lit("x"), "album_name": F.lit("y"), "album_image_url": F.lit("z")})


def test_search(spark, features, tmp_path):
    view = named(features)
    index, stats = search.build_index(view)
    hits = search.search_by_track_id(index, "t3", 4).collect()
    assert [h["rank"] for h in hits] == [1, 2, 3, 4] and "t3" not in [h["track_id"] for h in hits]
    vectors = {r["track_id"]: np.array(r["vector"]) for r in index.collect()}
    best = sorted((-vectors["t3"] @ v, k) for k, v in vectors.items() if k != "t3")[:4]
    assert [h["track_id"] for h in hits] == [k for _, k in best]
    # without exclusion a track is its own best match
    assert search.nearest(index, list(vectors["t3"]), 1).first()["track_id"] == "t3"
    with pytest.raises(ValueError):
        search.search_by_track_id(index, "nobody", 4)
    with pytest.raises(ValueError):
        search.search_by_features(index, stats, 4, bpm=None)
    fresh = view.filter("track_id = 't3'").withColumn("track_id", F.lit("new"))
    assert search.search_by_track_id(index, "new", 1, stats, fresh).first()["track_id"] == "t3"


def test_index_follows_its_source(spark, features, tmp_path):
    path, view = str(tmp_path / "index"), named(features)
    assert not index_store.is_current(spark, path, view)
    index_store.ensure_index(spark, path, lambda: view)
    assert index_store.is_current(spark, path, view)
    changed = view.withColumn("bpm", F.when(F.col("track_id") == "t1", 199).otherwise(F.col("bpm")))
    assert not index_store.is_current(spark, path, changed)
    index, stats = index_store.ensure_index(spark, path, lambda: changed)
    assert index.filter("track_id = 't1'").first()["bpm"] == 199 and len(stats.means) == 16


def test_continuation(spark, features):
    index, stats = search.build_index(named(features))
    seeds = index.filter("track_id in ('t1', 't2', 'gap')").withColumn("seed_no", F.col("track_id"))
    out = playlist_continuation(index, stats, seeds, 6).orderBy("rank").collect()
    assert [r["track_id"] for r in out][:3] == ["gap", "t1", "t2"] and len({r["track_id"] for r in out}) == 6
    assert playlist_continuation(index, stats, index.withColumn("seed_no", F.col("track_id")), 5).count() == 5
    assert seed_average(seeds).first()["valence"] == pytest.approx(100 / 3)  # the gap counts as 0
    with pytest.raises(ValueError):
        playlist_continuation(index, stats, seeds.limit(0), 6)


def test_strong_matches_or_fallback(spark):
    def rows(scores):
        return spark.createDataFrame([(f"t{i}", f"n{i}", *([30, 80, 10, 50, 50] if s else [99, 0, 99, 0, 0])) for i, s in enumerate(scores)],
                                     "track_id string, track_name string, energy int, instrumentalness int, speechiness int, acousticness int, valence int"
                                     ).withColumns({c: F.lit(0) for c in ("bpm", "loudness", "danceability", "popularity")})
    assert first_candidates(rows([1, 0, 1, 0, 1, 0]), "study").count() == 3
    assert first_candidates(rows([1, 0, 1, 0, 0, 0]), "study").count() == 6
    taken = spark.createDataFrame([("t0",)], "track_id string")
    assert first_candidates(rows([1, 0, 1, 0, 1, 0]), "study", taken).count() == 5


@pytest.mark.parametrize("meta, labels", [
    ({"classes": ["a", "b"]}, ["a", "b"]), ({"schema": {"classes": [{"name": "x"}]}}, ["x"]), ({"classes": {"names": ["n"]}}, ["n"]),
    ({"model": {"classes": ["m"]}}, ["m"]), ({"annotations": [{"name": "q"}, {"name": "r"}]}, ["q", "r"]),
    ({"classes": [], "annotations": ["z"]}, ["z"]), ({"classes": ["a", {"name": "b"}], "annotations": ["z"]}, ["z"]),
    ({"classes": [1, 2]}, None), ({}, None)])
def test_label_layouts(spark, meta, labels):
    assert one(spark, labels_from_metadata(F.col("m")), m=json.dumps(meta)) == labels


def test_label_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"name": "x", "classes": ["a", "b"]}, indent=2))
    assert [tuple(r) for r in read_labels(spark, str(tmp_path)).collect()] == [("m.json", ["a", "b"])]


def test_pairs_of_lines(spark):
    html = "\n".join(['  <dt style="color:var(--dark-gray);font-size:1.25rem">BPM</dt> ', "<dd>120</dd>", "<dt>Energy</dt>", " <dd>55%</dd>",
                      "<dt>Key</dt>", "<dd>C♯ Minor</dd>", "<dt>Two words</dt>", "<dd>no</dd>", '<dt class="x">Other</dt>', "<dd>no</dd>"])
    pairs = scrape.feature_pairs(spark.createDataFrame([(1, html), (2, "plain")], "page_id long, html string"), "page_id")
    assert sorted((r["name"], r["value"]) for r in pairs.collect()) == [("BPM", "120"), ("Energy", "55"), ("key", "C♯"), ("mode", "Minor")]


def test_the_last_value_of_a_name_holds(spark):
    html = "\n".join(["<dt>Energy</dt>", "<dd>80%</dd>", "<dt>Energy</dt>", "<dd>10%</dd>", "<dt>Tempo</dt>", "<dd>9</dd>", "<dt>Tempo</dt>", "<dd>80</dd>"])
    pairs = scrape.feature_pairs(spark.createDataFrame([(1, html)], "page_id long, html string"), "page_id")
    assert tuple(scrape.feature_rows(pairs, "page_id", ["Energy", "tempo", "mode"]).first()) == (1, "10", "80", None)


def test_matching(spark):
    rows = [("Up-Beat - Ann", 1, None, None, "u1"), ("Up-Beat - Ann", 2, "the up-BEAT mix", "", ""), ("Up-Beat - Ann", 3, "x", "by ANN", "u3"),
            ("Up-Beat - Ann", 4, "up-beat", "", "u4"), ("nodash", 1, "nodash", "nodash", "u5")]
    results = spark.createDataFrame(rows, "query string, source_priority int, title string, description string, url string")
    got = {r["query"]: r["url"] for r in scrape.match_candidates(results.select("query"), results).collect()}
    assert got == {"Up-Beat - Ann": "u3", "nodash": ""}


def test_genres_and_pooling(spark):
    frames = spark.createDataFrame([("t", 0, [0.1, 0.3, 0.15, 0.3]), ("t", 1, [0.1, 0.3, 0.15, 0.3])], "track_id string, frame int, scores array<double>")
    scores = enrich.label_scores(enrich.mean_pool(frames, ["track_id"]), ["track_id"], F.array(*[F.lit(x) for x in "abcd"]))
    got = enrich.genres(scores, ["track_id"], 3).orderBy("genre_order").collect()
    assert [(r["genre"], r["genre_order"]) for r in got] == [("b", 0), ("d", 1), ("c", 2)]
    assert enrich.score_map(scores, ["track_id"]).first()["scores"]["c"] == pytest.approx(0.15)


def test_keys(spark):
    rows = spark.createDataFrame([("Bb", "minor", 0.12345), ("F#", "major", 1.0), ("E", "other", 0.5)], "key string, scale string, strength double")
    got = [(r["key"], r["note"], r["camelot"], r["score"]) for r in enrich.key_enrichment(rows).collect()]
    assert got[1:] == [(6, "F#", "2B", 1.0), (4, "E", "12B", 0.5)] and got[0][:3] == (10, "A#", "3A")


def test_numeric_inference(spark):
    rows = spark.createDataFrame([("1", "1d", "", "x", " "), ("", "2", "", "NaN", "1e3"), ("-.5", "3", "", "1", "0x1F")], "a string, b string, c string, d string, e string")
    got = {r["column_name"]: r["is_numeric"] for r in explore.numeric_columns(rows).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": True}
    assert [r["a"] for r in explore.cast_numeric(rows, ["a"]).collect()] == [1.0, 0.0, -0.5]


def test_axes(spark):
    rows = spark.createDataFrame([(0, 0, 7), (50, 300, 7), (100, 150, 7)], "a int, b int, c int")
    got = explore.axis_normalise(rows, ["a", "b"]).select("a_axis", "b_axis").collect()
    assert [tuple(r) for r in got] == [(-1.0, -1.0), (0.0, 1.0), (1.0, 0.0)]
    flat = spark.createDataFrame([(500,), (500,)], "c int")
    assert [r["c_axis"] for r in explore.axis_normalise(flat, ["c"]).collect()] == [0.0, 0.0]


def test_hull(spark):
    rng = np.random.default_rng(3)
    pts = rng.integers(0, 12, (300, 2)).astype(float)
    rows = spark.createDataFrame([(int(i % 3 == 0), float(x), float(y)) for i, (x, y) in enumerate(pts)], "cluster int, x double, y double")
    got = explore.cluster_hulls(rows.repartition(7), "x", "y").collect()
    for c in (0, 1):
        mine = np.array([p for i, p in enumerate(pts) if int(i % 3 == 0) == c])
        ring = [(r["x"], r["y"]) for r in sorted((r for r in got if r["cluster"] == str(c)), key=lambda r: r["corner"])]
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            side = (bx - ax) * (mine[:, 1] - ay) - (by - ay) * (mine[:, 0] - ax)
            assert (side >= -1e-9).all()  # every point lies left of every edge
        assert set(ring) <= set(map(tuple, mine.tolist()))


def test_hot_join_and_positions(spark):
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    weighted = lookup.join(facts.groupBy("k").agg(F.count("*").alias("weight")), "k")
    for how in ("left", "inner"):
        want = sorted(map(tuple, facts.join(lookup, "k", how).select("id", "k", "v").collect()), key=str)
        for hot_rows in (10, 200, 10_000):
            got = hot_join(facts, weighted, ["k"], how=how, hot_rows=hot_rows).select("id", "k", "v")
            assert sorted(map(tuple, got.collect()), key=str) == want
    placed = global_index(facts.select("id", F.xxhash64("id").alias("h")), ["h"]).orderBy("h").collect()
    assert [r["pos"] for r in placed] == list(range(3000))
