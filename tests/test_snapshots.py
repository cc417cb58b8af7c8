"""Snapshot tables: atomic publication, buckets, versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracklake.operators import enrich, search
from tracklake.operators.ingest import append_new, fill_stored
from tracklake.plans import registry, search_queries  # noqa: F401  (it registers its queries)
from tracklake.session import settle
from tracklake.sources import index_store
from tracklake.sources.cell_index import CellIndex, write_cells
from tracklake.sources.library import ParquetLibrary, StarLibrary
from tracklake.sources.snapshots import Conflict, SnapshotTable

SCHEMA = "id string, a int, b int"


@pytest.fixture()
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "t"), StructType.fromDDL(SCHEMA), ["id"], buckets=8)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(df):
    return sorted(tuple(r) for r in df.collect())


def merge(old, batch):
    return old.unionByName(batch).groupBy("id").agg(F.max("a").alias("a"), F.max("b").alias("b"))


def test_snapshots_follow_one_another(spark, table):
    assert table.version() == 0 and table.read().count() == 0 and table.rows() == 0
    assert table.append(frame(spark, [(f"k{i}", i, None) for i in range(40)])) == 1
    assert table.append(frame(spark, [])) == 1 and table.rows() == 40  # nothing new, no snapshot
    assert table.append(frame(spark, [("x", 1, 1)])) == 2
    assert table.read(version=1).count() == 40 and table.read().count() == table.rows() == 41
    assert content(table.read(table.buckets_of(frame(spark, [("x", 0, 0)]))).filter("id = 'x'")) == [("x", 1, 1)]


def test_only_touched_buckets_are_written_anew(spark, table):
    table.append(frame(spark, [(f"k{i}", i, None) for i in range(40)]))
    before, batch = {p["bucket"]: p["folder"] for p in table.parts()}, frame(spark, [("k3", 0, 7)])
    touched = table.buckets_of(batch)
    table.rewrite(batch, merge)
    after = {p["bucket"]: p["folder"] for p in table.parts()}
    assert len(touched) == 1 and {b for b in before if before[b] != after[b]} == touched
    assert content(table.read()) == sorted((f"k{i}", i, 7 if i == 3 else None) for i in range(40))


def test_a_killed_writer_leaves_the_old_snapshot(spark, table, monkeypatch):
    table.append(frame(spark, [("a", 1, None), ("b", 2, None)]))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(SnapshotTable, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        table.rewrite(frame(spark, [("a", 9, 9), ("b", 9, 9)]), merge)
    monkeypatch.undo()
    assert table.version() == 1 and content(table.read()) == [("a", 1, None), ("b", 2, None)]
    assert table.rewrite(frame(spark, [("a", 9, 9)]), merge) == 2


def test_two_writers_do_not_publish_the_same_snapshot(spark, table):
    table.append(frame(spark, [("a", 1, None)]))
    table.append(frame(spark, [("b", 1, None)]), after=1)
    with pytest.raises(Conflict):
        table.append(frame(spark, [("c", 1, None)]), after=1)
    assert content(table.read()) == [("a", 1, None), ("b", 1, None)]


def test_an_index_is_fresh_by_number(spark, tmp_path):
    tables, path = str(tmp_path / "tables"), str(tmp_path / "index")
    row = "x.*, 0 AS page_no, 0 AS item_pos, 0 AS source_rank, 0 AS pos"
    features = spark.sql(f"SELECT {row} FROM (SELECT concat('t', id) AS track_id, CAST(id AS INT) AS bpm, 'C' AS key, 'major' AS mode, '8B' AS camelot, 1 AS popularity, "
                         "2 AS loudness, 3 AS acousticness, 4 AS danceability, 5 AS energy, 6 AS instrumentalness, 7 AS liveness, 8 AS speechiness, CASE WHEN id > 0 THEN 5 END AS valence FROM range(30)) x")
    append_new(spark, tables, "track_features", features, reject_nulls=False)
    stored = ParquetLibrary(spark, tables)

    def view():
        return stored.track_features.withColumns({c: F.lit("x") for c in ("track_name", "album_name", "album_image_url", "artist_names")})

    def unread():
        raise AssertionError("a fresh index needs no rows")

    index_store.ensure_index(spark, path, view, stored.version("track_features"))
    index_store.ensure_index(spark, path, unread, stored.version("track_features"))
    fill_stored(spark, tables, "track_features", features.filter("track_id = 't0'").withColumn("valence", F.lit(3)))
    assert not index_store.is_current(spark, path, version=stored.version("track_features"))
    assert stored.track_features.filter("valence = 3").count() == 1 and stored.track_features.count() == 30
    assert index_store.ensure_index(spark, path, view, stored.version("track_features"))[0].count() == 30


def test_cells_give_the_rows_of_a_full_scan(spark, tmp_path):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 1, (40, 8))
    x = middles[rng.integers(0, 40, 4_000)] + rng.normal(0, 0.1, (4_000, 8))
    x = np.concatenate([x, x[:300]])  # copies: ties
    x /= np.sqrt((x ** 2).sum(1))[:, None]
    index = spark.createDataFrame([(f"t{i:04d}", "n", "a", "b", "u", [float(v) for v in row]) for i, row in enumerate(x)],
                                  "track_id string, track_name string, artist_names string, album_name string, album_image_url string, vector array<double>")
    index = settle(index)
    assert write_cells(index, str(tmp_path / "c"), cell_rows=64) == math.ceil(4_300 / 64)
    cells, read = CellIndex(spark, str(tmp_path / "c")), []
    for i in (0, 7, 1_234, 4_299):
        found = cells.search_by_track_id(f"t{i:04d}", 12)
        want = search.search_by_track_id(index, f"t{i:04d}", 12)
        assert [tuple(r) for r in found.rows.orderBy("rank").collect()] == [tuple(r) for r in want.orderBy("rank").collect()]
        read.append(found.cells_read / found.cells)
    assert sum(read) / len(read) < 0.5
    with pytest.raises(ValueError):
        cells.search_by_track_id("none")
    write_cells(settle(index.limit(0)), str(tmp_path / "e"))
    assert CellIndex(spark, str(tmp_path / "e")).search([1.0] * 8).rows.count() == 0


def test_frames_with_gaps_and_of_different_widths(spark):
    frames = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, None]), ("a", [5.0]), ("b", None), ("b", [None]), ("c", [])], "k string, scores array<double>")
    got = sorted(tuple(r) for r in enrich.mean_pool(frames, ["k"]).collect())
    assert got == [("a", 0, 3.0), ("a", 1, 2.0), ("b", 0, None)]


def test_an_index_over_snapshots_joins_its_view_once(spark, monkeypatch, tmp_path):
    parts = spark.range(1, 40).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "concat('Brand#', 1 + id % 3) AS p_brand",
                                          "'TIN' AS p_type", "CAST(id % 40 AS INT) AS p_size")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("SELECT 1L AS s_suppkey, 'one' AS s_name, 0 AS s_nationkey, -1.0D AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    parts.selectExpr("p_partkey AS l_partkey", "1L AS l_suppkey", "p_partkey AS l_orderkey", "CAST(41 + p_partkey % 9 AS DOUBLE) AS l_quantity", "0.05D AS l_discount",
                     "0.02D AS l_tax", "IF(p_partkey % 2 = 0, 'R', 'N') AS l_returnflag", "'O' AS l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    scans, plans, scan, build = [], [], StarLibrary._scan, index_store.build
    monkeypatch.setattr(StarLibrary, "_scan", lambda self, name: scans.append(name) or scan(self, name))
    monkeypatch.setattr(index_store, "build", lambda spark, path, view, *a, **k: plans.append(view._jdf.queryExecution().optimizedPlan().toString())
                        or build(spark, path, view, *a, **k))
    rows = {r["step"]: (r["n"], r["current"]) for r in registry.QUERIES["index_freshness"](spark, str(tmp_path)).collect()}
    assert rows == {"built": (39, True), "nothing new": (39, True), "without valence": (3, True), "valence filled": (39, False), "built again": (39, True), "filled": (0, True)}
    assert scans.count("track_features") == 1
    assert len(plans) == 2 and not any("Join" in plan for plan in plans)
