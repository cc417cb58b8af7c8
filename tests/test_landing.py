"""Landed pages: compressed, their items in the order of lines."""

from datetime import datetime

from tracklake.plans.library_queries import _land
from tracklake.sources.library import StarLibrary
from tracklake.sources.pages import read_pages


def test_landed_pages_are_compressed_and_in_order(spark, tmp_path):
    star, at = tmp_path / "star", datetime(2024, 1, 2)
    made = {
        "part": ([(1, "one", "Brand#1", "TIN", 3), (2, "two", "Brand#2", "TIN", 46), (10, "ten", "Brand#1", "TIN", 1)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "supplier": ([(5, "s5")], "s_suppkey long, s_name string"),
        "orders": ([(3, 7), (4, 8)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(3, 2, 5, 1, at, "N"), (3, 10, 5, 1, at, "N"), (3, 1, 5, 4, at, "R"), (4, 1, 5, 1, at, "N")],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp, l_returnflag string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{star}/{name}.parquet")
    folder = tmp_path / "landed"
    for round_no in (1, 2):
        _land(StarLibrary(spark, str(star)), str(folder), round_no)
    files = [f for f in folder.rglob("part-*") if f.is_file()]
    assert len(files) == 7 and all(f.name.endswith(".gz") for f in files)

    def tracks(kind):
        pages = read_pages(spark, str(folder / kind / "round=2"), kind).collect()
        return sorted([(e["item"] if kind == "playlist_items" else e["track"])["id"], (e["item"] if kind == "playlist_items" else e["track"])["name"]] for p in pages for e in p["items"])

    played = read_pages(spark, str(folder / "played" / "round=2"), "played").first()["items"]
    assert [(i["track"]["id"], i["track"]["name"]) for i in played] == [("t10", "ten r2"), ("t2", None), ("t1", "one r2"), ("t1", "one r2")]
    assert {(i["track"]["track_number"], i["track"]["artists"][0]["id"], i["played_at"]) for i in played} == {
        (s, "ar5", "2024-01-02T00:00:00Z") for s in (1, 46, 3)}
    assert tracks("playlist_items") == [["t10", "ten r2"], ["t2", None]]
