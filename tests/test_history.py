"""The play history against rows made one by one, in the order in which it delivers them."""

from datetime import datetime
from itertools import product

import pytest

from tracklake.operators import views
from tracklake.schemas import TABLES

D1, D2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
ROWS = {
    "track_events": [("t1", D1), ("t1", D2), ("t2", D1), ("t3", D2), ("t4", D1), ("t9", D1), (None, D1), ("t1", None)],
    "tracks": [(t, f"name {t}", a, 1, 10, False, 2, f"u{t}") for t, a in [("t1", "x"), ("t2", "y"), ("t3", "gone"), ("t4", None), ("t5", "x")]],
    "albums": [(a, a.upper(), "album", "2000", 3, f"i{a}", f"u{a}") for a in "xyz"],
    # Two artists share a place on each side, one place is unknown, one artist is not stored.
    "track_artists": [("t1", "a1", 2), ("t1", "a2", 1), ("t1", "a3", 2), ("t1", "a9", None), ("t3", "a1", 0)],
    "album_artists": [("x", "a3", 7), ("x", "a1", 3), ("x", "a2", 7), ("x", "a0", None)],
    "artists": [(a, f"n{a}", f"u{a}") for a in ("a0", "a1", "a2", "a3")],
}


def by_hand(t):
    def credits(bridge, owner):
        found = [(r[2], *a) for r in t[bridge] if r[0] == owner and owner is not None
                 for a in [a for a in t["artists"] if a[0] == r[1]] or [(None, None, None)]]
        return found or [(None, None, None, None)]

    out = []
    for (track_id, at), r in product(t["track_events"], t["tracks"]):
        if track_id is not None and track_id == r[0]:
            sleeves = [a for a in t["albums"] if a[0] == r[2]]
            owners = [(a, o) for a in sleeves for o in credits("album_artists", a[0])] or [((None,) * 7, (None,) * 4)]
            out += [(at, r[0], r[1], *r[3:], *a, *p, *o) for p in credits("track_artists", r[0]) for a, o in owners]
    return out


def sort_key(r):
    return (-(r[0].timestamp()) if r[0] else float("inf"), r[1], -1 if r[15] is None else r[15], -1 if r[19] is None else r[19])


def tables(spark, t):
    return [spark.createDataFrame(t[n], TABLES[n]) for n in ("track_events", "tracks", "albums", "track_artists", "album_artists", "artists")]


@pytest.mark.parametrize("twice, limit", [((), 2), ((), 1000), (("track_artists", "album_artists", "artists"), 1000), (("albums", "track_events"), 1000), (("tracks",), 1000)])
def test_history_and_places(spark, twice, limit):
    t = {n: rows * (1 + (n in twice)) for n, rows in ROWS.items()}
    want = by_hand(t)
    got = [tuple(r) for r in views.play_history(*tables(spark, t), listed_rows=limit).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert [sort_key(r) for r in got] == sorted(map(sort_key, want))
    places = [tuple(r) for r in views.play_history_positions(*tables(spark, t), listed_rows=limit).collect()]
    assert sorted(p[4] for p in places) == list(range(len(want)))
    assert sorted(map(repr, (p[:4] for p in places))) == sorted(repr((r[0], r[1], r[16], r[20])) for r in want)
    order = {(r[0], r[1], r[16], r[20]): sort_key(r) for r in want}
    if not twice:
        assert [order[p[:4]] for p in sorted(places, key=lambda p: p[4])] == sorted(map(sort_key, want))


def test_pairs_are_listed_after_the_last_exchange(spark):
    """Neither the sort nor the numbering moves the pairs of artists."""
    t = dict(ROWS)
    t["track_artists"] = [("t1", f"a{i}", i) for i in range(40)]
    t["album_artists"] = [("x", f"a{i}", i) for i in range(50)]
    t["artists"] = [(f"a{i}", "n", "u") for i in range(50)]
    for frame in (views.play_history(*tables(spark, t)), views.play_history_positions(*tables(spark, t))):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert frame.count() > 6000
        above = plan[:plan.index("Sort [")] if "Sort [" in plan else plan[:plan.index("Window [")]
        assert "Generate inline" in above or "Generate posexplode" in above
        assert above.count("Generate") == 3


def single(t):
    """No place of two artists: the rows of a place differ in the album's artist alone."""
    return t | {"track_artists": [("t1", "a1", 2), ("t1", "a2", 1), ("t1", "a9", None), ("t3", "a1", 0)]}


@pytest.mark.parametrize("twice", [(), ("track_events",), ("album_artists",), ("track_artists",), ("albums",)])
def test_history_with_one_artist_a_place(spark, twice):
    t = {n: rows * (1 + (n in twice)) for n, rows in single(ROWS).items()}
    want = by_hand(t)
    got = [tuple(r) for r in views.play_history(*tables(spark, t)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert [sort_key(r) for r in got] == sorted(map(sort_key, want))


def test_last_list_holds_the_owners_alone(spark):
    """What a play's rows share is not listed for every pair."""
    plan = views.play_history(*tables(spark, single(ROWS)))._jdf.queryExecution().optimizedPlan().toString()
    last = plan[plan.index("Generate inline"):].split("\n")[0]
    made = last[last.rindex("["):]
    assert "album_artist_id" in made and "album_name" not in made and "track_artist_id" not in made
