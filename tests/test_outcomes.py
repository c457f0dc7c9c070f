import pytest
from pyspark.sql import functions as F

from readlog.operators import curate, duplicates, sync
from readlog.streaming import streams
from tests.test_engine import at, registry


def stamp():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


def rows_of(frame):
    return sorted(map(tuple, frame.select(sorted(frame.columns)).collect()), key=str)


def replica(spark, series, events, covers, kind="long"):
    """Series as (slug, id, version, clock), events as (id, slug or series id), covers as (slug, version, bytes)."""
    made = lambda x: None if x is None else (x if kind == "long" else str(x))
    return {
        "series": spark.createDataFrame([(s, made(i), f"name of {s}", v, t) for s, i, v, t in series], f"slug string, id {kind}, canonical_name string, cover_version int, updated_at long"),
        "events": spark.createDataFrame([(e, s if isinstance(s, str) else made(s)) for e, s in events], "id string, series_slug string" if events and isinstance(events[0][1], str) else f"id string, series_id {kind}"),
        "covers": spark.createDataFrame([(s, v, bytearray(b)) for s, v, b in covers], "slug string, cover_version int, data binary"),
        "dismissals": spark.createDataFrame([("a", "b", at(0), at(0))], "slug_a string, slug_b string, created_at timestamp, updated_at timestamp"),
    }


@pytest.mark.parametrize("kind", ["long", "string"])
def test_sync_moves_all_and_counts_it(spark, kind):
    local = replica(spark, [("a", 1, 1, 5), ("b", 2, 0, 1), ("gone", 3, 2, 9)], [("e1", 1), ("e2", 2)], [("a", 3, b"new a"), ("b", 1, b"old b")], kind)
    remote = replica(spark, [("a", 70, 1, 4), ("b", 1, 4, 2), ("y", 2, 1, 1), ("z", None, 1, 1)], [("e2", "b"), ("e3", "y"), ("e4", "nowhere"), ("", "a")], [("a", 1, b"old a"), ("b", 2, b"new b"), ("y", 1, b"y"), ("gone", 2, b"cleared")], kind)
    remote["covers"] = remote["covers"].filter("slug <> 'gone'")
    counts = sync.Counts()
    out = {k: df.cache() for k, df in sync.sync(local, remote, counts).items()}
    for df in out.values():
        df.count()
    ids = {r.slug: r.id for r in out["series"].collect()}
    assert {k: str(v) for k, v in ids.items() if k in "ab"} == {"a": "1", "b": "2"} and None not in ids.values() and len(set(ids.values())) == 5
    assert rows_of(out["events"]) == sorted([("e1", local["events"].first()[1]), ("e2", ids["b"]), ("e3", ids["y"])], key=str)
    assert {r.slug: bytes(r.data) for r in out["covers"].collect()} == {"a": b"new a", "b": b"new b", "y": b"y"}
    assert [r.slug for r in out["push_covers"].collect()] == ["a"] and out["remove_covers"].collect() == []
    assert counts.result() == {"pulled": {"series": 3, "events": 1, "adapters": 0, "covers": 2, "dismissals": 0}, "pushed": {"series": 2, "events": 1, "adapters": 0, "covers": 1, "dismissals": 0}}

    after = {k: out[k] for k in ("series", "events", "covers", "dismissals")}
    theirs = {  # what the remote has once the pushes are there
        "series": after["series"], "events": remote["events"].filter("id <> ''").unionByName(out["push_events"].select("id", F.lit("a").alias("series_slug"))),
        "covers": remote["covers"].join(out["push_covers"].select("slug"), "slug", "left_anti").unionByName(out["push_covers"]), "dismissals": after["dismissals"],
    }
    again = sync.Counts()
    second = sync.sync(after, theirs, again)
    for df in second.values():
        df.count()
    assert set(n for way in again.result().values() for n in way.values()) == {0}
    assert rows_of(second["series"]) == rows_of(after["series"])


def test_cleared_covers_are_named(spark):
    local = replica(spark, [("a", 1, 2, 5)], [("e1", 1)], [])
    remote = replica(spark, [("a", 1, 2, 5)], [("e1", "a")], [("a", 1, b"old")])
    out = sync.sync({k: local[k] for k in ("series",)} | {"covers": local["covers"]}, remote)
    assert [r.slug for r in out["covers"].collect()] == ["a"]  # bytes that aren't here come back, as their version is unknown here
    assert out["remove_covers"].collect() == []


def test_numbers_that_are_taken_are_made_anew(spark, monkeypatch):
    plain = sync._made_id
    monkeypatch.setattr(sync, "_made_id", lambda slug, kind, attempt: plain(slug, kind, attempt) if attempt > 1 else F.lit(7 + attempt).cast("long"))
    rows = spark.createDataFrame([("a", 7), ("b", None), ("c", None), ("d", None)], "slug string, id long")
    got = {r.slug: r.id for r in sync.with_new_ids(rows, rows).collect()}
    assert got["a"] == 7 and got["b"] == 8 and len(set(got.values())) == 4 and None not in got.values()


def test_outcomes_of_merges_in_their_order(spark):
    r = registry(spark, [("a", None, False), ("b", None, False), ("c", "b", False), ("d", None, True)])
    merges = [(0, 1, 1), (2, 0, 2), (9, 0, 3), (0, 8, 4), (3, 2, 5), (1, 3, 6), (9, 8, 7)]
    after, told = curate.merged(r, spark.createDataFrame(merges, "survivor long, absorbed long, seq long"), stamp())
    got = {x.seq: (x.outcome, x.missing) for x in told.collect()}
    assert got == {1: ("merged", None), 2: ("already-merged", None), 3: ("not-found", 9), 4: ("not-found", 8), 5: ("merged", None), 6: ("already-merged", None), 7: ("not-found", 9)}
    assert {x.slug: x.merged_into_slug for x in after.collect()} == {"a": "d", "b": "d", "c": "d", "d": None}
    same, nothing = curate.merged(r, spark.createDataFrame([(0, 0, 1)], "survivor long, absorbed long, seq long"), stamp())
    assert rows_of(same) == rows_of(r) and [x.outcome for x in nothing.collect()] == ["already-merged"]


def test_outcomes_of_deletes_and_unmerges(spark):
    r = registry(spark, [("a", None, False), ("b", "a", False), ("c", None, True)])
    ids = spark.createDataFrame([(1, 1), (0, 2), (2, 3), (9, 4), (1, 5)], "id long, seq long")
    assert {x.seq: x.deleted for x in curate.delete_outcomes(r, ids).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert {x.seq: x.outcome for x in curate.unmerge_outcomes(r, ids).collect()} == {1: "unmerged", 2: "not-merged", 3: "not-merged", 4: "not-found", 5: "not-merged"}


def test_feed_of_any_operator(spark):
    r = registry(spark, [("a", None, False), ("b", "a", False), ("c", None, True)])
    feed = lambda after: {x.slug: x.change for x in streams.snapshot_feed(r, after, "slug").collect()}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert feed(curate.apply_deletes(r, ids(1), stamp())) == {"a": "updated", "b": "updated"}
    assert feed(curate.apply_deletes(r, ids(2, 9), stamp())) == {} == feed(r)
    assert feed(curate.apply_unmerges(r, ids(1, 0), stamp()).drop("was_merged")) == {"b": "updated"}
    assert feed(r.filter("slug <> 'a'").unionByName(r.filter("slug = 'a'").withColumn("slug", F.lit("new")))) == {"a": "deleted", "new": "inserted"}
    moved = r.select("id", "slug", "created_ord", F.when(F.col("slug") == "b", F.lit(None)).otherwise(F.col("merged_into_slug")).alias("merged_into_slug"), "deleted_at")
    assert feed(moved) == {"b": "updated"}


def test_duplicates_of_a_state(spark):
    """Deleted rows are dropped before grouping: an alias of a deleted card stands for itself."""
    r = registry(spark, [("solo-leveling", None, True), ("solo-levelling", "solo-leveling", False), ("solo-levelingg", None, False), ("one-piece", None, False), ("one-piecee", "one-piece", False)])
    pairs = [(x.slug_a, x.slug_b) for x in duplicates.duplicates_of(r).collect()]
    assert pairs == [("solo-levelingg", "solo-levelling")]
    gone = spark.createDataFrame([("solo-levelling", "solo-levelingg")], "slug_a string, slug_b string")
    assert duplicates.duplicates_of(r, gone).collect() == []
