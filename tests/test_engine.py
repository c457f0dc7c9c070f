import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from readlog import schemas
from readlog.functions import similarity, text
from readlog.operators import curate, documents, duplicates, identity, ingest, library, sync
from readlog.plans import catalog
from readlog.sources import store
from readlog.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def one(spark, values, f, schema="v string"):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def registry(spark, rows):
    """(slug, pointer, deleted)"""
    return spark.createDataFrame([(i, s, i, p, at(0) if d else None) for i, (s, p, d) in enumerate(rows)], "id long, slug string, created_ord long, merged_into_slug string, deleted_at timestamp")


LOG = "id long, series_id long, chapter_label string, source_url string, source_domain string, read_at timestamp"


def log(spark, rows):
    """(series_id, label, site, minutes)"""
    return spark.createDataFrame([(i, s, label, f"https://{site}/{i}", site, at(m)) for i, (s, label, site, m) in enumerate(rows)], LOG)


def test_slug(spark):
    cases = {"Shingeki nó Kyojín": "shingeki-no-kyojin", "One Piece-manhwa-novel": "one-piece", "Manga": "manga", "": "", "   ": "", "!@# $%^": "unknown-title", "- foo": "-foo", "-manga": "unknown-title", None: "", "Ünïcödé – 日本": "unicode-"}
    got = one(spark, list(cases), text.slug)
    assert dict(zip(cases, got, strict=True)) == cases | {"Ünïcödé – 日本": got[-1]} and got[-1].startswith("unicode")


def test_chapters(spark):
    cases = {"Ch. 01": 1.0, "Cap. 130.5": 130.5, "Capítulo Especial": None, "1,5": 1.0, "-5": 5.0, None: None}
    assert one(spark, list(cases), text.chapter_number) == list(cases.values())


def test_series_keys(spark):
    cases = {"https://Sitio-A.com/manga/Dragona/": "sitio-a.com/manga/dragona", "https://a.com": None, "https://a.com/": None, "not-a-url": None, "javascript:alert(1)": None, "http://u:p@a.com:80/x/?q#h": "a.com/x", None: None}
    assert one(spark, list(cases), text.series_key) == list(cases.values())
    assert one(spark, ["https://WWW.A.com:8080/x", "mailto:x", None], text.domain) == ["www.a.com", "", None]


def test_site_rules(spark):
    urls = ["https://manhwaweb.com/leer/abc-temporada-2_1700000000000-12", "https://www.manhwaweb.com/leer/abc-temporada-2_1700000000000-12.5_2/", "https://olympusxyz.com/capitulo/1/comic-x-20260716-110408156", "https://m.olympusxyz.com/capitulo/1/comic-x", "https://other.com/leer/abc_1700000000000-1"]
    got = one(spark, urls, lambda u: text.series_key(text.site_series_url(u)))
    assert got == ["manhwaweb.com/leer/abc-temporada-2_1700000000000"] * 2 + ["olympusxyz.com/comic-x", None, None]


def test_site_names(spark):
    rows = spark.createDataFrame([("LectorXD.com", "https://lectorxd.com/a", True), ("LectorXD", "https://lectorxd.com/a", False), ("!!!", "https://!!!/x", False), ("A", "bad", False)], "t string, u string, want boolean")
    assert rows.filter(text.site_name_title(F.col("t"), F.col("u")) != F.col("want")).count() == 0


def test_tags_and_status(spark):
    cases = {'["shonen","favs"]': ["shonen", "favs"], '["ok",7,null]': ["ok"], "{bad": [], "{}": [], "": [], None: []}
    assert one(spark, list(cases), text.tags) == list(cases.values())
    assert one(spark, ["completed", "banana", None], text.status) == ["completed", "reading", "reading"]


def chain(n):
    return [(f"c{i}", f"c{i + 1}" if i < n else None, False) for i in range(n + 1)]


def test_canonical_resolution(spark):
    rows = [("a", None, False), ("b", "a", False), ("c", "b", False), ("d", "gone", False), ("x", "y", False), ("y", "x", False), ("t", "x", False), ("self", "self", False)]
    got = {r[0]: r[1] for r in identity.resolve_canonical(registry(spark, rows)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "x": "x", "y": "y", "t": "t", "self": "self"}
    for n, end in ((15, "c15"), (16, "c0"), (17, "c0")):
        assert {r[0]: r[1] for r in identity.resolve_canonical(registry(spark, chain(n))).collect()}["c0"] == end


def test_library_projection(spark):
    r = registry(spark, [("a", None, False), ("b", "a", False), ("gone", None, True), ("empty", None, False)])
    events = log(spark, [(0, "Cap. 10", "one.com", 1), (0, "Cap. 12", "one.com", 2), (1, "Cap. 1", "two.com", 3), (1, "Cap. 12", "two.com", 4), (2, "Cap. 1", "one.com", 5), (0, "Special", "one.com", 6)])
    rows = library.library(r, events).collect()
    assert [x["slug"] for x in rows] == ["a", "empty"]
    a = rows[0]
    assert (a["reached_number"], a["reached_label"], a["last_label"], a["read_count"], a["source_domains"], a["alias_count"]) == (12.0, "Cap. 12", "Special", 4, ["one.com", "two.com"], 1)
    assert [x["slug"] for x in library.library(r, events, domain="two.com").collect()] == ["a"]
    assert library.library(r, events, since="2024-01-02").collect() == []
    history = {x["chapter_label"]: (x["source_domain"], x["also_read_on"]) for x in library.history(r, events).collect()}
    assert history == {"Cap. 10": ("one.com", []), "Cap. 12": ("one.com", ["two.com"]), "Cap. 1": ("two.com", []), "Special": ("one.com", [])}


GOLDEN = [
    ("callate-dragona-malvada-ya-no-quiero-criar-hijos-contigo", "callate-malvado-dragon-ya-no-quiero-criar-hijos-contigo", 0.959398, ["tokens"], False),
    ("solo-leveling", "solo-levelling", 0.928571, ["edit-distance"], False), ("solo-leveling", "solo-leveling-ragnarok", 0.75, ["tokens", "containment"], False), ("dr-stone", "dr-stone-2", 0.933333, ["tokens", "containment"], True),
    ("tower-of-god", "tower-of-god-season-2", 0.740741, ["tokens", "containment"], True), ("one-piece", "berserk", 0.222222, ["edit-distance"], False), ("", "one-piece", 0.0, ["edit-distance"], False), ("same-title", "same-title", 1.0, ["tokens"], False),
]


def test_title_similarity(spark):
    for flip in (False, True):
        rows = spark.createDataFrame([(i, *((b, a) if flip else (a, b))) for i, (a, b, *_) in enumerate(GOLDEN)], "i int, slug_a string, slug_b string")
        got = similarity.with_similarity(rows).orderBy("i").collect()
        assert [(round(x["score"], 6), x["reasons"], x["sequel"]) for x in got] == [tuple(g[2:]) for g in GOLDEN]


def test_blocking_loses_no_pair(spark):
    r = random.Random(8)
    vocabulary = ["solo", "leveling", "dragon", "dragona", "tower", "god", "of", "the", "malvada", "malvado", "season", "reincarnation", "reincarnacion", "king", "x", "ii"]
    slugs = sorted({"-".join(r.choice(vocabulary) for _ in range(r.randint(1, 5))) for _ in range(150)})
    df = spark.createDataFrame([(s,) for s in slugs], "slug string")
    every = df.join(df.select(F.col("slug").alias("slug_b")), F.col("slug") < F.col("slug_b")).withColumnRenamed("slug", "slug_a")
    for least in (schemas.SUGGEST_SCORE, schemas.AUTO_MERGE_SCORE):
        want = {(x[0], x[1]) for x in similarity.with_similarity(every).filter(F.col("score") >= least).select("slug_a", "slug_b").collect()}
        assert {(x[0], x[1]) for x in duplicates.title_pairs(df, least).select("slug_a", "slug_b").collect()} == want
        assert want


def titled(spark, tmp_path, texts):
    folder = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    pages = [(i, f"<html><head><title>{t}</title></head></html>") for i, t in enumerate(texts)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def test_sequel_flags_take_whole_titles(spark, tmp_path):
    long = " ".join(f"w{i % 90}" for i in range(400))
    d = titled(spark, tmp_path, [long, long[:70], "One Piece", "ab", "x\nsecond line", ""])
    got = {x["slug_a"]: x["sequel"] for x in catalog.sequel_flags(spark, d).collect()}
    assert got == dict.fromkeys([long.replace(" ", "-"), long[:70].strip().replace(" ", "-"), "one-piece", "ab", "x"], True)


def test_confident_matches_of_short_titles(spark, tmp_path):
    slugs = ["abcdefghijkl", "solo-leveling", "berserk", "ab", "dr-stone-world", "dr-stone-worldd"]
    d = titled(spark, tmp_path, slugs)
    new = sorted({x + x[-1] for x in slugs} - set(slugs))
    every = spark.createDataFrame([(a, b) for a in new for b in slugs], "slug_a string, slug_b string")
    hits = similarity.with_similarity(every).filter((F.col("score") >= schemas.AUTO_MERGE_SCORE) & ~F.col("sequel")).collect()
    want = {a: max(x["score"] for x in hits if x["slug_a"] == a) for a in {x["slug_a"] for x in hits}}
    got = {x["slug"]: x["canonical_slug"] for x in catalog.confident_matches(spark, d).collect()}
    assert set(got) == set(want) and {"abcdefghijkll", "solo-levelingg"} <= set(got)
    assert all((a, b, want[a]) in {(x["slug_a"], x["slug_b"], x["score"]) for x in hits} for a, b in got.items())


def test_duplicates_with_covers_and_dismissals(spark):
    rows = spark.createDataFrame([("solo-leveling", "u"), ("solo-levelling", None), ("berserk", "u"), ("one-piece", None)], "slug string, cover_url string")
    got = [(x["slug_a"], x["slug_b"], x["reasons"]) for x in duplicates.duplicates(rows).collect()]
    assert got == [("berserk", "solo-leveling", ["cover"]), ("solo-leveling", "solo-levelling", ["edit-distance"])]
    out = spark.createDataFrame([("solo-leveling", "berserk")], "slug_a string, slug_b string")
    assert [x["slug_b"] for x in duplicates.duplicates(rows, out).collect()] == ["solo-levelling"]


def test_ingest(spark):
    r = registry(spark, [("solo-leveling", None, False), ("old", None, True)]).withColumn("cover_url", F.lit(None).cast("string"))
    events = log(spark, [(0, "Cap. 1", "a.com", 1)]).withColumn("series_key", F.lit("a.com/solo"))
    reports = spark.createDataFrame(
        [
            (1, "Solo Leveling", "Chapter 1", "https://a.com/1", None, None, at(10)), (2, "Solo Leveling", "Chapter 2", "https://a.com/2", "https://img/1", None, at(11)), (3, "Other name", "Chapter 2", "https://b.com/2", "https://img/2", "https://a.com/solo", at(12)),
            (4, "Solo Levelling", "Chapter 3", "https://c.com/2", None, None, at(13)), (5, "Old", "Chapter 9", "https://c.com/9", None, None, at(14)), (6, " ", "x", "https://c.com/9", None, None, at(15)), (7, "Brand New", "Extra", "https://c.com/9", None, None, at(16)),
        ],
        "report_id long, manga_name string, chapter_label string, source_url string, cover_url string, series_url string, read_at timestamp",
    )
    out = ingest.ingest(reports, r, events)
    assert sorted((x["report_id"], x["target"], x["via"], x["created"]) for x in out["outcomes"].collect()) == [
        (1, "solo-leveling", "slug", False), (2, "solo-leveling", "slug", True), (3, "solo-leveling", "key", False), (4, "solo-leveling", "title", True), (5, "old", "slug", True), (7, "brand-new", "new", True),
    ]
    assert sorted((x["slug"], x["canonical_name"], x["merged_into_slug"]) for x in out["new_series"].collect()) == [("brand-new", "Brand New", None), ("solo-levelling", "Solo Levelling", "solo-leveling")]
    assert [tuple(x) for x in out["covers"].collect()] == [("solo-leveling", "https://img/1", 2, at(11))]
    assert [x[0] for x in out["revived"].collect()] == ["old"]
    assert out["appended"].count() == 4
    told = {x["report_id"]: x for x in out["outcomes"].collect()}
    assert {k for k, x in told.items() if x["cover_changed"]} == {2} and {k for k, x in told.items() if x["revived"]} == {5} and {k for k, x in told.items() if x["changed"]} == {2, 4, 5, 7}
    assert told[1]["event_id"] == "0" and told[3]["event_id"] == told[2]["event_id"] != told[4]["event_id"] and told[1]["series_id"] == "0"
    assert sorted(x["report_id"] for x in streams.change_feed(out["outcomes"]).collect()) == [2, 4, 5, 7]


def test_state_after_ingestion(spark):
    r = registry(spark, [("a-title", None, False), ("old-title", None, True)]).withColumns({"cover_url": F.lit(None).cast("string"), "cover_version": F.lit(3), "updated_at": F.lit(at(0)).cast("timestamp"), "canonical_name": F.lit("x")})
    events = log(spark, [(0, "Cap. 1", "a.com", 1)]).withColumn("series_key", F.lit(None).cast("string"))
    rows = [(1, "A Title", "Cap. 2", "https://a.com/2", "https://img/1", None, at(5)), (2, "Old Title", "Cap. 1", "https://a.com/3", None, None, at(6)), (3, "Unheard Of", "Cap. 1", "https://a.com/4", "https://img/2", None, at(7))]
    result = ingest.ingest(spark.createDataFrame(rows, REPORTS), r, events)
    after, log_after = ingest.applied(r, events, result)
    got = {x["slug"]: (x["canonical_name"], x["cover_url"], x["cover_version"], x["updated_at"], x["deleted_at"]) for x in after.collect()}
    assert got == {"a-title": ("x", "https://img/1", 4, at(5), None), "old-title": ("x", None, 3, at(6), None), "unheard-of": ("Unheard Of", "https://img/2", 1, at(7), None)}
    assert log_after.count() == 4
    again = ingest.ingest(spark.createDataFrame(rows, REPORTS), after, log_after)["outcomes"]
    assert again.filter("changed").count() == 0 and {x["event_id"] for x in again.collect()} == {x["id"] for x in result["appended"].collect()}


REPORTS = "report_id long, manga_name string, chapter_label string, source_url string, cover_url string, series_url string, read_at timestamp"


def ordered_batch(spark):
    """Reports of which most depend on earlier ones, the registry and log before them, and what they leave one by one."""
    r = registry(spark, [("solo-leveling", None, False), ("forgotten-tales", None, True)]).withColumn("cover_url", F.lit(None).cast("string"))
    events = log(spark, [(0, "Cap. 1", "a.com", 1)]).withColumn("series_key", F.lit("a.com/solo"))
    x, y = "https://x.com/foo", "https://a.com/solo"
    rows = [
        ("Brand New Title", 1, None, "brand-new-title", "new", True), ("Brand New Titlee", 1, None, "brand-new-title", "title", False), ("Brand New Titlee", 2, None, "brand-new-title", "slug", True),
        ("Foo Bar", 1, x, "foo-bar", "new", True), ("Nothing Alike", 2, x, "foo-bar", "key", True), ("Nothing Alike", 3, None, "nothing-alike", "new", True), ("Nothing Alikee", 3, None, "nothing-alike", "title", False),
        ("Forgotten Taless", 1, None, "forgotten-taless", "new", True), ("Forgotten Tales", 1, None, "forgotten-tales", "slug", True), ("Forgottenn Tales", 2, None, "forgotten-tales", "title", True),
        ("Foo Bar", 1, y, "solo-leveling", "key", False), ("Foo Bar", 4, None, "foo-bar", "slug", True),
    ]
    reports = spark.createDataFrame([(i, n, f"Cap. {c}", f"https://a.com/{i}", None, u, at(10 + i)) for i, (n, c, u, *_) in enumerate(rows)], REPORTS)
    return reports, r, events, [(i, *row[3:]) for i, row in enumerate(rows)]


def test_batch_equals_one_by_one(spark):
    reports, r, events, want = ordered_batch(spark)
    out = ingest.ingest(reports, r, events)
    assert sorted((x["report_id"], x["target"], x["via"], x["created"]) for x in out["outcomes"].collect()) == want
    assert out["new_series"].filter("slug = 'nothing-alikee'").first()["merged_into_slug"] == "nothing-alike"


def test_curation(spark):
    r = registry(spark, [("a", None, False), ("b", "a", False), ("c", None, True), ("d", None, False)]).withColumn("updated_at", F.lit(at(0)).cast("timestamp"))
    now = F.lit(at(9)).cast("timestamp")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    gone = {x["slug"]: (x["deleted_at"] is not None, x["updated_at"]) for x in curate.apply_deletes(r, ids(1, 99), now).collect()}
    assert gone == {"a": (True, at(9)), "b": (True, at(9)), "c": (True, at(0)), "d": (False, at(0))}
    merged = {x["slug"]: (x["merged_into_slug"], x["deleted_at"], x["updated_at"]) for x in curate.apply_merges(r, spark.createDataFrame([(2, 1)], "survivor long, absorbed long"), now).collect()}
    assert merged == {"a": ("c", None, at(9)), "b": ("c", None, at(9)), "c": (None, None, at(9)), "d": (None, None, at(0))}
    unmerged = {x["slug"]: (x["merged_into_slug"], x["was_merged"], x["updated_at"]) for x in curate.apply_unmerges(r, ids(1, 3), now).collect()}
    assert unmerged == {"a": (None, None, at(0)), "b": (None, True, at(9)), "c": (None, None, at(0)), "d": (None, False, at(0))}
    covers = spark.createDataFrame([("a", b"x", "image/png"), ("b", b"", "image/png"), ("c", b"x", "text/html"), ("d", None, None)], "slug string, data binary, content_type string")
    assert [x["error"] for x in curate.check_covers(covers).orderBy("slug").collect()] == [None, "empty", "type", "type"]


def test_merges_in_sequence(spark):
    """Against merges applied one by one."""
    r = random.Random(4)
    for trial in range(2):
        n = 14
        rows = [{"slug": f"s{i}", "to": None, "dead": r.random() < 0.3, "cover": f"u{i}" if r.random() < 0.4 else None, "version": 0, "tags": [f"t{i % 3}", f"x{i}"]} for i in range(n)]
        rows[3]["to"] = "s2"
        frame = spark.createDataFrame([(i, x["slug"], i, x["to"], at(0) if x["dead"] else None, x["cover"], 0, x["tags"]) for i, x in enumerate(rows)], "id long, slug string, created_ord long, merged_into_slug string, deleted_at timestamp, cover_url string, cover_version int, tags array<string>")
        merges = [(r.randrange(n), r.randrange(n), k) for k in range(9)]
        by = {x["slug"]: x for x in rows}
        top = lambda x: x if x["to"] is None else top(by[x["to"]])  # noqa: B023, E731
        for s, a, _ in merges:
            keep, gone = top(rows[s]), top(rows[a])
            if keep is gone:
                continue
            for x in [x for x in rows if top(x) is gone]:
                x["to"] = keep["slug"]
            if keep["cover"] is None and gone["cover"] is not None:
                keep["cover"], keep["version"] = gone["cover"], keep["version"] + 1
            keep["tags"] = list(dict.fromkeys(keep["tags"] + gone["tags"]))
            keep["dead"] = keep["dead"] and gone["dead"]
        got = curate.apply_merges(frame, spark.createDataFrame(merges, "survivor long, absorbed long, seq long"), F.lit(at(9)).cast("timestamp")).orderBy("id").collect()
        assert [(x["slug"], x["merged_into_slug"], x["deleted_at"] is not None, x["cover_url"], x["cover_version"], x["tags"]) for x in got] == [(x["slug"], x["to"], x["dead"], x["cover"], x["version"], x["tags"]) for x in rows], trial


def greedy(a, b):
    """(score, token score, sequel) of two slugs, pair by pair."""
    from readlog.schemas import SEQUEL_MARKERS, TOKEN_MATCH

    def edit(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return 1 - row[-1] / max(len(x), len(y)) if x or y else 1.0

    ta, tb = ([t for t in x.split("-") if t] for x in (a, b))
    if a == b:
        return 1.0, None, False
    if not ta or not tb:
        return edit(a, b), 0.0, False
    ranked = sorted((-edit(x, y), *sorted((x, y)), i, j) for i, x in enumerate(ta) for j, y in enumerate(tb) if edit(x, y) >= TOKEN_MATCH)
    used_a, used_b, weight = set(), set(), 0.0
    for o, _, _, i, j in ranked:
        if i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            weight -= o * (len(ta[i]) + len(tb[j])) / 2
    token = 2 * weight / (sum(map(len, ta)) + sum(map(len, tb)))
    rest = [t for i, t in enumerate(ta) if i not in used_a] + [t for j, t in enumerate(tb) if j not in used_b]
    return max(token, edit(a, b)), token, any(t in SEQUEL_MARKERS for t in rest)


def test_title_scores_are_those_of_a_greedy_model(spark):
    r = random.Random(12)
    vocabulary = ["solo", "leveling", "levelling", "season", "2", "ii", "dragon", "dragons", "dragoon", "origin", "origins", "a", "the", "kingdom", "kingdoms"]
    slugs = ["-".join(r.choice(vocabulary) for _ in range(r.randint(1, 5))) for _ in range(60)] + ["-", "a-"]
    pairs = [(r.choice(slugs), r.choice(slugs)) for _ in range(400)]
    rows = similarity.with_similarity(spark.createDataFrame(pairs, "slug_a string, slug_b string")).collect()
    assert len(rows) == len(pairs)
    for x in rows:
        score, token, sequel = greedy(x["slug_a"], x["slug_b"])
        assert x["score"] == pytest.approx(score) and x["sequel"] == sequel, (x["slug_a"], x["slug_b"])
        assert token is None or x["token_score"] == pytest.approx(token)


def test_restore_and_slugs_of_events(spark):
    series = spark.createDataFrame([("7", "x", "their x", 5), ("8", "y", "their y", 1)], "id string, slug string, canonical_name string, updated_at long")
    events = spark.createDataFrame([("e1", "x", "Cap. 1"), ("e2", "gone", "Cap. 2")], "id string, series_slug string, chapter_label string")
    covers = spark.createDataFrame([("x", 2, b"bytes")], "slug string, cover_version int, data binary")
    mine = {"series": spark.createDataFrame([("1", "x", "my x", 9)], series.schema), "events": spark.createDataFrame([("e0", "1", "Cap. 0")], "id string, series_id string, chapter_label string")}
    theirs = {"series": series, "events": events, "covers": covers}
    both = sync.sync(mine, theirs)
    assert {x["slug"]: (x["id"], x["canonical_name"]) for x in both["series"].collect()}["x"] == ("1", "my x")
    assert sorted((x["id"], x["series_id"]) for x in both["events"].collect()) == [("e0", "1"), ("e1", "1")]
    assert [x["slug"] for x in both["push_series"].collect()] == ["x"]
    with pytest.raises(ValueError):
        sync.restore(mine, theirs)
    back = sync.restore(mine, theirs, force=True)
    assert set(back) == {"series", "events", "covers"}
    assert sorted((x["slug"], x["canonical_name"]) for x in back["series"].collect()) == [("x", "their x"), ("y", "their y")]
    assert [x["id"] for x in back["events"].collect()] == ["e1"] and [bytes(x["data"]) for x in back["covers"].collect()] == [b"bytes"]


def test_bursts_over_hours(spark):
    r = random.Random(3)
    times = sorted(T0 + dt.timedelta(seconds=r.choice([r.randrange(0, 4 * 3600), 3600 * r.randrange(1, 4) + r.randrange(-6, 6)])) for _ in range(900))
    want, start, last, n = [], times[0], times[0], 0
    for t in times:
        if (t - last).total_seconds() > 5:
            want.append((start, last + dt.timedelta(seconds=5), n))
            start, n = t, 0
        last, n = t, n + 1
    want.append((start, last + dt.timedelta(seconds=5), n))
    got = streams.collapse_bursts(spark.createDataFrame([(t,) for t in times], "ts timestamp")).collect()
    assert sorted((x["start"], x["end"], x["n"]) for x in got) == want


def test_sync_converges(spark):
    schema = "slug string, status string, updated_at long"
    a = spark.createDataFrame([("x", "a", 1), ("y", "a", 5), ("z", "a", 3)], schema)
    b = spark.createDataFrame([("x", "b", 2), ("y", "b", 4), ("z", "b", 3), ("w", "b", 1), ("", "b", 9)], schema)
    merged = sync.merge_lww(a, b, "slug")
    assert sorted(map(tuple, merged.collect())) == [("w", "b", 1, "inserted"), ("x", "b", 2, "updated"), ("y", "a", 5, "kept"), ("z", "a", 3, "kept")]
    again = sync.merge_lww(merged.drop("moved"), b, "slug")
    assert again.filter("moved <> 'kept'").count() == 0
    assert [x["slug"] for x in sync.push_diff(merged.drop("moved"), b, "slug").collect()] == ["y"]
    with pytest.raises(ValueError):
        sync.restore({"series": a}, {"series": b})
    versions = lambda *rows: spark.createDataFrame(rows, "slug string, cover_version int")
    moves = sync.cover_diff(versions(("a", 1), ("b", 3), ("c", 1)), versions(("a", 2), ("b", 1), ("c", 1), ("d", 1)))
    assert sorted(map(tuple, moves.collect())) == [("a", "pull"), ("b", "push"), ("d", "pull")]


def test_junk_documents(spark):
    doc = '{"_id":"some-slug","canonicalName":42,"tags":["ok",7,null],"coverVersion":"three","status":"banana","createdAt":"not-a-date","deletedAt":"1970-01-01T00:00:00Z"}'
    x = documents.series_docs(spark.createDataFrame([(doc,)], "doc string")).first()
    assert (x["slug"], x["canonical_name"], x["tags"], x["cover_version"], x["status"], x["created_at"], x["deleted_at"]) == ("some-slug", "", ["ok"], 0, "reading", dt.datetime(1970, 1, 1), None)
    bad = spark.createDataFrame([('{"slugA":"a","slugB":"a"}',), ('{"slugA":"a"}',), ('{"slugA":"a","slugB":"b"}',), ("{",)], "doc string")
    assert documents.dismissal_docs(bad).count() == 1
    covers = spark.createDataFrame([('{"_id":"a","data":"aGk="}',), ('{"_id":"b","data":7}',), ('{"_id":"c","data":"%%%"}',)], "doc string")
    assert [(x["slug"], bytes(x["data"])) for x in documents.cover_docs(covers).collect()] == [("a", b"hi")]


def test_store(spark, tmp_path):
    folder = str(tmp_path)
    events = log(spark, [(0, "Cap. 1", "a.com", 1), (0, "Cap. 2", "a.com", 2)])
    store.append_events(events, folder)
    store.append_events(events.unionByName(log(spark, [(0, "x", "a", 0), (0, "x", "a", 0), (1, "Cap. 3", "b.com", 2000)])), folder)
    assert store.read_log(spark, folder).count() == 3
    first = store.write_registry(spark.createDataFrame([("1", "a")], "id string, slug string"), folder)
    store.write_registry(spark.createDataFrame([("1", "a"), ("2", "b")], "id string, slug string"), folder)
    assert store.read_registry(spark, folder).count() == 2 and spark.read.parquet(first).count() == 1


def test_bursts_and_feed(spark):
    rows = spark.createDataFrame([(T0 + dt.timedelta(seconds=s),) for s in (0, 2, 4, 20, 30)], "ts timestamp")
    assert sorted(x["n"] for x in streams.collapse_bursts(rows).collect()) == [1, 1, 3]
    out = spark.createDataFrame([(1, "a", at(1), True, False, False), (2, "a", at(2), False, False, False)], "report_id long, target string, read_at timestamp, created boolean, cover_changed boolean, revived boolean")
    assert [x["report_id"] for x in streams.change_feed(out).collect()] == [1]


def test_entry_and_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _lettered(n: int, seed: int, words: int) -> list[str]:
    """Titles of invented prose, every third close to the one before."""
    draw = random.Random(seed)
    syllables, out = ["the", "an", "tion", "er", "ou", "in", "st", "ed", "ha", "re"], []
    for i in range(n):
        title = "-".join("".join(draw.choices(syllables, k=draw.randint(1, 3))) for _ in range(words))
        if i % 3 == 2:
            title = list(out[-1])
            for _ in range(draw.randint(1, max(1, len(title) // 4))):
                title[draw.randrange(len(title))] = draw.choice("abcé-")
            title = "".join(title)
        out.append(title)
    return out


def test_blocks_find_what_segments_find(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK_STRINGS", 40)
    titles = _lettered(150, 1, 9) + _lettered(60, 2, 1) + ["a", "b", "ab", "x" * 300, "x" * 260 + "y", "漢字" * 40, "漢字" * 39]
    df = spark.createDataFrame([(t,) for t in titles], "slug string")
    for fresh in (None, df.filter("xxhash64(slug) % 3 = 0")):
        want = {tuple(x) for x in duplicates.similar_strings(df, "slug", 0.75, fresh).collect()}
        got = [tuple(x) for x in duplicates.blocked_strings(df, "slug", 0.75, fresh).collect()]
        assert want and set(got) == want and len(got) == len(want)


def test_few_pairs_are_scored(spark):
    """Pairs that share a rare token, but whose matching tokens cannot weigh enough, are not scored."""
    titles = sorted({f"{t}-w{i // 12:03d}" for i, t in enumerate(_lettered(240, 3, 9))})
    df = spark.createDataFrame([(t,) for t in titles], "slug string")
    assert duplicates.candidate_pairs(df, 0.75).count() < 200


def test_known_titles_are_not_matched_with_one_another(spark, monkeypatch):
    scored = []
    monkeypatch.setattr(duplicates, "with_similarity", lambda pairs: scored.append(pairs) or similarity.with_similarity(pairs))
    known = spark.createDataFrame([(f"solo-leveling-{i}",) for i in "abcdef"], "slug string")
    known = known.select("slug", F.col("slug").alias("canonical_slug"), F.lit(1).alias("canonical_ord"), F.lit(0).alias("created_ord"), F.lit(False).alias("is_alias"), F.lit(False).alias("canonical_deleted"))
    new = spark.createDataFrame([("solo-leveling-aa",)], "slug string")
    assert [x["slug"] for x in duplicates.best_confident_match(new, known).collect()] == ["solo-leveling-aa"]
    assert all("solo-leveling-aa" in tuple(x) for x in scored[0].select("slug_a", "slug_b").collect())


def test_long_titles_and_their_sequels(spark):
    """Titles of 300,000 letters, of one word and of 50,000: no step takes a table of all letters or of all pairs of words."""
    titles = ["ab" * 150_000, "-".join(f"w{i:05d}" for i in range(50_000))]
    rows = spark.createDataFrame([(t, t + "-season") for t in [*titles, "a-b-a-a-b", "x"]], "slug_a string, slug_b string")
    began = time.perf_counter()
    got = similarity.with_similarity(rows).select(F.length("slug_a").alias("n"), "edit", "token_score", "sequel").orderBy("n").collect()
    assert time.perf_counter() - began < 30
    assert [(x["n"], x["sequel"]) for x in got] == [(1, True), (9, True), (300_000, True), (349_999, True)]
    assert [round(x["edit"], 9) for x in got] == [round(1 - 7 / (x["n"] + 7), 9) for x in got]
    words = [1, 5, 300_000, 300_000]
    assert [round(x["token_score"], 9) for x in got] == [round(2 * w / (2 * w + 6), 9) for w in words]


def test_plan_of_prepared_reports_is_small(spark):
    """The driver holds and compiles each plan; one that repeats the URL's expressions in one another grew it by hundreds of MB."""
    rows = ingest.prepared(ingest.named(spark.createDataFrame([("r", "T", "Cap. 1", "https://a.example.com/t/1", None, "HTTPS://A.example.com:443/x/../T/", None)], schemas.REPORTS)))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") < 400
    assert rows.first()["series_key"] == "a.example.com/t"
