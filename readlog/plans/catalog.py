"""The registered queries, each with the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlog.functions import similarity, text
from readlog.operators import curate, documents, duplicates, identity, ingest, library, profile, sync
from readlog.schemas import MAX_HOPS, SITE_RULES
from readlog.sources import roles, store
from readlog.sources.roles import plain, role
from readlog.sources.store import checkpoint
from readlog.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DOMAIN, SINCE = "view.example.com", "2024-01-29 12:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LOG, REGISTRY, TITLES, SHORT, URLS = (plain(x) for x in (roles.LOG, roles.REGISTRY, roles.TITLES, roles.SHORT_TITLES, roles.URLS))
CARDS, CLICKED, LINES, ADAPTERS = (plain(x) for x in (roles.CARDS, roles.CLICKED, roles.LINES, roles.ADAPTERS))
LOCAL, REMOTE, EVENTS_A, EVENTS_B, COVERS = (plain(x) for x in (roles.LOCAL, roles.REMOTE, roles.EVENTS_A, roles.EVENTS_B, roles.COVERS))


def log(s: SparkSession, d: str) -> DataFrame:
    return role(s, d, roles.LOG)


def registry(s: SparkSession, d: str) -> DataFrame:
    return role(s, d, roles.REGISTRY)


def cards(s: SparkSession, d: str) -> DataFrame:
    return role(s, d, roles.CARDS)


# SQL fragments of the oracle
def sql_slug(c: str) -> str:
    x = rf"trim(regexp_replace(strip_accents(lower({c})), '[^a-z0-9\s-]', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(13))"
    y = rf"regexp_replace(regexp_replace({x}, '[\s-]+', '-', 'g'), '(-(manga|manhwa|manhua|comic|novel))+$', '')"
    return f"CASE WHEN {c} IS NULL OR trim({c}) = '' THEN '' WHEN {y} = '' THEN 'unknown-title' ELSE {y} END"


NUMBER = "TRY_CAST(nullif(regexp_extract(chapter_label, '[0-9]+([.][0-9]+)?', 0), '') AS DOUBLE)"
SQL_DOMAIN = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_URL = r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)"
_HOST, _PATH = f"regexp_extract(url, '{_URL}', 2)", f"regexp_replace(regexp_extract(url, '{_URL}', 3), '/+$', '')"
SQL_KEY = f"CASE WHEN {_HOST} <> '' AND {_PATH} <> '' THEN lower({_HOST} || {_PATH}) END"
CANONICAL = f"""
reg AS ({REGISTRY}),
walk AS (SELECT slug AS start, slug AS at, [slug] AS path, 0 AS hop, CAST(NULL AS VARCHAR) AS result FROM reg
         UNION ALL
         SELECT w.start, coalesce(n.slug, w.at), CASE WHEN n.slug IS NULL THEN w.path ELSE list_append(w.path, n.slug) END, w.hop + 1,
                CASE WHEN n.slug IS NULL THEN w.at WHEN list_contains(w.path, n.slug) THEN w.start WHEN w.hop + 1 = {MAX_HOPS} THEN w.start END
         FROM walk w JOIN reg c ON c.slug = w.at LEFT JOIN reg n ON n.slug = c.merged_into_slug WHERE w.result IS NULL),
canon AS (SELECT start AS slug, result AS canonical_slug FROM walk WHERE result IS NOT NULL),
mem AS (SELECT r.id, r.slug, r.created_ord, c.canonical_slug, k.id AS canonical_id, k.created_ord AS canonical_ord, k.deleted_at IS NOT NULL AS dead, r.slug <> c.canonical_slug AS is_alias
        FROM reg r JOIN canon c USING (slug) JOIN reg k ON k.slug = c.canonical_slug),
ev AS (SELECT l.*, {NUMBER} AS num, CASE WHEN {NUMBER} IS NULL THEN chapter_label END AS txt, m.canonical_slug, m.dead FROM ({LOG}) l JOIN mem m ON m.id = l.series_id)"""
LIBRARY = f"""WITH RECURSIVE {CANONICAL},
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_slug ORDER BY read_at DESC, id DESC) AS rn FROM ev) x WHERE rn = 1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_slug ORDER BY num DESC, read_at DESC, id DESC) AS rn FROM ev WHERE num IS NOT NULL) x WHERE rn = 1),
cnt AS (SELECT canonical_slug, count(DISTINCT coalesce('n' || num, 'l' || txt)) AS n, max(read_at) AS newest, bool_or(source_domain = '{DOMAIN}') AS on_domain FROM ev GROUP BY 1),
dom AS (SELECT canonical_slug, list(source_domain ORDER BY t DESC, source_domain DESC) AS ds FROM (SELECT canonical_slug, source_domain, max(read_at) AS t FROM ev GROUP BY 1, 2) x GROUP BY 1),
ali AS (SELECT canonical_slug, count(*) FILTER (is_alias) AS n FROM mem GROUP BY 1)
SELECT m.slug, top.num AS reached_number, top.chapter_label AS reached_label, last.chapter_label AS last_label, last.read_at AS last_read_at, last.source_url AS last_source_url,
       coalesce(cnt.n, 0) AS read_count, coalesce(dom.ds, []) AS source_domains, ali.n AS alias_count, m.created_ord
FROM mem m LEFT JOIN last USING (canonical_slug) LEFT JOIN top USING (canonical_slug) LEFT JOIN cnt USING (canonical_slug) LEFT JOIN dom USING (canonical_slug) LEFT JOIN ali USING (canonical_slug)
WHERE NOT m.is_alias AND NOT m.dead"""
HISTORY = f"""WITH RECURSIVE {CANONICAL},
d1 AS (SELECT canonical_slug, num, txt, source_domain, min({{'t': read_at, 'i': id, 'l': chapter_label}}) AS f FROM ev WHERE NOT dead GROUP BY 1, 2, 3, 4),
k AS (SELECT canonical_slug, num, txt, min({{'t': f.t, 'i': f.i, 'l': f.l, 'd': source_domain}}) AS k, list(source_domain ORDER BY f.t, f.i) AS ds FROM d1 GROUP BY 1, 2, 3)
SELECT canonical_slug AS slug, k.i AS id, k.l AS chapter_label, num AS chapter_number, k.d AS source_domain, k.t AS read_at, list_filter(ds, lambda x: x <> k.d) AS also_read_on FROM k"""


# conformance
@query(f"SELECT id, {sql_slug('canonical_name')} AS slug FROM ({LINES}) t")
def title_slugs(s: SparkSession, d: str) -> DataFrame:
    return role(s, d, roles.LINES).select("id", text.slug(F.col("canonical_name")).alias("slug"))


def line_slugs(s: SparkSession, d: str) -> DataFrame:
    """Distinct slugs of whole first lines."""
    return title_slugs(s, d).select("slug").filter("slug <> ''").distinct()


def page_slugs(s: SparkSession, d: str) -> DataFrame:
    """Distinct slugs of whole page titles."""
    return role(s, d, roles.TITLES).select(text.slug(F.col("canonical_name")).alias("slug")).filter("slug <> ''").distinct()


@query(f"SELECT id, {NUMBER} AS chapter_number, CASE WHEN {NUMBER} IS NULL THEN chapter_label END AS chapter_text FROM ({LOG}) l")
def chapter_parse(s: SparkSession, d: str) -> DataFrame:
    return library.numbered(log(s, d)).select("id", "chapter_number", "chapter_text")


@query(f"SELECT id, {SQL_KEY} AS series_key FROM ({URLS}) u")
def series_keys(s: SparkSession, d: str) -> DataFrame:
    return role(s, d, roles.URLS).select("id", text.series_key(F.col("url")).alias("series_key"))


@query(f"SELECT id, {SQL_DOMAIN} AS source_domain FROM ({URLS}) u")
def source_domains(s: SparkSession, d: str) -> DataFrame:
    return role(s, d, roles.URLS).select("id", text.domain(F.col("url")).alias("source_domain"))


_SITE = "regexp_replace(" + SQL_DOMAIN + r", '^www\.', '')"


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN {_SITE} ELSE {_SITE} || ' x' END AS title FROM ({URLS}) u WHERE {_SITE} <> '' AND id % 2 = 0 AND {sql_slug(_SITE)} <> 'unknown-title'")
def site_name_rejects(s: SparkSession, d: str) -> DataFrame:
    host = F.regexp_replace(text.domain(F.col("url")), r"^www\.", "")
    rows = role(s, d, roles.URLS).select("id", "url", F.when(F.col("id") % 2 == 0, host).otherwise(F.concat(host, F.lit(" x"))).alias("title"))
    return rows.filter(text.site_name_title(F.col("title"), F.col("url"))).select("id", "title")


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN [event_type] WHEN event_id % 3 = 1 THEN CAST([event_type, 'favs'] AS VARCHAR[]) ELSE CAST([] AS VARCHAR[]) END AS tags FROM events")
def tags_decode(s: SparkSession, d: str) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id") % 3
    json = F.when(n == 0, F.concat(F.lit('["'), kind, F.lit('", 7, null]'))).when(n == 1, F.concat(F.lit('["'), kind, F.lit('","favs"]'))).otherwise(F.col("props"))
    return s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), text.tags(json).alias("tags"))


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'dropped' ELSE 'reading' END AS status FROM orders")
def status_conform(s: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "dropped").otherwise("banana")
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), text.status(raw).alias("status"))


def _reports(s: SparkSession, d: str) -> DataFrame:
    """Reports: events, named by the title of the user's document, with the user's page as series page for even ids."""
    titles = role(s, d, roles.TITLES).select(F.col("id").alias("series_id"), F.col("canonical_name").alias("manga_name"))
    pages = role(s, d, roles.URLS).select(F.col("id").alias("series_id"), "url")
    rows = log(s, d).join(titles, "series_id").join(pages, "series_id", "left")
    return rows.select(F.col("id").alias("report_id"), "manga_name", "chapter_label", "source_url", F.when(F.col("id") % 2 == 0, F.col("url")).alias("series_url"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("https://img.example.com/"), "id")).alias("cover_url"), "read_at")


REPORTS = f"""reports AS (SELECT l.id AS report_id, t.canonical_name AS manga_name, l.chapter_label, l.source_url, CASE WHEN l.id % 2 = 0 THEN u.url END AS series_url,
             CASE WHEN l.id % 5 = 0 THEN concat('https://img.example.com/', l.id) END AS cover_url, l.read_at
             FROM ({LOG}) l JOIN ({TITLES}) t ON t.id = l.series_id LEFT JOIN ({URLS}) u ON u.id = l.series_id)"""


@query(f"WITH {REPORTS} SELECT report_id, trim(manga_name) <> '' AND chapter_label <> '' AS accepted FROM reports")
def report_validation(s: SparkSession, d: str) -> DataFrame:
    return ingest.validate(_reports(s, d)).select("report_id", (F.size("errors") == 0).alias("accepted"))


@query(f"""SELECT id, CASE id % 3 WHEN 0 THEN 'manhwaweb.com/leer/s' || (id % 50) || '_1700000000000' WHEN 1 THEN 'olympusxyz.com/comic-s' || (id % 50) END AS series_key FROM ({URLS}) u""")
def site_rule_keys(s: SparkSession, d: str) -> DataFrame:
    n = F.concat(F.lit("s"), F.col("id") % 50)
    chapter = F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://manhwaweb.com/leer/"), n, F.lit("_1700000000000-"), "id")).when(F.col("id") % 3 == 1, F.concat(F.lit("https://www.OlympusXYZ.com/capitulo/"), "id", F.lit("/comic-"), n, F.lit("-20260716-110408156"))).otherwise(F.col("url"))
    return role(s, d, roles.URLS).select("id", text.series_key(text.site_series_url(chapter)).alias("series_key"))


# identity
@query(f"WITH RECURSIVE {CANONICAL} SELECT slug, canonical_slug FROM canon")
def canonical_resolution(s: SparkSession, d: str) -> DataFrame:
    return identity.resolve_canonical(registry(s, d))


@query(f"WITH RECURSIVE {CANONICAL} SELECT canonical_slug, list(slug ORDER BY is_alias, created_ord, slug) AS member_slugs, count(*) - 1 AS n_aliases FROM mem GROUP BY 1")
def series_groups(s: SparkSession, d: str) -> DataFrame:
    return identity.series_groups(registry(s, d))


@query(f"WITH RECURSIVE {CANONICAL} SELECT id, canonical_id FROM mem")
def canonical_of(s: SparkSession, d: str) -> DataFrame:
    r = registry(s, d)
    return identity.canonical_of(r, r)


@query(f"WITH RECURSIVE {CANONICAL} SELECT canonical_slug, slug, row_number() OVER (PARTITION BY canonical_slug ORDER BY is_alias, created_ord, slug) - 1 AS ordinal FROM mem")
def card_aliases(s: SparkSession, d: str) -> DataFrame:
    return library.aliases(registry(s, d))


_KEYED = f"SELECT l.*, u.series_key FROM ({LOG}) l JOIN (SELECT id, {SQL_KEY} AS series_key FROM ({URLS}) v) u ON u.id = l.series_id WHERE u.series_key IS NOT NULL"


@query(f"""WITH RECURSIVE {CANONICAL}, k AS (SELECT series_key, series_id, row_number() OVER (PARTITION BY series_key ORDER BY read_at DESC, id DESC) AS rn FROM ({_KEYED}) x)
SELECT series_key, canonical_slug FROM k JOIN mem m ON m.id = k.series_id WHERE rn = 1""")
def owner_by_series_key(s: SparkSession, d: str) -> DataFrame:
    pages = series_keys(s, d).withColumnRenamed("id", "series_id")
    keyed = log(s, d).join(pages, "series_id", "left")
    return identity.owner_by_series_key(keyed, registry(s, d))


# library
@query(LIBRARY)
def library_cards(s: SparkSession, d: str) -> DataFrame:
    return library.library(registry(s, d), log(s, d))


@query(LIBRARY + " AND on_domain")
def library_by_domain(s: SparkSession, d: str) -> DataFrame:
    return library.library(registry(s, d), log(s, d), domain=DOMAIN)


@query(LIBRARY + f" AND newest >= TIMESTAMP '{SINCE}'")
def library_since(s: SparkSession, d: str) -> DataFrame:
    return library.library(registry(s, d), log(s, d), since=SINCE)


@query(LIBRARY + " ORDER BY last_read_at DESC NULLS LAST, m.created_ord LIMIT 10")
def library_topk(s: SparkSession, d: str) -> DataFrame:
    return library.library(registry(s, d), log(s, d)).limit(10)


@query(HISTORY)
def history(s: SparkSession, d: str) -> DataFrame:
    return library.history(registry(s, d), log(s, d))


@query(HISTORY.replace("WHERE NOT dead GROUP", "WHERE NOT dead AND canonical_slug IN (SELECT canonical_slug FROM mem WHERE id IN (" + CLICKED + ")) GROUP"))
def history_of_ids(s: SparkSession, d: str) -> DataFrame:
    r = registry(s, d)
    return library.history(r, log(s, d), role(s, d, roles.CLICKED))


@query(f"""SELECT slug, CASE WHEN n % 3 = 0 THEN 'stored' ELSE 'fetch' END AS source, CASE WHEN n % 3 <> 0 THEN url END AS url,
       CASE WHEN n % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['https://click.example.com/', 'https://view.example.com/', ''] END AS referers
FROM (SELECT 'page-' || id AS slug, id AS n, url FROM ({URLS}) u) x WHERE n % 3 = 0 OR regexp_matches(url, '^(?i)https?://[^/?#\\s]+')""")
def cover_fetch_plan(s: SparkSession, d: str) -> DataFrame:
    cards = role(s, d, roles.URLS).select(F.concat(F.lit("page-"), "id").alias("slug"), F.col("url").alias("cover_url"), (F.col("id") % 3 == 0).alias("has_bytes"), F.array(F.lit("click.example.com"), F.lit("view.example.com")).alias("source_domains"))
    return library.cover_fetch_plan(cards)


# similarity and duplicates
EDIT = "1 - levenshtein(slug_a, slug_b) / CAST(greatest(length(slug_a), length(slug_b)) AS DOUBLE)"
_SHORT_PAIRS = f"SELECT a.slug AS slug_a, b.slug AS slug_b FROM ({SHORT}) a JOIN ({SHORT}) b ON a.slug < b.slug"


@query(f"SELECT slug_a, slug_b, round({EDIT}, 9) AS similarity FROM ({_SHORT_PAIRS}) p WHERE {EDIT} >= 0.6")
def edit_similarity_pairs(s: SparkSession, d: str) -> DataFrame:
    pairs = duplicates.similar_strings(role(s, d, roles.SHORT_TITLES), "slug", 0.6).select(F.col("a").alias("slug_a"), F.col("b").alias("slug_b"))
    return pairs.withColumn("similarity", F.round(similarity.edit_similarity(F.col("slug_a"), F.col("slug_b")), 9))


@query()
def title_similarity(s: SparkSession, d: str) -> DataFrame:
    """Scores of all suggested pairs of short titles; greedy matching has no SQL form, so tests hold it against a model."""
    return duplicates.title_pairs(role(s, d, roles.SHORT_TITLES))


@query(f"""SELECT slug AS slug_a, slug || '-season' AS slug_b, round(greatest(2 * n / (2.0 * n + 6), 1 - 7 / (length(slug) + 7.0)), 9) AS score, true AS sequel
FROM (SELECT slug, length(replace(slug, '-', '')) AS n FROM (SELECT DISTINCT {sql_slug('canonical_name')} AS slug FROM ({LINES}) t) x WHERE slug <> '') y""")
def sequel_flags(s: SparkSession, d: str) -> DataFrame:
    """First lines of documents against the same with a marker word: all are flagged."""
    rows = line_slugs(s, d).select(F.col("slug").alias("slug_a"), F.concat("slug", F.lit("-season")).alias("slug_b"))
    return similarity.with_similarity(rows).select("slug_a", "slug_b", F.round("score", 9).alias("score"), "sequel")


@query()
def confident_matches(s: SparkSession, d: str) -> DataFrame:
    """Page titles with one letter doubled, as new slugs, against the titles themselves."""
    rows = checkpoint(page_slugs(s, d))
    known = rows.select("slug", F.col("slug").alias("canonical_slug"), F.xxhash64("slug").alias("canonical_ord"), F.lit(0).alias("created_ord"), F.lit(False).alias("is_alias"), F.lit(False).alias("canonical_deleted"))
    new = rows.select(F.concat("slug", F.substring("slug", -1, 1)).alias("slug")).join(rows, "slug", "left_anti")
    return duplicates.best_confident_match(new, known)


@query()
def title_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Suggested pairs among the titles of pages."""
    return duplicates.duplicates(page_slugs(s, d).select("slug", F.lit(None).cast("string").alias("cover_url")))


@query(f"SELECT DISTINCT a.slug AS slug_a, b.slug AS slug_b FROM (SELECT 'page-' || id AS slug, {SQL_KEY} AS k FROM ({URLS}) u) a JOIN (SELECT 'page-' || id AS slug, {SQL_KEY} AS k FROM ({URLS}) u) b ON a.k = b.k AND a.slug < b.slug")
def shared_cover_pairs(s: SparkSession, d: str) -> DataFrame:
    rows = role(s, d, roles.URLS).select(F.concat(F.lit("page-"), "id").alias("slug"), text.series_key(F.col("url")).alias("cover_url"))
    return duplicates.shared_cover_pairs(rows)


@query(f"""WITH c AS (SELECT 'page-' || id AS slug, {SQL_KEY} AS k FROM ({URLS}) u) SELECT slug, min(slug) OVER w AS representative, count(*) OVER w - 1 AS n_links FROM c WHERE k IS NOT NULL WINDOW w AS (PARTITION BY k) QUALIFY count(*) OVER w > 1""")
def cover_classes(s: SparkSession, d: str) -> DataFrame:
    """Pages that share a cover, as classes: the linear form of ``shared_cover_pairs``."""
    rows = role(s, d, roles.URLS).select(F.concat(F.lit("page-"), "id").alias("slug"), text.series_key(F.col("url")).alias("cover_url"))
    return duplicates.cover_classes(rows)


_NEAR = f"SELECT slug_a, slug_b FROM ({_SHORT_PAIRS}) p WHERE {EDIT} >= 0.6"


@query(f"SELECT slug_a, slug_b FROM ({_NEAR}) n WHERE length(slug_a) % 2 = 0 OR length(slug_b) % 2 = 0")
def undismissed_pairs(s: SparkSession, d: str) -> DataFrame:
    pairs = checkpoint(edit_similarity_pairs(s, d).select("slug_a", "slug_b"))
    odd = pairs.filter("length(slug_a) % 2 = 1 AND length(slug_b) % 2 = 1")
    return duplicates.without_dismissed(pairs, odd.select(F.col("slug_b").alias("slug_a"), F.col("slug_a").alias("slug_b")))


# ingest
_RESOLVED = f"{REPORTS}, r AS (SELECT *, {sql_slug('manga_name')} AS slug, {NUMBER} AS num, CASE WHEN {NUMBER} IS NULL THEN chapter_label END AS txt FROM reports WHERE trim(manga_name) <> '')"


def _ingested(s: SparkSession, d: str, log_rows: DataFrame | None = None) -> DataFrame:
    """Reports under their own slug as target, for the steps that follow resolution."""
    rows = checkpoint(ingest.prepared(ingest.validate(ingest.named(_reports(s, d))).filter(F.size("errors") == 0)))  # read several times
    return rows.withColumn("target", F.col("slug")).withColumn("via", F.lit("new"))


@query(f"WITH {_RESOLVED} SELECT slug, arg_min(trim(manga_name), (read_at, report_id)) AS canonical_name, sha256(slug) AS id, min(read_at) AS created_at FROM r GROUP BY slug")
def ingest_new_series(s: SparkSession, d: str) -> DataFrame:
    return ingest.new_series(_ingested(s, d)).drop("merged_into_slug")


@query(f"WITH {_RESOLVED} SELECT report_id, row_number() OVER (PARTITION BY slug, num, txt ORDER BY read_at, report_id) = 1 AND NOT coalesce(num % 2 = 0, false) AS created FROM r")
def ingest_outcomes(s: SparkSession, d: str) -> DataFrame:
    rows = _ingested(s, d)
    seen = rows.filter("chapter_number % 2 = 0").select("target", "chapter_number", "chapter_text")
    return ingest.outcomes(rows, seen).select("report_id", "created")


@query(f"WITH {_RESOLVED} SELECT slug, arg_min(cover_url, (read_at, report_id)) AS cover_url FROM r WHERE cover_url IS NOT NULL GROUP BY slug")
def first_cover(s: SparkSession, d: str) -> DataFrame:
    rows = _ingested(s, d)
    return ingest.first_covers(rows, rows.select("slug", F.lit(None).cast("string").alias("cover_url"))).select("slug", "cover_url")


@query(f"SELECT r.slug, min(l.read_at) AS revived_at FROM ({REGISTRY}) r JOIN ({LOG}) l ON l.series_id = r.id WHERE deleted_at IS NOT NULL GROUP BY 1")
def resurrected(s: SparkSession, d: str) -> DataFrame:
    touched = log(s, d).select(F.concat(F.lit("series-"), "series_id").alias("target"), F.col("id").alias("report_id"), "read_at")
    return ingest.resurrected(touched, registry(s, d)).select("slug", F.col("at").alias("revived_at"))


def _state(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Registry and log before ingestion; the log's events know the page of their series."""
    pages = series_keys(s, d).withColumnRenamed("id", "series_id")
    return registry(s, d).withColumn("cover_url", F.lit(None).cast("string")), log(s, d).join(pages, "series_id", "left")


@query()
def ingest_batch(s: SparkSession, d: str) -> DataFrame:
    """Whole ingestion against the registry and its log: every report with its card, how it was found, and what it changed."""
    return ingest.ingest(_reports(s, d), *_state(s, d))["outcomes"].select("report_id", "target", "via", "series_id", "event_id", "created", "cover_changed", "revived", "changed")


def _known_reports(s: SparkSession, d: str) -> DataFrame:
    """Reports, later than the log, of series by their own titles or by new ones that are close to no other, half of them with the
    series' page, whose owner the log knows."""
    pages = role(s, d, roles.URLS).select(F.col("id").alias("series_id"), "url")
    n, series = F.col("id"), F.col("series_id").cast("string")
    return log(s, d).join(pages, "series_id", "left").select(
        (n + 1_000_000).alias("report_id"), F.when(n % 3 == 0, F.md5(series)).otherwise(F.concat(F.lit("Series "), series)).alias("manga_name"),
        F.when(n % 4 == 0, F.concat(F.lit("Cap. "), (F.col("series_id") % 7 + 1000).cast("string"))).otherwise(F.col("chapter_label")).alias("chapter_label"), "source_url",
        F.when(n % 5 == 0, F.concat(F.lit("https://img.example.com/"), n)).alias("cover_url"), F.when(n % 2 == 0, F.col("url")).alias("series_url"), F.expr("read_at + INTERVAL 40 DAYS").alias("read_at"),
    )


_TOLD = f"""WITH RECURSIVE {CANONICAL},
own AS (SELECT k.series_key, m.canonical_slug FROM (SELECT series_key, series_id, row_number() OVER (PARTITION BY series_key ORDER BY read_at DESC, id DESC) AS rn FROM ({_KEYED}) x) k JOIN mem m ON m.id = k.series_id WHERE rn = 1),
raw AS (SELECT l.id + 1000000 AS report_id, CASE WHEN l.id % 3 = 0 THEN md5(l.series_id::VARCHAR) ELSE 'series-' || l.series_id END AS slug,
        CASE WHEN l.id % 4 = 0 THEN 'Cap. ' || (l.series_id % 7 + 1000) ELSE l.chapter_label END AS chapter_label, l.source_url, l.id % 5 = 0 AS covered, CASE WHEN l.id % 2 = 0 THEN u.url END AS url, l.read_at + INTERVAL 40 DAY AS read_at
        FROM ({LOG}) l LEFT JOIN ({URLS}) u ON u.id = l.series_id),
rp AS (SELECT *, {SQL_KEY} AS series_key, {NUMBER} AS num, CASE WHEN {NUMBER} IS NULL THEN chapter_label END AS txt FROM raw),
tg AS (SELECT rp.*, own.canonical_slug AS by_key, mem.canonical_slug AS by_slug, coalesce(own.canonical_slug, mem.canonical_slug, rp.slug) AS target FROM rp LEFT JOIN own USING (series_key) LEFT JOIN mem ON mem.slug = rp.slug),
st AS (SELECT canonical_slug AS target, num, txt, arg_max(id, (read_at, id)) AS event_id FROM ev GROUP BY 1, 2, 3),
nx AS (SELECT tg.*, CASE WHEN by_key IS NOT NULL THEN 'key' WHEN by_slug IS NOT NULL OR row_number() OVER (PARTITION BY tg.slug, by_key IS NULL AND by_slug IS NULL ORDER BY read_at, report_id) > 1 THEN 'slug' ELSE 'new' END AS via,
       st.event_id IS NULL AND row_number() OVER (PARTITION BY tg.target, tg.num, tg.txt ORDER BY read_at, report_id) = 1 AS created,
       coalesce(st.event_id::VARCHAR, sha256(first_value(report_id || chr(1) || source_url) OVER (PARTITION BY tg.target, tg.num, tg.txt ORDER BY read_at, report_id))) AS event_id,
       covered AND row_number() OVER (PARTITION BY tg.target, covered ORDER BY read_at, report_id) = 1 AS cover_changed,
       reg.deleted_at IS NOT NULL AND row_number() OVER (PARTITION BY tg.target ORDER BY read_at, report_id) = 1 AS revived, coalesce(reg.id::VARCHAR, sha256(tg.target)) AS series_id
       FROM tg LEFT JOIN st ON st.target = tg.target AND st.num IS NOT DISTINCT FROM tg.num AND st.txt IS NOT DISTINCT FROM tg.txt LEFT JOIN reg ON reg.slug = tg.target)"""


@query(_TOLD + " SELECT report_id, target, via, series_id, event_id, created, cover_changed, revived, created OR cover_changed OR revived AS changed FROM nx")
def ingest_told(s: SparkSession, d: str) -> DataFrame:
    """Whole ingestion of reports whose targets the log and the registry know, or that are new: what every sender is told."""
    return ingest.ingest(_known_reports(s, d), *_state(s, d))["outcomes"].select("report_id", "target", "via", "series_id", "event_id", "created", "cover_changed", "revived", "changed")


@query(_TOLD + " SELECT event_id AS id, series_id, chapter_label, num AS chapter_number, source_url, read_at, series_key FROM nx WHERE created")
def ingest_appended(s: SparkSession, d: str) -> DataFrame:
    """What the same reports append: under the card's canonical row, with the page that they teach."""
    return ingest.ingest(_known_reports(s, d), *_state(s, d))["appended"].drop("source_domain")


@query(f"""WITH {_RESOLVED}, c AS (SELECT report_id, slug, read_at, row_number() OVER (PARTITION BY slug, num, txt ORDER BY read_at, report_id) = 1 AS created,
       cover_url IS NOT NULL AND row_number() OVER (PARTITION BY slug ORDER BY cover_url IS NULL, read_at, report_id) = 1 AS covers FROM r)
SELECT report_id, slug AS target, read_at AS ts FROM c WHERE created OR covers""")
def change_feed(s: SparkSession, d: str) -> DataFrame:
    """The changes that reports make where every card is new."""
    rows = _ingested(s, d)
    nothing = rows.select("target", "chapter_number", "chapter_text").filter("false")
    none = rows.select("slug", F.lit(None).cast("string").alias("cover_url")).filter("false")
    first = ingest.first_covers(rows, none).select("report_id", F.lit(True).alias("cover_changed"))
    told = ingest.outcomes(rows, nothing).join(first, "report_id", "left").withColumns({"cover_changed": F.coalesce("cover_changed", F.lit(False)), "revived": F.lit(False)})
    return streams.change_feed(told)


@query(f"""WITH RECURSIVE {CANONICAL} SELECT canonical_slug AS target, num AS chapter_number, txt AS chapter_text, arg_max(id, (read_at, id)) AS event_id FROM ev GROUP BY 1, 2, 3""")
def latest_events(s: SparkSession, d: str) -> DataFrame:
    return ingest.latest_events(registry(s, d), log(s, d))


# curation
def _at() -> Column:
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


#: The same with all columns of the registry.
CARD_ROWS = CANONICAL.replace(f"reg AS ({REGISTRY})", f"reg AS ({CARDS})")
_STAMP = "TIMESTAMP '2024-03-01 00:00:00'"


@query(f"""WITH RECURSIVE {CARD_ROWS},
e AS (SELECT m.canonical_id AS id, max(x.id) AS last, max(x.id) FILTER (x.id % 2 = 1) AS tagged, count(*) FILTER (x.id % 2 = 0) AS covers FROM reg x JOIN mem m ON m.id = x.id WHERE NOT m.dead GROUP BY 1)
SELECT r.id, r.slug, coalesce('Edited ' || last, canonical_name) AS canonical_name, CASE WHEN tagged IS NOT NULL THEN '["e' || tagged || '"]' ELSE tags END AS tags,
       CASE WHEN covers > 0 THEN NULL ELSE cover_url END AS cover_url, CAST(cover_version + coalesce(covers, 0) AS BIGINT) AS cover_version, CASE WHEN last IS NULL THEN updated_at ELSE {_STAMP} END AS updated_at
FROM reg r LEFT JOIN e ON e.id = r.id""")
def edits_applied(s: SparkSession, d: str) -> DataFrame:
    """Every row's id names an edit of its card: a new name, and tags or a cleared cover."""
    r = cards(s, d)
    fields = F.when(F.col("id") % 2 == 0, F.array(F.lit("canonical_name"), F.lit("cover_url"))).otherwise(F.array(F.lit("canonical_name"), F.lit("tags")))
    edits = r.select("id", F.col("id").alias("seq"), fields.alias("fields"), F.concat(F.lit(" Edited "), "id").alias("canonical_name"), F.concat(F.lit('["e'), "id", F.lit('"]')).alias("tags"), F.lit(None).cast("string").alias("cover_url"))
    return curate.apply_edits(r, edits, _at()).select("id", "slug", "canonical_name", "tags", "cover_url", F.col("cover_version").cast("long").alias("cover_version"), "updated_at")


@query(f"""WITH RECURSIVE {CARD_ROWS} SELECT x.id, CASE WHEN x.id % 3 = 0 THEN 'nothing' WHEN x.id % 3 = 1 THEN 'name' WHEN m.id IS NULL OR m.dead THEN 'not_found' END AS error
FROM (SELECT DISTINCT user_id + 5 AS id FROM events) x LEFT JOIN mem m ON m.id = x.id""")
def edits_checked(s: SparkSession, d: str) -> DataFrame:
    """Edits of ids of which some don't exist or are deleted; a third names no field, a third a blank name."""
    n = F.col("id") % 3
    fields = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("canonical_name")))
    edits = registry(s, d).select((F.col("id") + 5).alias("id")).select("id", fields.alias("fields"), F.when(n == 2, "Name").otherwise(" ").alias("canonical_name"))
    return curate.check_edits(edits, registry(s, d)).select("id", "error")


@query(f"""WITH RECURSIVE {CARD_ROWS}, c AS (SELECT m.canonical_id AS id, max(p.page_id) AS last, count(*) AS n FROM pages p JOIN mem m ON m.id = p.page_id WHERE NOT m.dead AND p.page_id % 3 <> 2 GROUP BY 1)
SELECT r.slug, md5(p.html) AS cover_md5, CASE WHEN c.id IS NOT NULL THEN 'image/png' END AS cover_image_type, CAST(cover_version + coalesce(n, 0) AS BIGINT) AS cover_version,
       CASE WHEN c.id IS NULL THEN updated_at ELSE {_STAMP} END AS updated_at FROM reg r LEFT JOIN c ON c.id = r.id LEFT JOIN pages p ON p.page_id = c.last""")
def covers_applied(s: SparkSession, d: str) -> DataFrame:
    """Uploads for the series with a page's id; every third isn't an image."""
    r = cards(s, d).withColumns({"cover_image": F.lit(None).cast("binary"), "cover_image_type": F.lit(None).cast("string")})
    kind = F.when(F.col("page_id") % 3 == 2, "text/html").otherwise("image/png")
    uploads = s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("id"), F.col("page_id").alias("seq"), F.encode("html", "utf-8").alias("data"), kind.alias("content_type"))
    return curate.apply_covers(r, uploads, _at()).select("slug", F.md5("cover_image").alias("cover_md5"), "cover_image_type", F.col("cover_version").cast("long").alias("cover_version"), "updated_at")


@query(f"""WITH RECURSIVE {CARD_ROWS}, g AS (SELECT slug FROM mem WHERE NOT dead AND canonical_slug IN (SELECT canonical_slug FROM mem WHERE id IN ({CLICKED})))
SELECT slug, CASE WHEN slug IN (FROM g) THEN {_STAMP} ELSE deleted_at END AS deleted_at, CASE WHEN slug IN (FROM g) THEN {_STAMP} ELSE updated_at END AS updated_at FROM reg r""")
def deletes_applied(s: SparkSession, d: str) -> DataFrame:
    return curate.apply_deletes(cards(s, d), role(s, d, roles.CLICKED), _at()).select("slug", "deleted_at", "updated_at")


#: Every card in a merge with the next one of its eight, if there is one: no card is in two.
_MERGES = "SELECT id AS survivor, absorbed, id AS seq FROM (SELECT id, lead(id) OVER w AS absorbed, row_number() OVER w AS rn FROM {cards} WINDOW w AS (PARTITION BY CAST(floor(id / 8) AS BIGINT) ORDER BY id)) x WHERE rn % 2 = 1 AND absorbed IS NOT NULL"


def _merges(r: DataFrame) -> DataFrame:
    tops = identity.members(r).filter("NOT is_alias").select("id")
    return r.sparkSession.sql(_MERGES, cards=tops)


@query(f"""WITH RECURSIVE {CARD_ROWS}, tops AS (SELECT id FROM mem WHERE NOT is_alias),
p AS (SELECT a.slug AS s, b.slug AS t, a.dead AS sd, b.dead AS td, k.id AS tid, k.cover_url AS cover FROM ({_MERGES.format(cards='tops')}) g JOIN mem a ON a.id = g.survivor JOIN mem b ON b.id = g.absorbed JOIN reg k ON k.slug = b.slug)
SELECT r.slug, coalesce(m.s, r.merged_into_slug) AS merged_into_slug, CASE WHEN q.sd AND NOT q.td THEN NULL ELSE r.deleted_at END AS deleted_at, coalesce(r.cover_url, q.cover) AS cover_url,
       CAST(r.cover_version + CASE WHEN r.cover_url IS NULL AND q.cover IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS cover_version,
       list_concat(['t' || (r.id % 3), 'favs'], CASE WHEN q.tid % 3 <> r.id % 3 THEN ['t' || (q.tid % 3)] ELSE [] END) AS tags,
       CASE WHEN m.s IS NULL AND q.s IS NULL THEN r.updated_at ELSE {_STAMP} END AS updated_at
FROM reg r JOIN mem x ON x.slug = r.slug LEFT JOIN p m ON m.t = x.canonical_slug LEFT JOIN p q ON q.s = r.slug""")
def merges_applied(s: SparkSession, d: str) -> DataFrame:
    """Merges of all cards, of which no two touch one card, since the SQL has no order; tests apply sequences."""
    r = cards(s, d)
    return curate.apply_merges(r, _merges(r), _at()).select("slug", "merged_into_slug", "deleted_at", "cover_url", F.col("cover_version").cast("long").alias("cover_version"), text.tags(F.col("tags")).alias("tags"), "updated_at")


@query(f"""WITH RECURSIVE {CARD_ROWS} SELECT p.page_id AS survivor, coalesce(m.canonical_id, p.page_id) AS absorbed, p.page_id AS seq, CASE WHEN m.id IS NULL THEN 'not-found' ELSE 'already-merged' END AS outcome,
CASE WHEN m.id IS NULL THEN p.page_id END AS missing FROM pages p LEFT JOIN mem m ON m.id = p.page_id""")
def merges_refused(s: SparkSession, d: str) -> DataFrame:
    """Every page's number as a series to merge with the card that it is on: of one card already, or not there."""
    r = cards(s, d)
    pages = s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("survivor"), F.col("page_id").alias("seq"))
    own = identity.members(r).select(F.col("id").alias("survivor"), "canonical_id")
    asked = pages.join(own, "survivor", "left").select("survivor", F.coalesce("canonical_id", "survivor").alias("absorbed"), "seq")
    return curate.merged(r, asked, _at())[1]


@query(f"""WITH RECURSIVE {CARD_ROWS}, i AS (SELECT page_id AS id, page_id AS seq FROM pages)
SELECT i.id, i.seq, m.canonical_slug IS NOT NULL AND row_number() OVER (PARTITION BY m.canonical_slug ORDER BY i.seq) = 1 AS deleted FROM i LEFT JOIN mem m ON m.id = i.id AND NOT m.dead""")
def deletes_reported(s: SparkSession, d: str) -> DataFrame:
    """Every page's number as a series to delete: which of them deleted a card."""
    ids = s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("id"), F.col("page_id").alias("seq"))
    return curate.delete_outcomes(cards(s, d), ids)


@query(f"""SELECT p.page_id AS id, p.page_id AS seq, CASE WHEN r.id IS NULL THEN 'not-found' WHEN r.merged_into_slug IS NOT NULL THEN 'unmerged' ELSE 'not-merged' END AS outcome FROM pages p LEFT JOIN ({CARDS}) r ON r.id = p.page_id""")
def unmerges_reported(s: SparkSession, d: str) -> DataFrame:
    ids = s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("id"), F.col("page_id").alias("seq"))
    return curate.unmerge_outcomes(cards(s, d), ids)


@query(f"""WITH RECURSIVE {CARD_ROWS}, g AS (SELECT slug FROM mem WHERE NOT dead AND canonical_slug IN (SELECT canonical_slug FROM mem WHERE id IN ({CLICKED}))) SELECT slug, 'updated' AS change, {_STAMP} AS ts FROM g""")
def deletes_feed(s: SparkSession, d: str) -> DataFrame:
    """What deletions changed; the ids of deleted and unknown cards give no signal."""
    r = cards(s, d)
    return streams.snapshot_feed(r, curate.apply_deletes(r, role(s, d, roles.CLICKED), _at()), "slug", _at())


@query(f"""WITH RECURSIVE {CANONICAL.replace(f"reg AS ({REGISTRY})", f"reg AS (SELECT * FROM ({REGISTRY}) x WHERE deleted_at IS NULL)")} SELECT slug FROM mem WHERE NOT is_alias""")
def duplicate_candidates(s: SparkSession, d: str) -> DataFrame:
    """Cards that may be duplicates: deleted rows dropped, the rest grouped."""
    return duplicates.candidates_of(registry(s, d)).select("slug")


@query(f"""SELECT slug, CASE WHEN named THEN NULL ELSE merged_into_slug END AS merged_into_slug, CASE WHEN named THEN merged_into_slug IS NOT NULL END AS was_merged,
       CASE WHEN named AND merged_into_slug IS NOT NULL THEN {_STAMP} ELSE updated_at END AS updated_at FROM (SELECT *, id IN ({CLICKED}) AS named FROM ({CARDS}) r) x""")
def unmerges_applied(s: SparkSession, d: str) -> DataFrame:
    return curate.apply_unmerges(cards(s, d), role(s, d, roles.CLICKED), _at()).select("slug", "merged_into_slug", "was_merged", "updated_at")


@query("""SELECT least(a, b) AS slug_a, greatest(a, b) AS slug_b, min(ts) AS created_at, max(ts) AS updated_at
FROM (SELECT 'series-' || user_id AS a, 'series-' || (event_id % 40) AS b, ts FROM events) x WHERE a <> b GROUP BY 1, 2""")
def dismissals_applied(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("series-"), "user_id").alias("slug_a"), F.concat(F.lit("series-"), F.col("event_id") % 40).alias("slug_b"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), "event_id")
    return curate.apply_dismissals(e.filter("event_id % 2 = 0").drop("event_id"), e.filter("event_id % 2 = 1").drop("event_id"))


@query("""SELECT lower('Host' || s_suppkey) AS domain, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' || s_name ELSE s_name END AS title_selector, CASE WHEN s_suppkey % 3 <> 0 THEN 'nation ' || s_nationkey END AS chapter_selector FROM supplier""")
def adapters_applied(s: SparkSession, d: str) -> DataFrame:
    """All suppliers' adapters; every third is replaced, and loses the optional selector that the change doesn't name."""
    rows = s.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("Host"), "s_suppkey").alias("domain"), F.col("s_name").alias("title_selector"), F.concat(F.lit("nation "), "s_nationkey").alias("chapter_selector"), "s_suppkey")
    current = rows.select(F.lower("domain").alias("domain"), "title_selector", "chapter_selector")
    changed = rows.filter("s_suppkey % 3 = 0").withColumns({"title_selector": F.concat(F.lit("new "), "title_selector"), "chapter_selector": F.lit(None).cast("string")})
    earlier = changed.withColumns({"title_selector": F.lit("overruled"), "s_suppkey": F.col("s_suppkey") - 1})
    return curate.apply_adapters(current, changed.unionByName(earlier), "s_suppkey")


# convergence
@query(f"""SELECT coalesce(a.slug, b.slug) AS slug, CASE WHEN a.slug IS NULL OR b.updated_at > a.updated_at THEN b.status ELSE a.status END AS status,
CASE WHEN a.slug IS NULL OR b.updated_at > a.updated_at THEN b.value ELSE a.value END AS value, CASE WHEN a.slug IS NULL OR b.updated_at > a.updated_at THEN b.updated_at ELSE a.updated_at END AS updated_at,
CASE WHEN a.slug IS NULL THEN 'inserted' WHEN b.updated_at > a.updated_at THEN 'updated' ELSE 'kept' END AS moved FROM ({LOCAL}) a FULL OUTER JOIN ({REMOTE}) b ON a.slug = b.slug""")
def lww_series(s: SparkSession, d: str) -> DataFrame:
    return sync.merge_lww(role(s, d, roles.LOCAL), role(s, d, roles.REMOTE), "slug")


@query(f"SELECT a.* FROM ({LOCAL}) a LEFT JOIN ({REMOTE}) b ON a.slug = b.slug WHERE b.slug IS NULL OR a.updated_at > b.updated_at")
def push_diff_series(s: SparkSession, d: str) -> DataFrame:
    return sync.push_diff(role(s, d, roles.LOCAL), role(s, d, roles.REMOTE), "slug")


@query(f"SELECT * FROM ({EVENTS_A}) a UNION SELECT * FROM ({EVENTS_B}) b")
def event_union(s: SparkSession, d: str) -> DataFrame:
    return sync.event_union(role(s, d, roles.EVENTS_A), role(s, d, roles.EVENTS_B))


@query(f"SELECT * FROM ({EVENTS_A}) a WHERE id NOT IN (SELECT id FROM ({EVENTS_B}) b)")
def push_diff_events(s: SparkSession, d: str) -> DataFrame:
    return sync.missing_remotely(role(s, d, roles.EVENTS_A), role(s, d, roles.EVENTS_B), "id")


_PAIRS = "SELECT DISTINCT 'series-' || least(user_id, event_id % 40) AS slug_a, 'series-' || greatest(user_id, event_id % 40) AS slug_b, TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM events WHERE user_id <> event_id % 40 AND event_id % 3 <> {}"


@query(f"{_PAIRS.format(0)} UNION {_PAIRS.format(1)}")
def dismissal_union(s: SparkSession, d: str) -> DataFrame:
    s.read.parquet(f"{d}/events.parquet").createOrReplaceTempView("_events")
    a, b = (s.sql(_PAIRS.format(k).replace("FROM events", "FROM _events")) for k in (0, 1))
    return sync.dismissal_union(a, b)


@query(f"SELECT a.slug, CASE WHEN b.v > a.cover_version THEN 'pull' ELSE 'push' END AS action FROM ({COVERS}) a JOIN (SELECT slug, length(slug) % 4 AS v FROM ({COVERS}) c) b USING (slug) WHERE b.v <> a.cover_version")
def cover_diff(s: SparkSession, d: str) -> DataFrame:
    here = role(s, d, roles.COVERS)
    return sync.cover_diff(here, here.select("slug", (F.length("slug") % 4).alias("cover_version")))


@query(f"SELECT slug FROM ({COVERS}) c WHERE length(slug) % 2 = 1 AND cover_version > 0")
def cleared_covers(s: SparkSession, d: str) -> DataFrame:
    covers = role(s, d, roles.COVERS)
    return sync.cleared_covers(covers.filter("length(slug) % 2 = 0"), covers, covers)


@query(f"SELECT 'events' AS kind, count(*) AS n FROM ({EVENTS_B}) b UNION ALL SELECT 'series', count(*) FROM ({REMOTE}) r")
def restore_counts(s: SparkSession, d: str) -> DataFrame:
    none = {"series": role(s, d, roles.LOCAL).filter("false"), "events": role(s, d, roles.EVENTS_A).filter("false")}
    return sync.sync_counts(**sync.restore(none, {"events": role(s, d, roles.EVENTS_B), "series": role(s, d, roles.REMOTE)}))


@query(f"""WITH u AS (SELECT *, 0 AS r FROM ({LOCAL}) a UNION ALL SELECT *, 1 FROM ({REMOTE}) b UNION ALL SELECT slug, 'third', value, slug % 6, 2 FROM ({LOCAL}) c)
SELECT slug, status, value, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY updated_at DESC, r DESC) AS rn FROM u) x WHERE rn = 1""")
def nway_lww(s: SparkSession, d: str) -> DataFrame:
    a, b = role(s, d, roles.LOCAL), role(s, d, roles.REMOTE)
    return sync.converge([a, b, a.select("slug", F.lit("third").alias("status"), "value", (F.col("slug") % 6).alias("updated_at"))], "slug")


@query(f"""SELECT slug, name, version, CASE WHEN n % 4 = 1 THEN NULL ELSE make_timestamp(1704067200000000 + n * 1000000) END AS deleted_at FROM
(SELECT 'page-' || page_id AS slug, CASE WHEN page_id % 2 = 0 THEN url ELSE '' END AS name, CASE WHEN page_id % 3 = 0 THEN 0 ELSE page_id END AS version, page_id AS n FROM pages) x""")
def series_documents(s: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    rows = s.read.parquet(f"{d}/pages.parquet")
    doc: Column = F.concat(
        F.lit('{"_id":"page-'), n, F.lit('","canonicalName":'), F.when(n % 2 == 0, F.concat(F.lit('"'), "url", F.lit('"'))).otherwise("42"), F.lit(',"coverVersion":'),
        F.when(n % 3 == 0, '"three"').otherwise(n.cast("string")), F.lit(',"deletedAt":'), F.when(n % 4 == 1, '"not-a-date"').otherwise((F.lit(1704067200000) + n * 1000).cast("string")), F.lit("}"),
    )
    return documents.series_docs(rows.select(doc.alias("doc"))).select("slug", F.col("canonical_name").alias("name"), F.col("cover_version").alias("version"), "deleted_at")


@query(f"""SELECT l.id::VARCHAR AS id, r.slug AS series_slug, l.chapter_label, {NUMBER} AS chapter_number, l.source_url, l.source_domain, date_trunc('milliseconds', l.read_at) AS read_at, u.series_key
FROM ({LOG}) l JOIN ({REGISTRY}) r ON r.id = l.series_id LEFT JOIN (SELECT id, {SQL_KEY} AS series_key FROM ({URLS}) v) u ON u.id = l.series_id""")
def event_documents(s: SparkSession, d: str) -> DataFrame:
    """Events exported as documents and read back, every field."""
    return documents.event_docs(documents.export_events(_state(s, d)[1], registry(s, d)))


@query(f"""SELECT slug, canonical_name, cover_url, CASE WHEN id % 3 = 0 THEN 'image/png' END AS cover_image_type, CAST(cover_version AS BIGINT) AS cover_version, status, ['t' || (id % 3), 'favs'] AS tags, created_at, updated_at, deleted_at, merged_into_slug FROM ({CARDS}) r""")
def card_documents(s: SparkSession, d: str) -> DataFrame:
    """Registry rows exported as documents and read back, every field."""
    kind = F.when(F.col("id") % 3 == 0, "image/png")
    return documents.series_docs(documents.export_series(cards(s, d).withColumn("cover_image_type", kind)))


@query("""SELECT slug_a, slug_b, date_trunc('milliseconds', min(ts)) AS created_at FROM (SELECT least('series-' || user_id, 'series-' || (event_id % 40)) AS slug_a, greatest('series-' || user_id, 'series-' || (event_id % 40)) AS slug_b, ts FROM events) x
WHERE slug_a <> slug_b GROUP BY 1, 2""")
def pair_documents(s: SparkSession, d: str) -> DataFrame:
    """Dismissed pairs exported as documents and read back; those of a title with itself are dropped."""
    a, b = F.concat(F.lit("series-"), "user_id"), F.concat(F.lit("series-"), F.col("event_id") % 40)
    pairs = s.read.parquet(f"{d}/events.parquet").groupBy(F.least(a, b).alias("slug_a"), F.greatest(a, b).alias("slug_b")).agg(F.min("ts").alias("created_at"))
    return documents.dismissal_docs(documents.export_pairs(pairs))


@query(ADAPTERS.replace("CAST(s_suppkey AS STRING)", "CAST(s_suppkey AS VARCHAR)").replace("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)"))
def adapter_documents(s: SparkSession, d: str) -> DataFrame:
    """Adapters exported as documents and read back."""
    return documents.adapter_docs(documents.export_adapters(role(s, d, roles.ADAPTERS)))


@query(f"SELECT slug, md5(data) AS data_md5, 'text/html' AS content_type, cover_version FROM ({COVERS}) c")
def cover_documents(s: SparkSession, d: str) -> DataFrame:
    """Cover bytes exported as documents and read back."""
    covers = role(s, d, roles.COVERS).select("slug", F.encode("data", "utf-8").alias("data"), F.lit("text/html").alias("content_type"), "cover_version")
    return documents.cover_docs(documents.export_covers(covers)).select("slug", F.md5("data").alias("data_md5"), "content_type", "cover_version")


@query(f"""SELECT id, canonical_name AS "canonicalName", slug AS "normalizedSlug", cover_url AS "coverUrl", cover_version AS "coverVersion", false AS "hasStoredCover", status, ['t' || (id % 3), 'favs'] AS tags,
strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "createdAt", merged_into_slug AS "mergedIntoSlug" FROM ({CARDS}) r""")
def present_cards(s: SparkSession, d: str) -> DataFrame:
    return documents.present_series(cards(s, d).withColumn("cover_image", F.lit(None).cast("binary")))


@query(f"SELECT id, series_id, chapter_label, {NUMBER} AS chapter_number, source_url, source_domain, strftime(read_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS read_at FROM ({LOG}) l")
def present_events(s: SparkSession, d: str) -> DataFrame:
    return documents.present_events(log(s, d))


# sites and operations
_SITES = f"SELECT {SQL_DOMAIN} AS domain, arg_max(s_name, s_suppkey) AS title_selector, arg_max('nation ' || s_nationkey, s_suppkey) AS chapter_selector FROM supplier JOIN pages ON page_id = s_suppkey GROUP BY 1"


def _sites(s: SparkSession, d: str) -> DataFrame:
    """Adapters of the hosts of those pages that have a supplier's number."""
    pages = s.read.parquet(f"{d}/pages.parquet").select("page_id", text.domain(F.col("url")).alias("domain"))
    changes = s.read.parquet(f"{d}/supplier.parquet").join(pages, F.col("s_suppkey") == F.col("page_id")).select("domain", F.col("s_name").alias("title_selector"), F.concat(F.lit("nation "), "s_nationkey").alias("chapter_selector"), "s_suppkey")
    return curate.apply_adapters(changes.select("domain", "title_selector", "chapter_selector").filter("false"), changes, "s_suppkey")


@query(f"SELECT page_id, p.domain, title_selector, chapter_selector FROM (SELECT page_id, {SQL_DOMAIN} AS domain FROM pages) p LEFT JOIN ({_SITES}) a USING (domain)")
def adapter_lookup(s: SparkSession, d: str) -> DataFrame:
    """Every page with the adapter of its host, if there is one."""
    pages = s.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    return curate.adapter_of(pages, _sites(s, d)).select("page_id", "domain", "title_selector", "chapter_selector")


@query(f"SELECT domain, title_selector, chapter_selector FROM ({_SITES}) a ORDER BY domain")
def adapter_list(s: SparkSession, d: str) -> DataFrame:
    return curate.list_adapters(_sites(s, d)).select("domain", "title_selector", "chapter_selector")


@query("""SELECT s_suppkey AS domain, CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_nationkey % 5 > s_suppkey % 5 THEN 'nation ' || s_nationkey ELSE s_name END AS title_selector, greatest(s_nationkey % 5, s_suppkey % 5) AS updated_at FROM supplier""")
def lww_adapters(s: SparkSession, d: str) -> DataFrame:
    """Adapters of two replicas; a newer row replaces all but the local id."""
    rows = s.read.parquet(f"{d}/supplier.parquet")
    local = rows.select(F.col("s_suppkey").alias("domain"), F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("title_selector"), (F.col("s_suppkey") % 5).alias("updated_at"))
    remote = rows.select(F.col("s_suppkey").alias("domain"), F.lit("theirs").alias("id"), F.concat(F.lit("nation "), "s_nationkey").alias("title_selector"), (F.col("s_nationkey") % 5).alias("updated_at"))
    return sync.merge_lww(local, remote, "domain", local_only=("id",)).drop("moved")


# sources and sinks
@query(f"SELECT id::VARCHAR AS id, chapter_label, source_url, source_domain, read_at FROM ({LOG}) l")
def log_append(s: SparkSession, d: str) -> DataFrame:
    """Overlapping appends to a log, read back: every event once, though the last append has all of them on other days."""
    folder, events = _scratch(s, "log"), log(s, d)
    store.append_events(events.filter("chapter_label <> 'Extra Omake'"), folder)
    store.append_events(events, folder)
    store.append_events(events.withColumn("read_at", F.date_add("read_at", (1 + F.col("id") % 3).cast("int"))), folder)
    return store.read_log(s, folder).select("id", "chapter_label", "source_url", "source_domain", "read_at")


@query(f"SELECT slug, CASE WHEN deleted_at IS NULL THEN canonical_name ELSE 'gone' END AS canonical_name, status, tags, updated_at FROM ({CARDS}) r")
def registry_upsert(s: SparkSession, d: str) -> DataFrame:
    """A registry snapshot, rows replaced by key in a second one, read back."""
    folder = _scratch(s, "registry")
    store.write_registry(cards(s, d), folder)
    first = store.read_registry(s, folder)
    store.write_registry(store.upsert(first, first.filter("deleted_at IS NOT NULL").withColumn("canonical_name", F.lit("gone")), "slug"), folder)
    return store.read_registry(s, folder).select("slug", "canonical_name", "status", "tags", "updated_at")


@query(f"SELECT slug, cover_version + CASE WHEN cover_version = 1 THEN 10 ELSE 0 END AS cover_version, md5(data) AS data_md5 FROM ({COVERS}) c WHERE cover_version <> 3")
def cover_store(s: SparkSession, d: str) -> DataFrame:
    """Covers replaced by slug, and the listed ones removed."""
    covers = role(s, d, roles.COVERS).select("slug", F.encode("data", "utf-8").alias("data"), F.lit("text/html").alias("content_type"), "cover_version")
    newer = covers.filter("cover_version = 1").withColumn("cover_version", F.col("cover_version") + 10)
    return store.drop_covers(store.write_covers(newer, covers), covers.filter("cover_version = 3")).select("slug", F.col("cover_version").cast("long").alias("cover_version"), F.md5("data").alias("data_md5"))


@query(f"SELECT id, chapter_label FROM ({LOG}) l WHERE id IN (SELECT page_id FROM pages)")
def replica_scan(s: SparkSession, d: str) -> DataFrame:
    """Two columns of a replica's events with listed ids."""
    folder = _scratch(s, "replica")
    log(s, d).write.parquet(f"{folder}/events")
    return store.read_replica(s, folder, "events", role(s, d, roles.URLS).select("id"), ["id", "chapter_label"])


@query(f"WITH {REPORTS} SELECT report_id::VARCHAR AS report_id, manga_name, chapter_label, source_url, cover_url, series_url, date_trunc('milliseconds', read_at) AS read_at FROM reports")
def report_source(s: SparkSession, d: str) -> DataFrame:
    """Reports written as JSON lines and read with their schema."""
    folder = _scratch(s, "reports")
    _reports(s, d).write.json(folder)
    return store.read_reports(s, folder).select("report_id", "manga_name", "chapter_label", "source_url", "cover_url", "series_url", "read_at")


@query(f"""WITH a AS (SELECT CASE WHEN s_suppkey = 1 THEN 'manhwaweb.com' ELSE 'site' || s_suppkey || '.com' END AS domain, s_name AS title_selector, CAST(s_nationkey AS VARCHAR) AS chapter_selector FROM supplier),
r AS (SELECT * FROM (VALUES {", ".join(f"('{x[0]}', 'rule{i}')" for i, x in enumerate(SITE_RULES))}) v(domain, series_pattern))
SELECT coalesce(r.domain, a.domain) AS domain, series_pattern, title_selector, chapter_selector FROM r FULL OUTER JOIN a ON a.domain = r.domain""")
def site_rules_overlay(s: SparkSession, d: str) -> DataFrame:
    adapters = s.read.parquet(f"{d}/supplier.parquet").select(F.when(F.col("s_suppkey") == 1, "manhwaweb.com").otherwise(F.concat(F.lit("site"), "s_suppkey", F.lit(".com"))).alias("domain"), F.col("s_name").alias("title_selector"), F.col("s_nationkey").cast("string").alias("chapter_selector"))
    rules = s.createDataFrame([(x[0], f"rule{i}", i) for i, x in enumerate(SITE_RULES)], "domain string, series_pattern string, ord int")
    return curate.site_rules(rules, adapters)


@query("SELECT 'events' AS collection, count(*) AS n FROM events UNION ALL SELECT 'series', count(*) FROM orders UNION ALL SELECT 'covers', count(*) FROM pages")
def replica_profile(s: SparkSession, d: str) -> DataFrame:
    return profile.replica_profile({"events": s.read.parquet(f"{d}/events.parquet"), "series": s.read.parquet(f"{d}/orders.parquet"), "covers": s.read.parquet(f"{d}/pages.parquet")})


@query("SELECT count(*) AS n, CAST(sum(strlen(html)) AS BIGINT) AS total_bytes, max(strlen(html)) AS largest_bytes FROM pages")
def cover_bytes(s: SparkSession, d: str) -> DataFrame:
    return profile.cover_bytes(role(s, d, roles.COVERS))


@query(f"SELECT id, series_id, chapter_label, read_at FROM ({LOG}) l ORDER BY read_at DESC, id DESC LIMIT 3")
def newest_readings(s: SparkSession, d: str) -> DataFrame:
    return profile.newest_readings(log(s, d))


@query("""SELECT min(ts) AS start, max(ts) + INTERVAL 5 SECOND AS "end", count(*) AS n FROM
(SELECT ts, sum(CASE WHEN ts <= p + INTERVAL 5 SECOND THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS g FROM (SELECT ts, lag(ts) OVER (ORDER BY ts) AS p FROM events) x) y GROUP BY g""")
def burst_sessions(s: SparkSession, d: str) -> DataFrame:
    return streams.collapse_bursts(s.read.parquet(f"{d}/events.parquet"))


@query(f"WITH r AS (SELECT *, {NUMBER} AS num, CASE WHEN {NUMBER} IS NULL THEN chapter_label END AS txt FROM ({LOG}) l) SELECT id, series_id, num AS chapter_number, source_domain FROM r")
def stream_ingest(s: SparkSession, d: str) -> DataFrame:
    """The log through a stream: conformed micro-batch by micro-batch, appended, and read back; ``stream_reports`` ingests."""
    out = _scratch(s, "ingest")
    rows = streams.read_table_stream(s, d, "events.parquet", s.read.parquet(f"{d}/events.parquet").schema)

    def make(batch: DataFrame) -> DataFrame:
        return library.numbered(batch.sparkSession.sql(roles.LOG, events=batch))

    streams.stream_append(rows, make, f"{out}/log", f"{out}/marks")
    return s.read.parquet(f"{out}/log").select("id", "series_id", "chapter_number", "source_domain")


def _in_files(rows: DataFrame, folder: str, order: str, files: int) -> DataFrame:
    """``rows`` as a stream of that many files, in the order of a column, a micro-batch a file."""
    s = rows.sparkSession
    rows.repartitionByRange(files, order).write.parquet(folder)
    return streams.read_table_stream(s, folder, "*.parquet", rows.schema, files=1)


@query(LIBRARY)
def stream_library(s: SparkSession, d: str) -> DataFrame:
    """The library kept current over several micro-batches of the log."""
    out = _scratch(s, "library")
    kept = streams.stream_library(_in_files(log(s, d), f"{out}/in", "id", 4), registry(s, d), f"{out}/kept", f"{out}/marks")
    return kept.cards()


def _arriving(rows: DataFrame, folder: str, order: str, parts: int) -> Iterator[DataFrame]:
    """``rows`` as a stream whose files arrive part by part, in the order of a column, each after what reads the stream has taken
    the one before. A stream takes the files that are there by the time of their writing, which is not the column's order."""
    s = rows.sparkSession
    files = max(1, int(s.conf.get("spark.sql.shuffle.partitions")) // parts)
    split = rows.repartitionByRange(parts * files, order).withColumn("_part", F.floor(F.spark_partition_id() / files).cast("int"))
    split.write.partitionBy("_part").parquet(f"{folder}-parts")
    whole = s.read.schema(split.schema).parquet(f"{folder}-parts")
    for k in range(parts):
        whole.filter(F.col("_part") == k).drop("_part").write.mode("append").parquet(folder)
        yield streams.read_table_stream(s, folder, "*.parquet", rows.schema, files=(1 << 31) - 1)


@query()
def stream_reports(s: SparkSession, d: str) -> DataFrame:
    """Whole ingestion on a stream of reports, in several micro-batches; tests hold it against one batch."""
    out = _scratch(s, "reports")
    state = _state(s, d)
    for stream in _arriving(_reports(s, d), f"{out}/in", "read_at", 3):
        streams.stream_reports(stream, *state, f"{out}/left", f"{out}/marks")
    return s.read.parquet(f"{out}/left/outcomes").select("report_id", "target", "via", "series_id", "event_id", "created", "cover_changed", "revived", "changed")


def _scratch(s: SparkSession, name: str) -> str:
    import uuid

    checkpoint(s.range(1))  # sets a folder where the cluster has none
    return f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
