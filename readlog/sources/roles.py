"""The driver's tables in the roles of the engine, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOG = """SELECT event_id AS id, user_id AS series_id,
       CASE event_type WHEN 'click' THEN concat('Cap. ', k) WHEN 'view' THEN concat('Chapter ', k) WHEN 'purchase' THEN concat('Ch. ', k, '.5')
                       WHEN 'signup' THEN concat('Capítulo ', k) ELSE 'Extra Omake' END AS chapter_label,
       concat('https://', event_type, '.example.com/s/', user_id, '/', k) AS source_url,
       concat(event_type, '.example.com') AS source_domain, ts AS read_at
FROM (SELECT *, regexp_extract(props, '[0-9]+', 0) AS k FROM {events}) e"""
REGISTRY = """SELECT id, concat('series-', id) AS slug, id AS created_ord,
       CASE WHEN id = 10 THEN 'series-11' WHEN id = 11 THEN 'series-10' WHEN id = 12 THEN 'series-10' WHEN id % 7 = 1 THEN 'series-missing'
            WHEN id % 3 = 0 AND id > 0 THEN concat('series-', CAST(floor(id / 3) AS BIGINT)) END AS merged_into_slug,
       CASE WHEN id % 13 = 5 THEN TIMESTAMP '2024-02-01 00:00:00' END AS deleted_at
FROM (SELECT DISTINCT user_id AS id FROM {events}) u"""
#: Whole first lines of documents, and whole titles of web pages.
LINES = "SELECT doc_id AS id, split_part(text, chr(10), 1) AS canonical_name FROM {documents}"
TITLES = "SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS canonical_name FROM {pages}"
#: The registry with the columns that curation changes.
CARDS = f"""SELECT r.*, concat('Series ', id) AS canonical_name, CASE WHEN id % 2 = 0 THEN concat('https://img.example.com/', id) END AS cover_url, CAST(id % 4 AS INT) AS cover_version,
       CASE id % 4 WHEN 1 THEN 'completed' WHEN 2 THEN 'dropped' ELSE 'reading' END AS status, concat('["t', id % 3, '","favs"]') AS tags,
       TIMESTAMP '2024-01-15 00:00:00' AS created_at, TIMESTAMP '2024-01-20 00:00:00' AS updated_at FROM ({REGISTRY}) r"""
#: Series whose log starts with a click.
CLICKED = "SELECT user_id AS id FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {events}) e WHERE rn = 1 AND event_type = 'click'"
ADAPTERS = """SELECT CAST(s_suppkey AS STRING) AS id, concat('site', s_suppkey, '.com') AS domain, s_name AS title_selector, CASE WHEN s_nationkey % 2 = 0 THEN concat('n', s_nationkey) END AS chapter_selector,
       CAST(NULL AS STRING) AS chapter_url_regex, TIMESTAMP '2024-01-15 00:00:00' AS created_at, TIMESTAMP '2024-01-20 00:00:00' AS updated_at FROM {supplier}"""
SHORT_TITLES = "SELECT DISTINCT replace(p_name, ' ', '-') AS slug FROM {part}"
URLS = "SELECT page_id AS id, url FROM {pages}"
COVERS = "SELECT concat('page-', page_id) AS slug, page_id % 4 AS cover_version, html AS data FROM {pages}"
LOCAL = "SELECT o_orderkey AS slug, o_orderstatus AS status, o_totalprice AS value, o_custkey % 5 AS updated_at FROM {orders} WHERE o_orderkey % 10 < 7"
REMOTE = "SELECT o_orderkey AS slug, o_orderpriority AS status, o_totalprice + 1 AS value, o_orderkey % 5 AS updated_at FROM {orders} WHERE o_orderkey % 10 > 3"
EVENTS_A = "SELECT event_id AS id, user_id AS series_id, ts AS read_at FROM {events} WHERE event_id % 3 <> 0"
EVENTS_B = "SELECT event_id AS id, user_id AS series_id, ts AS read_at FROM {events} WHERE event_id % 3 <> 1"
TABLES = ("events", "documents", "part", "pages", "orders", "supplier", "customer")


def role(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def plain(sql: str) -> str:
    """The same text for an engine in which the tables are views."""
    return sql.format(**{t: t for t in TABLES})
