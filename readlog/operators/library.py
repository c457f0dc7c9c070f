"""The library and its history, projected from the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlog.functions import text
from readlog.operators.identity import members
from readlog.schemas import MAX_REFERERS


def numbered(log: DataFrame) -> DataFrame:
    """The log with chapter_number and chapter_text, which together are a chapter's key."""
    number = text.chapter_number(F.col("chapter_label"))
    return log.withColumns({"chapter_number": number, "chapter_text": text.unnumbered(F.col("chapter_label"), number)})


#: What one series, site and chapter comes to: its newest event.
CHAPTER_KEY = ("series_id", "source_domain", "chapter_number", "chapter_text")


def newest_by_chapter(log: DataFrame) -> DataFrame:
    """series_id, source_domain, chapter_number, chapter_text, last: the log reduced before it is joined with anything."""
    rows = numbered(log.select("id", "series_id", "chapter_label", "source_url", "source_domain", "read_at"))
    return rows.groupBy(*CHAPTER_KEY).agg(F.max(F.struct("read_at", "id", "chapter_label", "source_url")).alias("last"))


def merged_chapters(rows: DataFrame) -> DataFrame:
    """``newest_by_chapter`` of several parts of a log as that of the whole."""
    return rows.groupBy(*CHAPTER_KEY).agg(F.max("last").alias("last"))


def library(registry: DataFrame, log: DataFrame, domain: str | None = None, since: str | None = None) -> DataFrame:
    """One row a card whose canonical row is alive, newest activity first; see ``project``."""
    return project(registry, newest_by_chapter(log), domain, since)


def project(registry: DataFrame, chapters: DataFrame, domain: str | None = None, since: str | None = None, group: DataFrame | None = None) -> DataFrame:
    """The library of the series in ``chapters`` (see ``newest_by_chapter``).

    The log is reduced to a row a series, site and chapter before it meets its cards, then to one a card, site and chapter,
    one a card and site, and one a card; each is a partial aggregate before its shuffle, so a card with a third of all events is no
    hot key. The filters ask for some event of the card, so they stand after the last aggregate. ``group``: the members
    of those cards that are wanted, or of all.
    """
    group = members(registry) if group is None else group
    ids = group.select(F.col("id").alias("series_id"), "canonical_id")
    by_chapter = chapters.join(ids, "series_id").groupBy("canonical_id", "source_domain", "chapter_number", "chapter_text").agg(F.max("last").alias("last"))
    by_domain = by_chapter.groupBy("canonical_id", "source_domain").agg(
        F.max("last").alias("last"),
        F.max(F.when(F.col("chapter_number").isNotNull(), F.struct("chapter_number", "last.read_at", "last.id", F.col("last.chapter_label").alias("label")))).alias("reached"),
    )
    by_card = by_domain.groupBy("canonical_id").agg(
        F.max(F.struct("last.read_at", "last.id", "last.chapter_label", "last.source_url", "source_domain")).alias("last"),
        F.max("reached").alias("reached"),
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("last.read_at").alias("t"), "source_domain")), asc=False), lambda x: x["source_domain"]).alias("source_domains"),
        F.bool_or(F.col("source_domain") == F.lit(domain)).alias("on_domain"),
    )
    counts = by_chapter.select("canonical_id", "chapter_number", "chapter_text").distinct().groupBy("canonical_id").agg(F.count("*").alias("read_count"))
    aliases = group.groupBy("canonical_id").agg(F.count_if("is_alias").alias("alias_count"))
    cards = group.filter("NOT is_alias AND NOT canonical_deleted").select("canonical_id", F.col("canonical_slug").alias("slug"), "created_ord")
    shown = [x for x in (("canonical_name", F.col("canonical_name")), ("cover_url", F.col("cover_url")), ("status", text.status(F.col("status"))), ("tags", text.tags(F.col("tags")))) if x[0] in registry.columns]
    if "cover_image" in registry.columns:
        shown.append(("has_stored_cover", F.col("cover_image").isNotNull()))
    if shown:  # metadata is the canonical row's
        cards = cards.join(registry.select("slug", *[x.alias(c) for c, x in shown]), "slug")
    rows = cards.join(by_card, "canonical_id", "left").join(counts, "canonical_id", "left").join(aliases, "canonical_id", "left")
    if domain is not None:
        rows = rows.filter("on_domain")
    if since is not None:
        rows = rows.filter(F.col("last.read_at") >= F.lit(since).cast("timestamp"))
    return rows.select(
        "slug",
        F.col("reached.chapter_number").alias("reached_number"), F.col("reached.label").alias("reached_label"),
        F.col("last.chapter_label").alias("last_label"), F.col("last.read_at").alias("last_read_at"), F.col("last.source_url").alias("last_source_url"),
        F.coalesce("read_count", F.lit(0)).alias("read_count"),
        F.coalesce("source_domains", F.array().cast("array<string>")).alias("source_domains"),
        "alias_count", "created_ord", *[c for c, _ in shown],
    ).orderBy(F.col("last_read_at").desc_nulls_last(), "created_ord")


def history(registry: DataFrame, log: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row a chapter of a living card: its earliest event, and where else it was read, in order of first reading."""
    group = members(registry).filter("NOT canonical_deleted")
    if ids is not None:
        group = group.join(group.join(ids.select("id"), "id", "left_semi").select("canonical_id").distinct(), "canonical_id", "left_semi")
    # a series' chapters are reduced before they meet their card
    own = numbered(log.select("id", "series_id", "chapter_label", "source_domain", "read_at")).groupBy(*CHAPTER_KEY).agg(F.min(F.struct("read_at", "id", "chapter_label")).alias("first"))
    key = ["canonical_slug", "chapter_number", "chapter_text"]
    first = own.join(group.select(F.col("id").alias("series_id"), "canonical_slug"), "series_id").groupBy(*key, "source_domain").agg(F.min("first").alias("first"))
    kept = first.groupBy(*key).agg(F.min(F.struct("first.read_at", "first.id", "first.chapter_label", "source_domain")).alias("kept"), F.sort_array(F.collect_list(F.struct("first.read_at", "first.id", "source_domain"))).alias("seen"))
    others = F.filter(F.transform("seen", lambda x: x["source_domain"]), lambda d: d != F.col("kept.source_domain"))
    return kept.select(F.col("canonical_slug").alias("slug"), F.col("kept.id").alias("id"), F.col("kept.chapter_label").alias("chapter_label"), "chapter_number", F.col("kept.source_domain").alias("source_domain"), F.col("kept.read_at").alias("read_at"), others.alias("also_read_on"))


def aliases(registry: DataFrame) -> DataFrame:
    """canonical_slug, slug, ordinal: canonical first, then what it absorbed."""
    order = W.partitionBy("canonical_slug").orderBy("is_alias", "created_ord", "slug")
    return members(registry).select("canonical_slug", "slug", (F.row_number().over(order) - 1).cast("long").alias("ordinal"))


def cover_fetch_plan(cards: DataFrame) -> DataFrame:
    """slug, source, url, referers: stored bytes, or a URL with the latest domains as referers, then none.

    ``cards``: slug, cover_url, has_bytes, source_domains (latest first).
    """
    http = F.col("cover_url").rlike(r"^(?i)https?://[^/?#\s]+")
    origin = F.regexp_extract("cover_url", r"^(?i)(https?://[^/?#]+)", 1)
    sites = F.transform(F.slice("source_domains", 1, MAX_REFERERS), lambda d: F.concat(F.lit("https://"), d, F.lit("/")))
    tries = F.when(F.size("source_domains") > 0, sites).otherwise(F.array(F.concat(origin, F.lit("/"))))
    rows = cards.withColumn("source", F.when(F.col("has_bytes"), "stored").when(http, "fetch")).filter("source IS NOT NULL")
    fetch = F.col("source") == "fetch"
    return rows.select("slug", "source", F.when(fetch, F.col("cover_url")).alias("url"), F.when(fetch, F.array_append(tries, F.lit(""))).otherwise(F.array().cast("array<string>")).alias("referers"))
