"""Replica documents: JSON rows coerced to fixed schemas, and rows exported as documents.

A document is one JSON text a row. Wrong types give defaults rather than errors: "" or null for strings, 0 for
integers, ``reading`` for the status, the epoch for times, and null for a deletion time that can't be read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlog.functions import text

EPOCH = "1970-01-01 00:00:00"


def _field(doc: Column, name: str) -> Column:
    return F.try_variant_get(doc, f"$.{name}", "variant")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def string(doc: Column, name: str, default: str | None = None) -> Column:
    value = _field(doc, name)
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.lit(default).cast("string"))


def number(doc: Column, name: str) -> Column:
    value = _field(doc, name)
    found = F.when(_kind(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), F.try_variant_get(value, "$", "double"))
    return F.when(~F.isnan(found) & (F.abs(found) != float("inf")), found)


def integer(doc: Column, name: str) -> Column:
    return F.coalesce(number(doc, name).cast("long"), F.lit(0).cast("long"))


def time(doc: Column, name: str) -> Column:
    """ISO text, or milliseconds as a number; the epoch if neither."""
    parsed = F.try_to_timestamp(F.regexp_replace(string(doc, name), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})$", "$1T00:00:00Z"))
    return F.coalesce(parsed, F.timestamp_millis(number(doc, name).cast("long")), F.lit(EPOCH).cast("timestamp"))


def nullable_time(doc: Column, name: str) -> Column:
    return F.nullif(time(doc, name), F.lit(EPOCH).cast("timestamp"))


def series_docs(docs: DataFrame, column: str = "doc") -> DataFrame:
    d = F.try_parse_json(column)
    tags = F.coalesce(F.to_json(_field(d, "tags")), F.lit(""))
    return docs.select(
        string(d, "_id", "").alias("slug"), string(d, "canonicalName", "").alias("canonical_name"), string(d, "coverUrl").alias("cover_url"),
        string(d, "coverImageType").alias("cover_image_type"), integer(d, "coverVersion").alias("cover_version"), text.status(string(d, "status", "")).alias("status"), text.tags(tags).alias("tags"),
        time(d, "createdAt").alias("created_at"), time(d, "updatedAt").alias("updated_at"), nullable_time(d, "deletedAt").alias("deleted_at"),
        string(d, "mergedIntoSlug").alias("merged_into_slug"),
    )


def event_docs(docs: DataFrame, column: str = "doc") -> DataFrame:
    d = F.try_parse_json(column)
    return docs.select(
        string(d, "_id", "").alias("id"), string(d, "mangaSlug", "").alias("series_slug"), string(d, "chapterLabel", "").alias("chapter_label"), number(d, "chapterNumber").alias("chapter_number"),
        string(d, "sourceUrl", "").alias("source_url"), string(d, "sourceDomain", "").alias("source_domain"), time(d, "readAt").alias("read_at"), string(d, "seriesKey").alias("series_key"),
    )


def adapter_docs(docs: DataFrame, column: str = "doc") -> DataFrame:
    d = F.try_parse_json(column)
    return docs.select(
        F.coalesce(string(d, "id"), string(d, "_id", "")).alias("id"), string(d, "_id", "").alias("domain"), string(d, "titleSelector", "").alias("title_selector"),
        string(d, "chapterSelector").alias("chapter_selector"), string(d, "chapterUrlRegex").alias("chapter_url_regex"), time(d, "createdAt").alias("created_at"), time(d, "updatedAt").alias("updated_at"),
    )


def dismissal_docs(docs: DataFrame, column: str = "doc") -> DataFrame:
    d = F.try_parse_json(column)
    rows = docs.select(string(d, "slugA", "").alias("slug_a"), string(d, "slugB", "").alias("slug_b"), time(d, "createdAt").alias("created_at"))
    return rows.filter("slug_a <> '' AND slug_b <> '' AND slug_a <> slug_b")


def cover_docs(docs: DataFrame, column: str = "doc") -> DataFrame:
    d = F.try_parse_json(column)
    data = F.coalesce(string(d, "data"), string(d, "data.base64"))
    rows = docs.select(string(d, "_id", "").alias("slug"), F.try_to_binary(data, F.lit("base64")).alias("data"), string(d, "contentType", "").alias("content_type"), integer(d, "coverVersion").alias("cover_version"))
    return rows.filter("data IS NOT NULL")


def _doc(**fields: Column) -> Column:
    """A JSON document; fields without a value are null in it."""
    return F.to_json(F.struct(*[x.alias(c) for c, x in fields.items()]), {"ignoreNullFields": "false"}).alias("doc")


def export_events(events: DataFrame, registry: DataFrame) -> DataFrame:
    """id and JSON document of each event, with its series as a slug."""
    named = events.join(registry.select(F.col("id").alias("series_id"), F.col("slug").alias("_slug")), "series_id")
    number = F.col("chapter_number") if "chapter_number" in events.columns else text.chapter_number(F.col("chapter_label"))
    key = F.col("series_key") if "series_key" in events.columns else F.lit(None).cast("string")
    doc = _doc(
        _id=F.col("id").cast("string"), mangaSlug=F.col("_slug"), chapterLabel=F.col("chapter_label"), chapterNumber=number, sourceUrl=F.col("source_url"), sourceDomain=F.col("source_domain"),
        readAt=text.iso(F.col("read_at")), seriesKey=key,
    )
    return named.select("id", doc)


def export_series(registry: DataFrame) -> DataFrame:
    """slug and JSON document of each row; a flag stands for cover bytes."""
    tags = F.col("tags") if registry.schema["tags"].dataType.simpleString().startswith("array") else text.tags(F.col("tags"))
    bytes_ = F.col("cover_image").isNotNull() if "cover_image" in registry.columns else F.lit(False)
    kind = F.col("cover_image_type") if "cover_image_type" in registry.columns else F.lit(None).cast("string")
    doc = _doc(
        _id=F.col("slug"), id=F.col("id").cast("string"), coverImageType=kind, canonicalName=F.col("canonical_name"), coverUrl=F.col("cover_url"), hasStoredCover=bytes_, coverVersion=F.col("cover_version"), status=text.status(F.col("status")), tags=tags,
        createdAt=text.iso(F.col("created_at")), updatedAt=text.iso(F.col("updated_at")), deletedAt=text.iso(F.col("deleted_at")), mergedIntoSlug=F.col("merged_into_slug"),
    )
    return registry.select("slug", doc)


def export_pairs(dismissals: DataFrame) -> DataFrame:
    key = F.concat_ws("|", "slug_a", "slug_b")
    return dismissals.select(key.alias("id"), _doc(_id=key, slugA=F.col("slug_a"), slugB=F.col("slug_b"), createdAt=text.iso(F.col("created_at"))))


def export_adapters(adapters: DataFrame) -> DataFrame:
    doc = _doc(
        _id=F.col("domain"), id=F.col("id"), titleSelector=F.col("title_selector"), chapterSelector=F.col("chapter_selector"), chapterUrlRegex=F.col("chapter_url_regex"),
        createdAt=text.iso(F.col("created_at")), updatedAt=text.iso(F.col("updated_at")),
    )
    return adapters.select(F.col("domain").alias("id"), doc)


def export_covers(covers: DataFrame) -> DataFrame:
    return covers.select("slug", F.to_json(F.struct(F.col("slug").alias("_id"), F.base64("data").alias("data"), F.col("content_type").alias("contentType"), F.col("cover_version").alias("coverVersion"))).alias("doc"))


def present_series(registry: DataFrame) -> DataFrame:
    """Public shape of registry rows: decoded tags, checked status, ISO times, a flag for bytes; no bytes."""
    return registry.select(
        "id", F.col("canonical_name").alias("canonicalName"), F.col("slug").alias("normalizedSlug"), F.col("cover_url").alias("coverUrl"), F.col("cover_version").alias("coverVersion"),
        F.col("cover_image").isNotNull().alias("hasStoredCover"), text.status(F.col("status")).alias("status"), text.tags(F.col("tags")).alias("tags"), text.iso(F.col("created_at")).alias("createdAt"),
        F.col("merged_into_slug").alias("mergedIntoSlug"),
    )


def present_events(events: DataFrame) -> DataFrame:
    """Public shape of events; the series key stays inside."""
    number = text.chapter_number(F.col("chapter_label"))
    return events.select("id", "series_id", "chapter_label", number.alias("chapter_number"), "source_url", "source_domain", text.iso(F.col("read_at")).alias("read_at"))
