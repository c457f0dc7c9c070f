"""Which rows of the registry are one series: merge pointers, groups, and the targets of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlog.schemas import MAX_HOPS
from readlog.sources.store import checkpoint


def resolve_canonical(registry: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """slug, canonical_slug: follow merged_into_slug.

    A null or dangling pointer ends at the current row. A way that comes upon a row again has no end, and one of ``hops``
    steps or more is too long: both end at the start. So pointers are doubled, with the steps that each stands for, until they
    span ``hops`` steps (5 jobs for 16) or none moves, and count where they stand at an end and the way was short enough.
    """
    nodes = registry.select("slug", F.col("merged_into_slug").alias("to"))
    edges = checkpoint(nodes.join(nodes.select(F.col("slug").alias("to")), "to", "left_semi").select("slug", "to", F.lit(1).alias("steps")))
    way, span = edges, 1
    while span < hops:
        ahead = way.select(F.col("slug").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        further = F.col("next").isNotNull()
        joined = way.join(ahead, "to", "left").select("slug", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), further.alias("moved"))
        joined = checkpoint(joined)
        way, span = joined.drop("moved"), 2 * span
        if joined.filter("moved").isEmpty():
            break
    ends = way.filter(F.col("steps") < hops).join(edges.select(F.col("slug").alias("to")), "to", "left_anti").select("slug", "to")
    return registry.select("slug").join(ends, "slug", "left").select("slug", F.coalesce("to", "slug").alias("canonical_slug"))


def members(registry: DataFrame) -> DataFrame:
    """id, slug, canonical_id, canonical_slug, is_alias, created_ord, canonical_ord, canonical_deleted: one row a row."""
    resolved = resolve_canonical(registry)
    top = registry.select(F.col("slug").alias("canonical_slug"), F.col("id").alias("canonical_id"), F.col("created_ord").alias("canonical_ord"), F.col("deleted_at").isNotNull().alias("canonical_deleted"))
    named = registry.select("id", "slug", "created_ord").join(resolved, "slug").join(top, "canonical_slug")
    return named.withColumn("is_alias", F.col("slug") != F.col("canonical_slug"))


def series_groups(registry: DataFrame) -> DataFrame:
    """canonical_slug, member_slugs (canonical first, then aliases in input order), n_aliases."""
    rows = members(registry).groupBy("canonical_slug").agg(F.sort_array(F.collect_list(F.struct("is_alias", "created_ord", "slug"))).alias("m"))
    return rows.select("canonical_slug", F.col("m.slug").alias("member_slugs"), (F.size("m") - 1).cast("long").alias("n_aliases"))


def canonical_of(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """id, canonical_id for any member ids."""
    return members(registry).join(ids.select("id").distinct(), "id", "left_semi").select("id", "canonical_id")


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def owner_by_series_key(log: DataFrame, registry: DataFrame) -> DataFrame:
    """series_key, canonical_slug of the latest event with the key; none if that event's row is gone."""
    latest = log.filter(F.col("series_key").isNotNull()).groupBy("series_key").agg(F.max_by("series_id", F.struct("read_at", "id")).alias("id"))
    return latest.join(members(registry).select("id", "canonical_slug"), "id").select("series_key", "canonical_slug")
