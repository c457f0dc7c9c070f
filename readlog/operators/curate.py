"""Bulk change-sets: edits, covers, deletions, merges, dismissals, site configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlog.functions import text
from readlog.operators.identity import members, pair_key
from readlog.schemas import MAX_COVER_BYTES
from readlog.sources.store import checkpoint


def _to_canonical(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes by any member's id, under the canonical id of a living card."""
    alive = members(registry).filter("NOT canonical_deleted").select("id", "canonical_id")
    return changes.join(alive, "id").drop("id").withColumnRenamed("canonical_id", "id")


def _stamped(registry: DataFrame, touched: Column, at: Column) -> dict[str, Column]:
    """A touched row's clock goes to ``at``, so that its change wins over older rows of other replicas."""
    return {"updated_at": F.when(touched, at).otherwise(F.col("updated_at"))} if "updated_at" in registry.columns else {}


EDITABLE = ("canonical_name", "status", "cover_url", "tags")


def apply_edits(registry: DataFrame, edits: DataFrame, at: Column) -> DataFrame:
    """Registry after edits. ``edits``: id, seq, fields array<string>, and the fields of EDITABLE that occur; only named
    fields change. A named cover_url, even null, drops the bytes and their type and raises the version."""
    known = [c for c in EDITABLE if c in edits.columns and c in registry.columns]
    last = _to_canonical(registry, edits).filter(F.size("fields") > 0)
    pick = [F.max_by(c, F.when(F.array_contains("fields", c), F.col("seq"))).alias(f"new_{c}") for c in known]
    has = [F.bool_or(F.array_contains("fields", c)).alias(f"has_{c}") for c in known]
    by_id = last.groupBy("id").agg(*pick, *has, F.count_if(F.array_contains("fields", "cover_url")).alias("covers"))
    joined = registry.join(by_id, "id", "left")
    value = {}
    for c in known:
        new = F.trim(f"new_{c}") if c == "canonical_name" else F.col(f"new_{c}")
        value[c] = F.when(F.coalesce(f"has_{c}", F.lit(False)), new).otherwise(F.col(c))
    if "cover_version" in registry.columns:
        value["cover_version"] = F.col("cover_version") + F.coalesce("covers", F.lit(0))
    for c in ("cover_image", "cover_image_type"):
        if c in registry.columns:
            value[c] = F.when(F.coalesce("covers", F.lit(0)) == 0, F.col(c))
    value |= _stamped(registry, F.col("covers").isNotNull(), at)
    return joined.withColumns(value).select(*registry.columns)


def check_edits(edits: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """edits with ``error``, null if accepted: some field is named, a named name isn't blank, and, if a registry is
    given, the id is that of a living card's row."""
    blank = F.array_contains("fields", "canonical_name") & (F.trim(F.coalesce("canonical_name", F.lit(""))) == "")
    error = F.when(F.size("fields") == 0, "nothing").when(blank, "name")
    if registry is None:
        return edits.withColumn("error", error)
    alive = members(registry).filter("NOT canonical_deleted").select(F.col("id").alias("_id"))
    joined = edits.join(alive, edits["id"] == F.col("_id"), "left")
    return joined.withColumn("error", error.when(F.col("_id").isNull(), "not_found")).drop("_id")


def check_covers(uploads: DataFrame) -> DataFrame:
    """uploads (data, content_type) with ``error``, null if accepted."""
    kind = F.coalesce(F.col("content_type").startswith("image/"), F.lit(False))
    size = F.coalesce(F.octet_length("data"), F.lit(0))
    return uploads.withColumn("error", F.when(~kind, "type").when(size == 0, "empty").when(size > MAX_COVER_BYTES, "size"))


def apply_covers(registry: DataFrame, uploads: DataFrame, at: Column) -> DataFrame:
    """Registry with the bytes of accepted ``uploads`` (id, seq, data, content_type); each raises the card's version."""
    good = _to_canonical(registry, check_covers(uploads).filter("error IS NULL"))
    by_id = good.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct("data", "content_type"), "seq").alias("_cover"), F.count("*").alias("_n"))
    joined = registry.join(by_id, registry["id"] == F.col("_id"), "left")
    named = F.col("_id").isNotNull()
    values = {
        "cover_image": F.when(named, F.col("_cover.data")).otherwise(F.col("cover_image")),
        "cover_image_type": F.when(named, F.col("_cover.content_type")).otherwise(F.col("cover_image_type")),
        "cover_version": F.col("cover_version") + F.coalesce("_n", F.lit(0)).cast("int"),
    }
    return joined.withColumns(values | _stamped(registry, named, at)).select(*registry.columns)


def apply_deletes(registry: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """All rows of the living cards that an id names get one deletion time."""
    group = members(registry).filter("NOT canonical_deleted")
    cards = group.join(ids.select("id"), "id", "left_semi").select("canonical_id").distinct()
    gone = group.join(cards, "canonical_id", "left_semi").select(F.col("id").alias("_id"))
    joined = registry.join(gone, registry["id"] == F.col("_id"), "left")
    named = F.col("_id").isNotNull()
    return joined.withColumns({"deleted_at": F.when(named, at).otherwise(F.col("deleted_at"))} | _stamped(registry, named, at)).select(*registry.columns)


def _tag_list(registry: DataFrame) -> Column:
    kind = registry.schema["tags"].dataType.simpleString()
    return F.col("tags") if kind.startswith("array") else text.tags(F.col("tags"))


def apply_merges(registry: DataFrame, merges: DataFrame, at: Column) -> DataFrame:
    """Registry after ``merges`` (survivor, absorbed: ids; seq: their order); see ``merged``."""
    return merged(registry, merges, at)[0]


def merged(registry: DataFrame, merges: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Registry after ``merges`` (survivor, absorbed: ids; seq: their order), and survivor, absorbed, seq, outcome of each: merged,
    already-merged or not-found, and ``missing``, the id that wasn't.

    A merge takes both ids to their cards at that time; all rows of the absorbed card point to the survivor's canonical
    row, which takes over the cover if it has none, the tags that it lacks, and life if it was deleted and the absorbed
    card wasn't. Its own pointer stays as it is. Each round applies the merges that come first for both of their cards,
    which don't touch one another; so rounds are as many as the longest chain of merges that build on each other.
    """
    group = checkpoint(members(registry))
    has = {c: c in registry.columns for c in ("cover_url", "cover_version", "tags")}
    fields = {
        "cover": F.col("cover_url") if has["cover_url"] else F.lit(None).cast("string"),
        "tag_list": _tag_list(registry) if has["tags"] else F.array().cast("array<string>"),
        "deleted": F.col("deleted_at"), "raised": F.lit(0), "touched": F.lit(False),
    }
    tops = registry.join(group.filter("NOT is_alias").select("slug"), "slug", "left_semi")
    state = checkpoint(tops.select(F.col("slug").alias("card"), *[x.alias(c) for c, x in fields.items()]))
    card = group.select("id", F.col("canonical_slug").alias("card"))
    order = F.col("seq") if "seq" in merges.columns else F.struct("survivor", "absorbed")
    left = merges.select("survivor", "absorbed", order.alias("seq"))
    for side in ("survivor", "absorbed"):
        left = left.join(card.select(F.col("id").alias(side), F.col("card").alias(f"{side}_card")), side, "left")
    told = ["survivor", "absorbed", "seq"]
    asked = checkpoint(left.select(*told, F.col("survivor_card").alias("s"), F.col("absorbed_card").alias("a")))
    outcome = lambda df, name: df.select(*told, F.lit(name).alias("outcome"), F.lit(None).cast(registry.schema["id"].dataType).alias("missing"))
    unknown = asked.filter("s IS NULL OR a IS NULL")
    results = outcome(unknown, "not-found").drop("missing").join(unknown.select(*told, F.when(F.col("s").isNull(), F.col("survivor")).otherwise(F.col("absorbed")).alias("missing")), told)
    results = results.unionByName(outcome(asked.filter("s = a"), "already-merged"))
    pending, moved = asked.filter("s <> a"), None
    while not pending.isEmpty():
        least = pending.select(F.explode(F.array("s", "a")).alias("card"), "seq").groupBy("card").agg(F.min("seq").alias("least"))
        first = lambda side: least.select(F.col("card").alias(side), F.col("least").alias(f"least_{side}"))  # noqa: B023, E731
        ready = pending.join(first("s"), "s").join(first("a"), "a").filter("seq = least_s AND seq = least_a").select("s", "a", *told)
        ready = checkpoint(ready)
        results = results.unionByName(outcome(ready, "merged"))
        pending = pending.join(ready.select("seq"), "seq", "left_anti")
        other = state.select(F.col("card").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("cover", "tag_list", "deleted")])
        joined = state.join(ready.select(F.col("s").alias("card"), "a").join(other, "a"), "card", "left")
        takes = F.col("a").isNotNull() & F.col("cover").isNull() & F.col("a_cover").isNotNull()
        revives = F.col("a").isNotNull() & F.col("deleted").isNotNull() & F.col("a_deleted").isNull()
        state = checkpoint(joined.select(
            "card", F.when(takes, F.col("a_cover")).otherwise(F.col("cover")).alias("cover"),
            F.when(F.col("a").isNull(), F.col("tag_list")).otherwise(F.array_distinct(F.concat("tag_list", "a_tag_list"))).alias("tag_list"),
            F.when(~revives, F.col("deleted")).alias("deleted"), (F.col("raised") + takes.cast("int")).alias("raised"), (F.col("touched") | F.col("a").isNotNull()).alias("touched"),
        ))
        to = ready.select(F.col("a").alias("_from"), F.col("s").alias("_to"))
        follow = lambda df, c: df.join(to, F.col(c) == F.col("_from"), "left").withColumn(c, F.coalesce("_to", c)).drop("_from", "_to")  # noqa: B023, E731
        new = ready.select(F.col("a").alias("card"), F.col("s").alias("survivor"))
        moved = checkpoint(new if moved is None else follow(moved, "survivor").unionByName(new))
        pending = checkpoint(follow(follow(pending, "s"), "a"))
        results = results.unionByName(outcome(pending.filter("s = a"), "already-merged"))
        pending = pending.filter("s <> a")
    if moved is None:
        return registry, results
    pointed = group.join(moved, group["canonical_slug"] == moved["card"]).select(F.col("slug").alias("_slug"), F.col("survivor").alias("_survivor"))
    joined = registry.join(pointed, registry["slug"] == F.col("_slug"), "left").join(state.filter("touched"), registry["slug"] == F.col("card"), "left")
    survives = F.col("card").isNotNull()
    values = {"merged_into_slug": F.coalesce("_survivor", "merged_into_slug"), "deleted_at": F.when(survives, F.col("deleted")).otherwise(F.col("deleted_at"))}
    if has["cover_url"]:
        values["cover_url"] = F.when(survives, F.col("cover")).otherwise(F.col("cover_url"))
    if has["cover_version"]:
        values["cover_version"] = F.col("cover_version") + F.coalesce("raised", F.lit(0))
    if has["tags"]:
        kind = registry.schema["tags"].dataType.simpleString()
        values["tags"] = F.when(survives, F.col("tag_list") if kind.startswith("array") else F.to_json("tag_list")).otherwise(F.col("tags"))
    return joined.withColumns(values | _stamped(registry, survives | F.col("_slug").isNotNull(), at)).select(*registry.columns), results


def delete_outcomes(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """id, seq, deleted for each of ``ids`` (id, seq): whether it deleted a card. An unknown id, and one whose card is deleted by then, as
    by an earlier id of the same card, did not."""
    cards = members(registry).filter("NOT canonical_deleted").select("id", "canonical_id")
    named = ids.select("id", "seq").join(cards, "id", "left")
    first = named.filter("canonical_id IS NOT NULL").groupBy("canonical_id").agg(F.min("seq").alias("first"))
    return named.join(first, "canonical_id", "left").select("id", "seq", F.coalesce(F.col("seq") == F.col("first"), F.lit(False)).alias("deleted"))


def unmerge_outcomes(registry: DataFrame, ids: DataFrame) -> DataFrame:
    """id, seq, outcome for each of ``ids`` (id, seq): unmerged, not-merged (also where an earlier one did it) or not-found."""
    rows = registry.select("id", F.col("merged_into_slug").isNotNull().alias("pointed"))
    first = ids.groupBy("id").agg(F.min("seq").alias("first"))
    named = ids.select("id", "seq").join(first, "id").join(rows, "id", "left")
    outcome = F.when(F.col("pointed").isNull(), "not-found").when(F.col("pointed") & (F.col("seq") == F.col("first")), "unmerged").otherwise("not-merged")
    return named.select("id", "seq", outcome.alias("outcome"))


def apply_unmerges(registry: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """The pointer of these rows goes; ``was_merged`` is false for those that had none."""
    joined = registry.join(ids.select(F.col("id").alias("_id")).distinct(), registry["id"] == F.col("_id"), "left")
    named = F.col("_id").isNotNull()
    was = F.when(named, F.col("merged_into_slug").isNotNull())
    values = {"was_merged": was, "merged_into_slug": F.when(~named, F.col("merged_into_slug"))}
    return joined.withColumns(values | _stamped(registry, F.coalesce(was, F.lit(False)), at)).drop("_id")


def apply_dismissals(current: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ordered pairs, each once: first creation and last update."""
    a, b = pair_key(F.col("slug_a"), F.col("slug_b"))
    ordered = current.unionByName(pairs).filter("slug_a <> slug_b").select(a.alias("slug_a"), b.alias("slug_b"), "created_at", "updated_at")
    return ordered.groupBy("slug_a", "slug_b").agg(F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def apply_adapters(current: DataFrame, changes: DataFrame, order: str) -> DataFrame:
    """Replace whole rows by lower-case domain; the last change of a domain counts."""
    fields = [c for c in current.columns if c != "domain"]
    last = changes.withColumn("domain", F.lower("domain")).groupBy("domain").agg(F.max_by(F.struct(*fields), order).alias("r")).select("domain", "r.*")
    return current.join(last.select("domain"), "domain", "left_anti").unionByName(last)


def list_adapters(adapters: DataFrame) -> DataFrame:
    """All adapters by domain."""
    return adapters.orderBy("domain")


def adapter_of(urls: DataFrame, adapters: DataFrame, column: str = "url") -> DataFrame:
    """``urls`` with ``domain`` and the adapter of exactly that domain, nulls where there is none."""
    fields = [c for c in ("title_selector", "chapter_selector", "chapter_url_regex") if c in adapters.columns]
    keyed = adapters.select(F.lower("domain").alias("domain"), *fields)
    return urls.withColumn("domain", text.domain(F.col(column))).join(keyed, "domain", "left")


def site_rules(rules: DataFrame, adapters: DataFrame) -> DataFrame:
    """domain, series_pattern, title_selector, chapter_selector: curated rows first, overlaid by calibrations; the
    curated series rule survives."""
    joined = rules.join(adapters.select("domain", "title_selector", "chapter_selector"), "domain", "full_outer")
    return joined.orderBy(F.col("ord").asc_nulls_last(), "domain").select("domain", "series_pattern", "title_selector", "chapter_selector")
