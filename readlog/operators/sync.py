"""Convergence of replicas: last write wins for rows, union for events, versions for covers, deletion as a value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readlog.sources.store import checkpoint


def merge_lww(local: DataFrame, remote: DataFrame, key: str, clock: str = "updated_at", local_only: tuple[str, ...] = ()) -> DataFrame:
    """All keys of both; a strictly newer remote row replaces the local one but for ``local_only`` columns. ``moved`` says what came."""
    columns = [c for c in local.columns if c != key]
    a, b = local.alias("a"), remote.filter(F.col(key).cast("string") != "").alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    new, newer = F.col(f"a.{key}").isNull(), F.col(f"b.{clock}") > F.col(f"a.{clock}")
    take = new | F.coalesce(newer, F.lit(False))
    pick = lambda c: F.when(new, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in local_only else F.when(take, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[pick(c).alias(c) for c in columns], F.when(new, "inserted").when(take, "updated").otherwise("kept").alias("moved"))


def push_diff(local: DataFrame, remote: DataFrame, key: str, clock: str = "updated_at") -> DataFrame:
    """Local rows that the remote lacks or holds an older version of."""
    b = remote.select(F.col(key).alias("_k"), F.col(clock).alias("_t"))
    return local.join(b, local[key] == F.col("_k"), "left").filter(F.col("_k").isNull() | (F.col(clock) > F.col("_t"))).drop("_k", "_t")


def event_union(local: DataFrame, remote: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Local events and those of the remote's that are missing here; ids of series come from slugs if a registry is given."""
    new = remote.filter(F.col("id").cast("string") != "").join(local.select("id"), "id", "left_anti").dropDuplicates(["id"])
    if registry is not None:
        new = new.join(registry.select(F.col("slug").alias("series_slug"), F.col("id").alias("series_id")), "series_slug").drop("series_slug")
    return local.unionByName(new)


def missing_remotely(local: DataFrame, remote: DataFrame, *keys: str) -> DataFrame:
    return local.join(remote.select(*keys), list(keys), "left_anti")


def dismissal_union(local: DataFrame, remote: DataFrame) -> DataFrame:
    new = remote.filter("slug_a <> '' AND slug_b <> '' AND slug_a <> slug_b").join(local, ["slug_a", "slug_b"], "left_anti").dropDuplicates(["slug_a", "slug_b"])
    return local.unionByName(new.withColumn("updated_at", F.col("created_at")).select(*local.columns))


def cover_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """slug, action by versions alone, without bytes: pull if the remote is newer or there are none here, push if versions differ.

    A slug that is pulled has the remote's version then, so it isn't pushed.
    """
    a, b = local.select("slug", F.col("cover_version").alias("here")), remote.select("slug", F.col("cover_version").alias("there"))
    joined = a.join(b, "slug", "full_outer")
    action = F.when(F.col("there").isNotNull() & (F.col("here").isNull() | (F.col("there") > F.col("here"))), "pull").when(F.col("here").isNotNull() & (F.col("there").isNull() | (F.col("there") != F.col("here"))), "push")
    return joined.withColumn("action", action).filter("action IS NOT NULL").select("slug", "action")


def cleared_covers(local_covers: DataFrame, remote_covers: DataFrame, remote_series: DataFrame) -> DataFrame:
    """Slugs of remote covers to delete: no bytes here, and the remote series says that they were cleared (version above 0)."""
    gone = remote_covers.select("slug").join(local_covers.select("slug"), "slug", "left_anti")
    return gone.join(remote_series.filter("cover_version > 0").select("slug"), "slug", "left_semi").distinct()


def restore(local: dict[str, DataFrame], remote: dict[str, DataFrame], force: bool = False) -> dict[str, DataFrame]:
    """The remote's tables in place of local ones, by a sync into empty tables, with all of its covers; refused while
    local series, events or adapters exist, unless forced."""
    if not force and any(not local[k].isEmpty() for k in ("series", "events", "adapters") if k in local):
        raise ValueError("local data exists; pass force=True to replace it")
    empty = {k: df.filter("false") for k, df in local.items()}
    out = {k: df for k, df in sync(empty, remote).items() if not k.startswith(("push_", "remove_"))}
    if "covers" in remote and "covers" not in out:
        here = local["covers"].filter("false") if "covers" in local else remote["covers"].filter("false")
        pulled = cover_diff(here, remote["covers"]).filter("action = 'pull'")
        out["covers"] = remote["covers"].join(pulled.select("slug"), "slug", "left_semi")
    return out


def sync_counts(**frames: DataFrame) -> DataFrame:
    """kind, n for each diff frame."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("kind")).groupBy("kind").agg(F.count("*").alias("n")) for k, df in frames.items()])


def converge(replicas: list[DataFrame], key: str, clock: str = "updated_at", created: str | None = None) -> DataFrame:
    """One row a key of N replicas: the newest, and of equals that of the last replica; the earliest creation time if named."""
    tagged = reduce(DataFrame.unionByName, [df.withColumn("_replica", F.lit(i)) for i, df in enumerate(replicas)])
    row = F.max_by(F.struct(*[c for c in replicas[0].columns if c != key]), F.struct(clock, "_replica")).alias("r")
    extra = [F.min(created).alias("_created")] if created else []
    out = tagged.groupBy(key).agg(row, *extra).select(key, "r.*", *(["_created"] if created else []))
    return out.withColumn(created, F.col("_created")).drop("_created") if created else out


def _made_id(slug: Column, kind: T.DataType, attempt: int) -> Column:
    if isinstance(kind, T.StringType):
        return F.sha2(slug.cast("string"), 256)
    made = F.xxhash64(slug.cast("string"), F.lit(attempt))
    return made if isinstance(kind, T.LongType) else F.pmod(made, F.lit(2**31 - 1)).cast(kind)


def with_new_ids(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``rows`` (slug, id) with an id of the column's own type for each that has none, made from its slug. A made number that
    ``taken`` (id) or a smaller slug has already is made anew."""
    kind = rows.schema["id"].dataType
    if isinstance(kind, T.StringType):
        return rows.withColumn("id", F.coalesce("id", _made_id(F.col("slug"), kind, 0)))
    done, left, attempt = [], checkpoint(rows.filter("id IS NULL").select("slug").distinct()), 0
    used = taken.filter("id IS NOT NULL").select("id")
    while not left.isEmpty():
        tried = left.withColumn("id", _made_id(F.col("slug"), kind, attempt)).join(used, "id", "left_anti")
        named = checkpoint(tried.groupBy("id").agg(F.min("slug").alias("slug")))
        done.append(named.select("slug", F.col("id").alias("_made")))
        used, attempt = used.unionByName(named.select("id")), attempt + 1
        left = checkpoint(left.join(named.select("slug"), "slug", "left_anti"))
    made = reduce(DataFrame.unionByName, done) if done else rows.filter("false").select("slug", F.col("id").alias("_made"))
    return rows.join(made, "slug", "left").withColumn("id", F.coalesce("id", "_made")).drop("_made").select(*rows.columns)


class Counts:
    """Rows pulled and pushed by kind, counted while the frames of a sync are written, without another pass."""

    KINDS = ("series", "events", "adapters", "covers", "dismissals")

    def __init__(self) -> None:
        self._seen: dict[tuple[str, str], Observation] = {}

    def watch(self, way: str, kind: str, rows: DataFrame, which: Column | None = None) -> DataFrame:
        seen = self._seen[way, kind] = Observation()
        return rows.observe(seen, F.count(F.lit(1) if which is None else F.when(which, 1)).alias("n"))

    def result(self) -> dict[str, dict[str, int]]:
        """After the frames were written; waits for those that weren't."""
        value = lambda key: self._seen[key].get["n"] if key in self._seen else 0
        return {way: {kind: value((way, kind)) for kind in self.KINDS} for way in ("pulled", "pushed")}


def sync(local: dict[str, DataFrame], remote: dict[str, DataFrame], counts: Counts | None = None) -> dict[str, DataFrame]:
    """Both directions for those of series, events, adapters, dismissals and covers that both sides have; pushes are computed
    after the pull. Series that are new here get an id made from their slug, and events that name their series by slug
    (``series_slug``) get its id here; those of an unknown series wait for it. Cover bytes move where ``cover_diff`` says so by
    versions, and ``remove_covers`` names the remote ones that were cleared here. ``counts`` watches what is pulled and pushed."""
    both = [k for k in ("series", "events", "adapters", "dismissals", "covers") if k in local and k in remote]
    watch = counts.watch if counts else lambda way, kind, rows, which=None: rows
    out: dict[str, DataFrame] = {}
    moved = F.col("moved") != "kept"
    if "series" in both:
        theirs = remote["series"]
        for c in local["series"].columns:
            if c not in theirs.columns:
                theirs = theirs.withColumn(c, F.lit(None).cast(local["series"].schema[c].dataType))
        rows = merge_lww(local["series"], theirs, "slug", local_only=("id", "created_at", "cover_image", "cover_image_type"))
        if "id" in rows.columns:  # an id is this machine's own
            own = rows.withColumn("id", F.when(F.col("moved") != "inserted", F.col("id")))
            rows = with_new_ids(checkpoint(own), local["series"])
        out["series"] = watch("pulled", "series", rows, moved).drop("moved")
        out["push_series"] = watch("pushed", "series", push_diff(rows.drop("moved"), remote["series"], "slug"))
    if "events" in both:
        theirs = remote["events"]
        new = theirs.filter(F.col("id").cast("string") != "").join(local["events"].select("id"), "id", "left_anti").dropDuplicates(["id"])
        if "series_slug" in theirs.columns and "series" in out:
            new = new.join(rows.select(F.col("slug").alias("series_slug"), F.col("id").alias("series_id")), "series_slug").drop("series_slug")
        out["events"] = local["events"].unionByName(watch("pulled", "events", new))
        out["push_events"] = watch("pushed", "events", missing_remotely(local["events"], theirs, "id"))
    if "adapters" in both:
        found = merge_lww(local["adapters"], remote["adapters"], "domain", local_only=("id", "created_at"))
        out["adapters"] = watch("pulled", "adapters", found, moved).drop("moved")
        out["push_adapters"] = watch("pushed", "adapters", push_diff(found.drop("moved"), remote["adapters"], "domain"))
    if "dismissals" in both:
        known = ["slug_a", "slug_b"]
        new = remote["dismissals"].filter("slug_a <> '' AND slug_b <> '' AND slug_a <> slug_b").join(local["dismissals"], known, "left_anti").dropDuplicates(known)
        new = new.withColumn("updated_at", F.col("created_at")).select(*local["dismissals"].columns)
        out["dismissals"] = local["dismissals"].unionByName(watch("pulled", "dismissals", new))
        out["push_dismissals"] = watch("pushed", "dismissals", missing_remotely(local["dismissals"], remote["dismissals"], *known))
    if "covers" in both:
        ours, theirs = local["covers"], remote["covers"]
        moves = checkpoint(cover_diff(ours.select("slug", "cover_version"), theirs.select("slug", "cover_version")))  # bytes last, and those of movers alone
        way = lambda rows, action: rows.join(moves.filter(F.col("action") == action).select("slug"), "slug", "left_semi")
        pulled = watch("pulled", "covers", way(theirs, "pull").select(*ours.columns))
        out["covers"] = ours.join(moves.filter("action = 'pull'").select("slug"), "slug", "left_anti").unionByName(pulled)
        out["push_covers"] = watch("pushed", "covers", way(ours, "push"))
        if "series" in out and "cover_version" in out["series"].columns:
            out["remove_covers"] = cleared_covers(out["covers"], theirs, out["series"])
    return out
