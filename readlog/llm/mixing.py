"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words. Targets follow the weights up to a multiple of each source's size, with the excess shared out again
(by running sums over ranges of the table of sources, so that there may be a source a host). Blocks of equal size go to the sources by highest quotients, then, by the
same rule, to the shards of each source; a seeded order of a shard's documents is cut into blocks, of which the
first ``quota`` are taken, and whole passes come first. A hot source only has more shards: a shard holds about
``shard_words`` words, so no window grows with a source.

Everything runs on DataFrame functions. The texts are read once; the table of sizes is checkpointed.

Cases: null text has size 0 and is never taken; a very long text may be taken in part, its first words; null source is a source of its own, last in order; repeated rows are
mixed as rows of their own, and rows equal in (doc_id, size) may swap their parts; an empty table gives no rows; only
``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlog.llm.storage import checkpoint, documents

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: All targets together, in percent of all words, and the most of a source in times its words.
SHARE_PERCENT, MOST_TIMES = 150, 2
BLOCK_WORDS, SHARD_WORDS, SEED = 16, 1_000_000, 17
#: The table of sources is broadcast up to this many rows, some hundred bytes each.
BROADCAST_SOURCES, SALTS = 10_000, 32


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums of whole numbers in an order that has no ties: inside ranges, and before them the totals of
    earlier ranges, of which there is one row a partition."""
    placed = checkpoint(rows.select("*", *[x.alias(name) for name, x in sums.items()]).repartitionByRange(*order).select("*", F.spark_partition_id().alias("_part")))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ranges = placed.groupBy("_part").agg(*[F.sum(name).alias(f"_{name}") for name in sums])
    offsets = ranges.select("_part", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = placed.withColumns({name: F.sum(name).over(inside) for name in sums}).join(F.broadcast(offsets), "_part")
    return summed.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_part", *[f"_{name}" for name in sums])


def with_facts(rows: DataFrame, key: Column, facts: DataFrame, salt: Column, count: int) -> DataFrame:
    """``rows`` with the one row of ``facts`` whose ``_key`` is theirs. A table of facts whose ``count`` is large is not
    broadcast: a hot key meets as many copies of its row as there are salts."""
    if count <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(facts), key == F.col("_key")).drop("_key")
    copies = facts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_copy"))
    return rows.join(copies, (key == F.col("_key")) & (F.pmod(salt, F.lit(SALTS)) == F.col("_copy"))).drop("_key", "_copy")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_TIMES) -> DataFrame:
    """source, source_size, target: weights repeat over the sources by code point, null last; none exceeds most x size."""
    named = running(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], {"ord": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), ((F.col("ord") - 1) % len(weights) + 1).cast("int"))
    weighed = named.select("*", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    every = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    by_ratio = running(weighed, [(F.col("source_size") / F.col("weight")).asc(), F.col("ord").asc()], {"caps": F.col("cap"), "weights": F.col("weight")})
    rest = (F.lit(every["weight"]) - F.col("weights") + F.col("weight")).cast("decimal(12,0)")
    left = F.lit(share_percent * every["words"]).cast("decimal(22,0)") - 100 * (F.col("caps") - F.col("cap")).cast("decimal(18,0)")
    filled = by_ratio.select("*", ((100 * F.col("cap")).cast("decimal(20,0)") * rest <= F.col("weight").cast("decimal(9,0)") * left).alias("full"))
    taken = filled.agg(F.sum(F.when(F.col("full"), F.col("cap"))).alias("spent"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("open")).first()
    level = float(share_percent * every["words"] - 100 * (taken["spent"] or 0)) / float(100 * (taken["open"] or 1))
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * F.lit(level)).alias("target"))


def sainte_lague(cells: DataFrame, group: str, order: str, weight: str, seats: str, groups: int = BROADCAST_SOURCES) -> DataFrame:
    """``cells`` with ``won``: each group's seats by the highest quotients weight / (2k + 1), ties by ``order``.

    The standard divisor gives all seats but a few; the rest are ranked by quotient among as many candidates a cell
    as can be needed, which together are linear in the number of cells. A rank is a running count less that of its
    group's first candidate, so a group with most of the cells is spread like any other. ``groups``: at most how many.
    """
    g, salt = F.col(group), F.xxhash64(order)
    sums = cells.groupBy(g.alias("_key")).agg(F.sum(weight).alias("_all"), F.count("*").alias("_m"))
    base = F.when(F.col("_all") > 0, F.floor(F.col(weight) * F.col(seats) / F.col("_all") + 0.5)).otherwise(0).cast("long")
    based = checkpoint(with_facts(cells, g, sums, salt, groups).select("*", base.alias("_base")))
    gaps = based.groupBy(g.alias("_key")).agg(F.when(F.max("_all") > 0, F.max(seats) - F.sum("_base")).otherwise(0).alias("_diff"))
    start = with_facts(based, g, gaps, salt, groups)
    reach = (F.floor(F.col(weight) / F.col("_all") * (F.abs("_diff") + F.col("_m"))) + 2).cast("long")
    tries = start.filter("_diff <> 0").select(g.alias("_g"), F.col(order).alias("_o"), weight, "_base", "_diff", F.explode(F.sequence(F.lit(1).cast("long"), reach)).alias("_j"))
    nth = F.when(F.col("_diff") > 0, 2 * (F.col("_base") + F.col("_j")) - 1).otherwise(2 * (F.col("_base") - F.col("_j") + 1) - 1)
    sign = F.when(F.col("_diff") > 0, -1.0).otherwise(1.0)
    quotients = tries.select("*", nth.alias("_nth")).filter("_nth > 0").select("*", (sign * F.col(weight) / F.col("_nth")).alias("_quotient"))
    numbered = running(quotients, [F.col(c).asc() for c in ("_g", "_quotient", "_o", "_j")], {"number": F.lit(1).cast("long")})
    firsts = numbered.groupBy(F.col("_g").alias("_key")).agg(F.min("number").alias("_first"))
    ranked = with_facts(numbered, F.col("_g"), firsts, F.xxhash64("_o", "_j"), groups)
    moved = ranked.filter("number - _first < abs(_diff)").groupBy("_g", "_o").agg(F.sum(F.signum("_diff")).cast("long").alias("_moved"))
    joined = start.join(moved, (g == F.col("_g")) & (F.col(order) == F.col("_o")), "left")
    return joined.select(*cells.columns, (F.col("_base") + F.coalesce("_moved", F.lit(0))).alias("won"))


def mix(docs: DataFrame, carry: tuple[str, ...] = (), block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, source; ``carry`` columns of docs come along."""
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    sizes = checkpoint(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"), *carry))
    targets = checkpoint(source_targets(sizes))
    words, count = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    by_source = targets.select(
        "*", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("sid"), F.lit(0).alias("everything"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("n_shards"),
        F.lit(words * min(SHARE_PERCENT, 100 * MOST_TIMES) // (100 * block)).cast("long").alias("blocks"),
    )
    won = sainte_lague(by_source, "everything", "sid", "target", "blocks", 1)
    sources = checkpoint(won.select(F.col("sid").alias("_key"), "sid", "source_size", "target", "n_shards", F.col("won").alias("source_blocks")))
    sid, salt = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")), F.conv(F.substring("key", 9, 4), 16, 10).cast("int")
    dealt = with_facts(sizes, sid, sources, salt, count)
    dealt = dealt.select("*", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("n_shards")).alias("shard"))
    cells = checkpoint(dealt.groupBy("sid", "shard").agg(F.sum("size").alias("shard_size"), F.max("source_blocks").alias("source_blocks")))
    quotas = sainte_lague(cells, "sid", "shard", "shard_size", "source_blocks", count).select(F.col("sid").alias("_s"), F.col("shard").alias("_k"), "shard_size", F.least(F.col("won") * block, F.col("shard_size") * 2).alias("quota"))
    placed = dealt.join(quotas, (F.col("sid") == F.col("_s")) & (F.col("shard") == F.col("_k")))
    before = F.sum("size").over(W.partitionBy("sid", "shard").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - passes * F.col("shard_size") - F.col("_before")))
    return placed.select("*", before.alias("_before")).select("doc_id", "size", "source_size", "target", (passes * F.col("size") + part).cast("long").alias("taken"), "source", *carry)


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: as many copies of each as were taken whole, then its first words for what is left."""
    kept = mix(docs.select("doc_id", "source", "text", F.struct("*").alias("_doc")), carry=("_doc",))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    left = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    parts = F.concat(F.array_repeat(F.lit(0), times), F.array_repeat(left, F.when(left > 0, 1).otherwise(0)))
    rows = kept.select("_doc", F.explode(parts).alias("_part"))
    value = {c: F.col("_doc")[c] for c in docs.columns}
    cut = F.array_join(F.slice(F.array_remove(F.split(value["text"], r"[\x20\x09-\x0D]+"), ""), 1, F.col("_part")), " ")
    if "n_chars" in value:
        value["n_chars"] = F.when(F.col("_part") > 0, F.length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(value["n_chars"])
    value["text"] = F.when(F.col("_part") > 0, cut).otherwise(value["text"])
    return rows.select(*[x.alias(c) for c, x in value.items()])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
