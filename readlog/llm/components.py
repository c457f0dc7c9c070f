"""Connected components of an edge list, by alternating large-star and small-star steps.

Cases: an empty list has no rows; loops and repeated edges count for nothing; a null end is not allowed; other columns
than ``a`` and ``b`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlog.llm.storage import checkpoint

#: Most key values that are sent to all tasks, and rows of a key from which it may be one of them.
HOT_KEYS, HOT_ROWS = 20_000, 1_000


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], values: list[str], total: int) -> DataFrame:
    """``rows`` with the ``values`` of their group; rows without a group go. ``groups``: keys, values and ``n``, the rows of each.

    Keys with more than a HOT_KEYS-th of all ``total`` rows, which can't be more than HOT_KEYS, meet their rows by
    broadcast; the others by a shuffle, in which no key is large then.
    """
    hot = F.col("n") > max(HOT_ROWS, total // HOT_KEYS)
    named = [F.col(k).alias(f"_{k}") for k in keys]

    def on(prefix: str) -> Column:
        test = F.col(keys[0]) == F.col(prefix + keys[0])
        for k in keys[1:]:
            test = test & (F.col(k) == F.col(prefix + k))
        return test

    few = groups.filter(hot).select(*named, F.struct(*values).alias("_few"))
    tagged = rows.join(F.broadcast(few), on("_"), "left").drop(*[f"_{k}" for k in keys])
    near = tagged.filter("_few IS NOT NULL").select(*rows.columns, *[F.col("_few")[v].alias(v) for v in values])
    rest = tagged.filter("_few IS NULL").drop("_few").join(groups.filter(~hot).select(*named, *values), on("_"))
    return near.unionByName(rest.select(*rows.columns, *values))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the smallest node of its component.

    Only edges move, grouped by node with their minimum taken before the shuffle; every round is checkpointed, so a
    lost executor costs one round. Stops when a round changes nothing.
    """
    pairs = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    stars = _is_stars(pairs)
    for _ in range(rounds):
        if stars:
            break
        pairs = checkpoint(_small_star(checkpoint(_large_star(pairs))))
        stars = _is_stars(pairs)
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _is_stars(pairs: DataFrame) -> bool:
    """Whether each larger node has one edge and no smaller end is itself a larger one."""
    leaves = pairs.groupBy("a").agg(F.count("*").alias("n"))
    if not leaves.filter("n > 1").isEmpty():
        return False
    tops = pairs.select(F.col("b").alias("a")).distinct()  # a hub is one row here, however many edges it has
    return tops.join(leaves.select("a"), "a", "left_semi").isEmpty()


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")))
    near = with_group(both.filter("b > a"), least, ["a"], ["m"], 2 * pairs.count())
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = checkpoint(pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
    near = with_group(pairs, least, ["a"], ["m"], pairs.count())
    moved = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()
