"""Operational aggregates of a replica."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replica_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """collection, n."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("collection"), "n") for k, df in tables.items()])


def cover_bytes(covers: DataFrame) -> DataFrame:
    """n, total_bytes, largest_bytes."""
    size = F.octet_length("data")
    return covers.agg(F.count("*").alias("n"), F.sum(size).alias("total_bytes"), F.max(size).cast("long").alias("largest_bytes"))


def newest_readings(log: DataFrame, n: int = 3) -> DataFrame:
    return log.orderBy(F.desc("read_at"), F.desc("id")).limit(n).select("id", "series_id", "chapter_label", "read_at")
