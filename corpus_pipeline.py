"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
one's documents. All but the last keep the columns of ``documents``.

Cases, in all stages: an empty table gives no rows; columns beside those of ``documents`` come along, whatever their
names, up to the last stage; very long texts are treated whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from readlog.llm import mixing, near_dedup, packing, quality_rules, substring_dedup
from readlog.llm.storage import documents, shared_dir


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts go; repeated rows stay or go alike."""
    return quality_rules.apply_rules(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies. Rows without words or without an id stay; rows
    that share an id stay or go by their own texts."""
    return near_dedup.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word passages that a smaller id has too; a row of which nothing is left goes. Rows without words
    stay as they are; equal ids take nothing from one another."""
    return substring_dedup.remove_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and the last in part, as the mix takes them. Rows without words are never taken; a null source is
    a source of its own; repeated rows are mixed one by one."""
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in pieces of power-of-two length, a sequence each. A null text is the end id alone."""
    return packing.binary_pieces(docs)


STAGES = [
    ("quality rules", rules),
    ("MinHash near-dedup", near),
    ("substring dedup", repeats),
    ("mixing to target weights", mixed),
    ("packing", packed),
]

#: Tokenising has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = documents(spark, sf_dir), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
