"""Documents in blocks, and packed messages between blocks and buckets.

Corpus-wide matching needs one look at every window of every document. Windows are hashed where the text is, and each
block sends each bucket one packed array of what it has there; Spark shuffles and groups those messages. Blocks and
buckets hold a fixed number of bytes, so their count grows with the corpus and no task does. A block sends a value
once however often it occurs there, which bounds what a frequent value costs a bucket. It sends a message only to those
buckets for which it has a value, so messages are as many as its values at most, however many buckets there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlog.llm import textnum

LAST = np.iinfo(np.int64).max
MESSAGE = "blk int, bucket int, data binary"


@dataclass(frozen=True)
class Plan:
    blocks: int
    buckets: int


def in_blocks(docs: DataFrame, block_bytes: int, bucket_bytes: int) -> tuple[DataFrame, Plan]:
    """doc_id, text, blk for every row. Copies of an id meet in a block; a null id ranks after all others, and as two of
    them never concern one another, such rows are dealt by their texts."""
    total, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    size = (total or 0) + 64 * rows
    plan = Plan(int(size // block_bytes) + 1, int(size // bucket_bytes) + 1)
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64(key), F.lit(plan.blocks)).cast("int").alias("blk")), plan


@dataclass
class Block:
    """A block's documents in an order that every task finds again."""

    ids: pa.Array
    keys: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Block:
        keys = table.column("doc_id").combine_chunks()
        ranks = keys.fill_null(int(LAST)).to_numpy(zero_copy_only=False)
        data, offsets = textnum.text_bytes(table.column("text"))
        order = np.argsort(ranks, kind="stable")
        if (np.diff(ranks[order]) == 0).any():  # rows that share an id: by text
            texts = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            order = np.array(sorted(range(len(ranks)), key=lambda i: (ranks[i], texts[i])), np.int64)
        parts = [data[offsets[i] : offsets[i + 1]] for i in order]
        ends = np.cumsum(np.diff(offsets)[order])
        return Block(keys.take(pa.array(order)), ranks[order], np.concatenate([*parts, data[:0]]), np.concatenate([[0], ends]).astype(np.int64))

    def rows(self) -> range:
        return range(len(self.keys))

    def runs(self, limit: int = 1 << 20) -> Iterable[tuple[int, int]]:
        """Row ranges of about ``limit`` bytes, and of one row at least."""
        at = 0
        while at < len(self.keys):
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + limit, "right")) - 1)
            yield at, to
            at = to


def bucket_of(mixed: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket from the high half of well mixed 64-bit values."""
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    return np.array([a.nbytes for a in arrays], np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(data, np.int64, len(kinds)), 8 * len(kinds), []
    for kind, n in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at))
        at += int(n)
    return out


def message_table(messages: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    rows = list(messages)
    blk, bucket, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"blk": pa.array(blk, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "data": pa.array(data, pa.binary())})


def messages_of(table: pa.Table) -> list[tuple[int, bytes]]:
    """(blk or bucket, data) in a fixed order."""
    return sorted(zip(table.column("blk").to_pylist(), table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True))


def from_blocks(blocks: DataFrame, make: Callable[[Block], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """Messages from blocks to buckets; ``make`` returns (bucket, data)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        blk = key[0].as_py()
        return message_table((blk, bucket, data) for bucket, data in make(Block.of(table)))

    return blocks.groupBy("blk").applyInArrow(run, MESSAGE)


def from_buckets(messages: DataFrame, make: Callable[[list[tuple[int, bytes]]], Iterable[tuple[int, bytes]]]) -> DataFrame:
    """Answers from buckets to blocks; ``make`` gets and returns (blk, data)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        return message_table((blk, bucket, data) for blk, data in make([(blk, data) for blk, _, data in messages_of(table)]))

    return messages.groupBy("bucket").applyInArrow(run, MESSAGE)


def with_answers(blocks: DataFrame, answers: DataFrame, make: Callable[[int, Block, list[tuple[int, bytes]]], pa.Table], schema: str) -> DataFrame:
    """Blocks beside what the buckets sent them, as (bucket, data)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        blk = left.column("blk")[0].as_py() if left.num_rows else -1
        return make(blk, Block.of(left), [(bucket, data) for _, bucket, data in messages_of(right)])

    return blocks.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(run, schema)


def used_buckets(ordered: np.ndarray) -> Iterable[tuple[int, int, int]]:
    """(bucket, begin, end) of the buckets that occur in an ordered array; the others cost nothing."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return zip(ordered[first].tolist(), first.tolist(), np.append(first[1:], len(ordered)).tolist(), strict=True)


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def first_places(value: np.ndarray) -> np.ndarray:
    """For each entry, the place of the first that is equal."""
    order = np.argsort(value, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1]])) if len(value) else np.zeros(0, np.int64)
    out = np.empty(len(value), np.int64)
    out[order] = np.repeat(order[begin], np.diff(np.append(begin, len(value))))
    return out
