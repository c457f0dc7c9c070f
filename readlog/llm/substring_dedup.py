"""Substring dedup over words, by fixed-block anchors.

Any 50 words in a row hold at least one aligned block of 25 words of their document. Every document's aligned blocks
are the index; every rolling 25-word window of every document probes it. Index and probes meet in buckets by hash; a
value is live if it is an aligned block somewhere and occurs in two documents. Hits are then extended: every 50-word
window around a live position is compared by hash over the whole corpus, as the smallest doc_id that has it, and the
union of a document's windows with a smaller one is its maximal repeats.

A block of documents sends each value once, whatever its frequency, in both exchanges. Its rows are in the order of their ids, so a
window's first occurrence in it has the block's smallest id: that alone is sent, and the bucket says whether another block has a
smaller one. Later occurrences are decided in the block: with a larger id than the first they go, with the same id they go with it.
So a passage that a third of all documents share is one entry a block in a bucket. Window hashes have 64 bits; two different windows
are taken for equal with a probability of about 5e-20 a pair.

Cases: null or empty text has no words and the hash of the empty string; fewer than 50 words are never removed; a very
long text is read whole, a part at a time; rows with equal doc_id remove nothing from one another; a null doc_id ranks
last and neither removes nor is removed by another null; an empty table gives no rows; extra columns, whatever their
names, are not read, and ``remove_repeats`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlog.llm import textnum
from readlog.llm.exchange import Block, Plan, bucket_of, first_places, from_blocks, from_buckets, in_blocks, member, message_table, pack, unpack, used_buckets, with_answers
from readlog.llm.storage import documents

WINDOW, ANCHOR = 50, 25
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 12 << 20
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Words:
    """Word hashes of some of a block's rows."""

    def __init__(self, block: Block, at: int, to: int):
        offsets = block.offsets[at : to + 1] - block.offsets[at]
        data = block.data[block.offsets[at] : block.offsets[to]]
        start, end, self.first = textnum.word_spans(data, offsets)
        self.n = len(start)
        self.prefix, self.powers = textnum.item_prefix(textnum.word_hashes(data, start, end, 3), 4)
        self.row = textnum.rows_of(self.first, self.n)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that lie in one row, and their hashes."""
        n = max(0, self.n - width + 1)
        hashes = textnum.window_hash(self.prefix, self.powers, width)
        inside = self.row[:n] == self.row[width - 1 : width - 1 + n]
        start = np.flatnonzero(inside)
        return start, hashes[start]


def probes(block: Block, plan: Plan, anchor: int) -> Iterable[tuple[int, bytes]]:
    """To each bucket: this block's window values, by (aligned, in several documents)."""
    values, aligned, docs = [], [], []
    for at, to in block.runs():
        words = Words(block, at, to)
        start, hashes = words.windows(anchor)
        values.append(hashes)
        aligned.append((start - words.first[words.row[start]]) % anchor == 0)
        docs.append(np.int32(at) + words.row[start].astype(np.int32))
    value, is_block, doc = map(np.concatenate, (values, aligned, docs))
    order = np.argsort(value)
    value, is_block, doc = value[order], is_block[order], block.keys[doc[order]]
    if not len(value):
        return
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
    indexed = np.logical_or.reduceat(is_block, first)
    value = value[first]  # in order, so buckets and low halves are too
    bucket, low = bucket_of(value, plan.buckets), value.astype("<u4")
    for b, begin, end in used_buckets(bucket):
        part = slice(begin, end)
        yield b, pack(*(low[part][(indexed[part] == x) & (several[part] == y)] for x in (False, True) for y in (False, True)))


def live_values(messages: list[tuple[int, bytes]]) -> Iterable[tuple[int, bytes]]:
    """To each block: those of its values that are an aligned block somewhere and occur in two documents."""
    read = []
    for blk, data in messages:
        read.append((blk, unpack(data, *[np.uint32] * 4)))
    indexed = np.unique(np.concatenate([x for _, lists in read for x in lists[2:]]))
    seen = np.zeros(len(indexed), np.int32)
    for _, lists in read:
        for k, values in enumerate(lists):
            hit = values[member(values, indexed)]
            np.add.at(seen, np.searchsorted(indexed, hit), 1 + k % 2)
    live = indexed[seen > 1]
    for blk, lists in read:
        own = np.concatenate(lists)
        if len(own := own[member(own, live)]):
            yield blk, pack(own)


def candidates(block: Block, answers: list[tuple[int, bytes]], plan: Plan, window: int, anchor: int) -> Iterable[tuple[int, bytes]]:
    """To each bucket: the windows around live positions, each where it first stands in the block, as hash, doc_id and the number
    of the word in the block. The first message also has what comes back to the block as it is: the places that it has decided, and
    those that stand in one document with their first."""
    live = np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | unpack(data, np.uint32)[0] for b, data in answers] or [np.zeros(0, np.uint64)]))
    hashes, docs, words_at, before = [], [], [], 0
    for at, to in block.runs():
        words = Words(block, at, to)
        start, value = words.windows(anchor)
        tag = (bucket_of(value, plan.buckets).astype(np.uint64) << np.uint64(32)) | (value & np.uint64(0xFFFFFFFF))
        hit = start[member(tag, live)]
        around = textnum.covered(np.maximum(hit - (window - anchor), 0), window - anchor + 1, words.n)
        start, value = words.windows(window)
        keep = around[start]
        start, value = start[keep], value[keep]
        hashes.append(value)
        docs.append(block.keys[at + words.row[start]])
        words_at.append((before + start).astype(np.uint32))
        before += words.n
    value, doc, word = map(np.concatenate, (hashes, docs, words_at))
    first = first_places(value)
    later = first != np.arange(len(value))
    decided, twin = later & (doc > doc[first]), later & (doc == doc[first])
    own = (word[decided], word[twin], word[first[twin]])
    value, doc, word = value[~later], doc[~later], word[~later]
    bucket = bucket_of(value, plan.buckets)
    order = np.argsort(bucket, kind="stable")
    value, doc, word, bucket = value[order], doc[order], word[order], bucket[order]
    for b, begin, end in used_buckets(bucket):
        part = slice(begin, end)
        change = np.flatnonzero(np.concatenate([[True], doc[part][1:] != doc[part][:-1], [True]]))
        yield b, pack(value[part], word[part], doc[part][change[:-1]], np.diff(change).astype(np.uint32), *own)
        own = (word[:0],) * 3


def repeated(messages: list[tuple[int, bytes]]) -> Iterable[tuple[int, bytes]]:
    """To each block: those of its windows that a smaller document of another block has, and what it sent to itself."""
    read = [(blk, *unpack(data, np.uint64, np.uint32, np.int64, *[np.uint32] * 4)) for blk, data in messages]
    value = np.concatenate([x[1] for x in read])
    doc = np.concatenate([np.repeat(x[3], x[4]) for x in read])
    order = np.argsort(value)
    first = np.flatnonzero(np.concatenate([[True], value[order][1:] != value[order][:-1]]))
    least = np.empty(len(value), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(value))))
    again, at = least < doc, 0
    for blk, hashes, word, _, _, *own in read:
        hit = word[again[at : at + len(hashes)]]
        at += len(hashes)
        if len(hit) or any(map(len, own)):
            yield blk, pack(hit, *own)


def word_flags(answers: list[tuple[int, bytes]], n: int, window: int) -> np.ndarray:
    read = [unpack(data, *[np.uint32] * 4) for _, data in answers] or [[np.zeros(0, np.uint32)] * 4]
    hit, decided, twin, first = map(np.concatenate, zip(*read, strict=True))
    starts = np.concatenate([hit, decided, twin[member(first, np.sort(hit))]])
    return textnum.covered(starts.astype(np.int64), window, n)


def kept_words(block: Block, answers: list[tuple[int, bytes]], window: int) -> Iterable[tuple[int, list[bytes], np.ndarray]]:
    """(row, words, flags of the removed) for each document."""
    texts = [bytes(block.data[block.offsets[i] : block.offsets[i + 1]]).split() for i in block.rows()]
    flags = word_flags(answers, sum(map(len, texts)), window)
    at = 0
    for i, words in enumerate(texts):
        yield i, words, flags[at : at + len(words)]
        at += len(words)


def digest(block: Block, answers: list[tuple[int, bytes]], window: int) -> pa.Table:
    counts, removed, hashes = [], [], []
    for _, words, flags in kept_words(block, answers, window):
        gone = int(flags.sum())
        counts.append(len(words))
        removed.append(gone)
        hashes.append(hashlib.sha256(b" ".join(compress(words, ~flags) if gone else words)).hexdigest())
    return pa.table({"doc_id": block.ids, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(hashes, pa.string())})


def cleaned(block: Block, answers: list[tuple[int, bytes]], window: int) -> pa.Table:
    """doc_id, Spark's hash of the text, and the text that is left, for the documents that lose something."""
    hashes, rows, texts = [], [], []
    for i, words, flags in kept_words(block, answers, window):
        if flags.any():
            rows.append(i)
            hashes.append(xxhash.xxh64_intdigest(block.data[block.offsets[i] : block.offsets[i + 1]].tobytes(), 42))
            texts.append(b" ".join(compress(words, ~flags)).decode())
    return pa.table({"doc_id": block.ids.take(pa.array(rows, pa.int64())), "hash": pa.array(np.array(hashes, np.uint64).view(np.int64)), "kept": pa.array(texts, pa.string())})


def find_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """The blocks, and for each the words at which repeated windows start."""
    anchor = window // 2
    blocks, plan = in_blocks(docs, block_bytes, bucket_bytes)
    live = from_buckets(from_blocks(blocks, lambda block: probes(block, plan, anchor)), live_values)

    def extend(blk: int, block: Block, answers: list[tuple[int, bytes]]) -> pa.Table:
        return message_table((blk, bucket, data) for bucket, data in candidates(block, answers, plan, window, anchor)) if answers else message_table([])

    return blocks, from_buckets(with_answers(blocks, live, extend, "blk int, bucket int, data binary"), repeated)


def dedup(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    blocks, found = find_repeats(docs, window, **sizes)
    return with_answers(blocks, found, lambda _, block, answers: digest(block, answers, window), RESULT)


def remove_repeats(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """All columns of docs; the text of documents that lose words is what is left of it, or the row goes if nothing is."""
    blocks, found = find_repeats(docs, window, **sizes)
    changed = with_answers(blocks, found, lambda _, block, answers: cleaned(block, answers, window), "doc_id long, hash long, kept string")
    lost = changed.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.col("kept").alias("_kept")).dropDuplicates(["_id", "_hash"])
    packed = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_key"), F.xxhash64("text").alias("_text"))
    joined = packed.join(lost, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left").filter("_kept IS NULL OR _kept <> ''")
    value = {c: F.col("_doc")[c] for c in docs.columns}
    if "n_chars" in value:
        value["n_chars"] = F.coalesce(F.length("_kept").cast(docs.schema["n_chars"].dataType), value["n_chars"])
    value["text"] = F.coalesce("_kept", value["text"])
    return joined.select(*[x.alias(c) for c, x in value.items()])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
