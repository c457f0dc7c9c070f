"""Suffix-array dedup over bytes, by merging Burrows-Wheeler transforms.

Every 50-byte window is dealt to a bucket by the least hash of the 16-byte strings in it, so equal windows meet, and
neighbouring windows mostly go together as one string of about 70 bytes. A first exchange finds the least hashes that
occur in two documents; only strings under those go to the buckets, each once a block, where it first stands: as a block's rows are in
the order of their ids, that has the block's smallest id. A bucket joins equal strings, builds the transforms of shards of the
rest, merges them (see ``bwt``), and so has the smallest doc_id of every window. Windows with a smaller document than their
own are sent back as byte ranges. Later occurrences are decided in the block: with a larger id than the first they go whole,
with the same id they lose what it loses.

Hot passages: equal strings are one string. A least hash with more than ``hot_strings`` different strings, such as that
at the edge of a passage which a third of all documents share, is dealt again, window by window, by the hash of the
whole window, so no task gets a group that grows with the corpus.

Cases: null or empty text has no bytes and the hash of the empty string; fewer than 50 bytes are never removed; a very
long text is read whole; rows with equal doc_id remove nothing from one another; a null doc_id ranks last and neither
removes nor is removed by another null; an empty table gives no rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from readlog.llm import bwt, textnum
from readlog.llm.exchange import Block, Plan, bucket_of, first_places, from_blocks, from_buckets, in_blocks, member, message_table, pack, unpack, used_buckets, with_answers
from readlog.llm.storage import documents

WINDOW, GRAM = 50, 16
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
HOT_STRINGS = 15_000
#: Windows in one string.
LONGEST = 64
#: Symbols in one merge.
BATCH = 1 << 19
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@dataclass
class Strings:
    """Byte ranges of a block whose windows share a least hash."""

    least: np.ndarray
    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    content: np.ndarray

    def take(self, which: np.ndarray) -> Strings:
        return Strings(self.least[which], self.row[which], self.start[which], self.length[which], self.content[which])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def cut_strings(block: Block, window: int, gram: int) -> Strings:
    """All windows of the block, as strings by least hash; starts are places in the block."""
    parts: list[tuple[np.ndarray, ...]] = []
    for at, to in block.runs(1 << 19):
        begin, end = block.offsets[at], block.offsets[to]
        n = int(end - begin) - window + 1
        if n <= 0:
            continue
        prefix, powers = textnum.byte_prefix(block.data[begin:end], 5)
        least = sliding_minimum(textnum.window_hash(prefix, powers, gram) >> np.uint64(8), window - gram + 1)
        row = np.repeat(np.arange(at, to, dtype=np.int32), np.diff(block.offsets[at : to + 1]))
        inside = row[:n] == row[window - 1 :]
        new = inside.copy()
        new[1:] &= ~inside[:-1] | (least[1:n] != least[: n - 1]) | (row[1:n] != row[: n - 1])
        # text that repeats itself keeps one least hash for long; such runs are cut
        borders = np.flatnonzero(new)
        if len(borders) and np.diff(np.append(borders, n)).max() > LONGEST:
            place = np.arange(n)
            new |= inside & ((place - np.maximum.accumulate(np.where(new, place, 0))) % LONGEST == 0)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | new[1:]
        first, after = np.flatnonzero(new), np.flatnonzero(last) + window
        parts.append((textnum.mix64(least[first]), row[first], begin + first, after - first, textnum.range_hash(prefix, powers, first, after)))
    if not parts:
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    return Strings(*map(np.concatenate, zip(*parts, strict=True)))


def _firsts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def least_hashes(block: Block, plan: Plan, window: int, gram: int) -> Iterable[tuple[int, bytes]]:
    """To each bucket: the block's least hashes; those with several strings or documents apart, with how many."""
    strings = cut_strings(block, window, gram)
    order = np.lexsort((strings.content, strings.least))
    least, content, doc = strings.least[order], strings.content[order], block.keys[strings.row[order]]
    first = _firsts(least)
    if not len(first):
        return
    several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
    different = np.concatenate([[True], (content[1:] != content[:-1]) | (least[1:] != least[:-1])])
    count = np.add.reduceat(different.astype(np.int64), first)
    least = least[first]
    low, plain = least.astype(np.uint32), ~several & (count == 1)
    for b, begin, end in used_buckets(bucket_of(least, plan.buckets)):
        part, p = slice(begin, end), plain[begin:end]
        yield b, pack(low[part][p], low[part][~p], np.minimum(count[part][~p], 65535).astype(np.uint16), several[part][~p])


def shared_hashes(messages: list[tuple[int, bytes]], hot_strings: int) -> Iterable[tuple[int, bytes]]:
    """To each block: those of its least hashes that occur in two documents, and which of them are hot."""
    read = [(blk, *unpack(data, np.uint32, np.uint32, np.uint16, np.bool_)) for blk, data in messages]
    values = np.concatenate([x for _, plain, more, _, _ in read for x in (plain, more)])
    weight = np.concatenate([x for _, plain, _, _, several in read for x in (np.ones(len(plain), np.int64), 1 + several)])
    strings = np.concatenate([x for _, plain, _, count, _ in read for x in (np.ones(len(plain), np.int64), count.astype(np.int64))])
    order = np.argsort(values)
    first = _firsts(values[order])
    kinds = values[order][first]
    shared = np.add.reduceat(weight[order], first) > 1
    hot = kinds[shared & (np.add.reduceat(strings[order], first) > hot_strings)]
    shared = kinds[shared]
    for blk, plain, more, *_ in read:
        own = np.concatenate([plain, more])
        own = own[member(own, shared)]
        if len(own):
            yield blk, pack(own, own[member(own, hot)])


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def send_strings(block: Block, answers: list[tuple[int, bytes]], plan: Plan, window: int, gram: int) -> Iterable[tuple[int, bytes]]:
    """To each bucket: the block's different strings under shared hashes, and where each first stands. The first message also
    has what comes back to the block as it is: the byte ranges that it has decided, and the strings that stand in one document with
    their first (start, that of the first, length)."""
    read = [(np.uint64(b) << np.uint64(32), *unpack(data, np.uint32, np.uint32)) for b, data in answers]
    shared, hot = (np.sort(np.concatenate([b | x[k] for b, *x in read])) for k in (0, 1))
    strings = cut_strings(block, window, gram)
    tag = (bucket_of(strings.least, plan.buckets).astype(np.uint64) << np.uint64(32)) | (strings.least & np.uint64(0xFFFFFFFF))
    is_hot = member(tag, hot)
    cold = strings.take(member(tag, shared) & ~is_hot)
    if is_hot.any():  # each window on its own
        many = strings.take(is_hot)
        counts = many.length - window + 1
        start = _spread(many.start, counts)
        prefix, powers = textnum.byte_prefix(block.data, 5)
        content = textnum.range_hash(prefix, powers, start, start + window)
        alone = Strings(content, np.repeat(many.row, counts), start, np.full(len(start), window), content)
        cold = Strings(*(np.concatenate([getattr(cold, f), getattr(alone, f)]) for f in ("least", "row", "start", "length", "content")))
    doc, first = block.keys[cold.row], first_places(cold.content)
    later = first != np.arange(len(first))
    decided, twin = later & (doc > doc[first]), later & (doc == doc[first])
    change = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(change, cold.start[decided], 1)
    np.add.at(change, cold.start[decided] + cold.length[decided], -1)
    ranges = textnum.runs(np.cumsum(change[:-1], dtype=np.int32) > 0)
    own = [x.astype(np.uint32) for x in (*ranges, cold.start[twin], cold.start[first[twin]], cold.length[twin])]
    cold, doc = cold.take(~later), doc[~later]
    bucket = bucket_of(cold.least, plan.buckets)
    order = np.argsort(bucket, kind="stable")
    cold, doc, bucket = cold.take(order), doc[order], bucket[order]
    for b, begin, end in used_buckets(bucket):
        part = slice(begin, end)
        data = block.data[_spread(cold.start[part], cold.length[part])]
        yield b, pack(cold.least[part].astype(np.uint32), cold.length[part].astype(np.uint8), data, doc[part], cold.start[part].astype(np.uint32), *own)
        own = [x[:0] for x in own]


def judge(messages: list[tuple[int, bytes]], window: int, batch: int) -> Iterable[tuple[int, bytes]]:
    """To each block: the byte ranges that a smaller document of another block has too, and what it sent to itself."""
    read = [(blk, *unpack(data, np.uint32, np.uint8, np.uint8, np.int64, *[np.uint32] * 6)) for blk, data in messages]
    group, length, data, doc = (np.concatenate([x[k] for x in read]) for k in range(1, 5))
    length = length.astype(np.int64)
    offset = np.concatenate([[0], np.cumsum(length)])
    prefix, powers = textnum.byte_prefix(data, 6)
    content = textnum.range_hash(prefix, powers, offset[:-1], offset[1:])
    # different strings, ordered by group
    order = np.lexsort((content, group))
    new = np.concatenate([[True], (content[order][1:] != content[order][:-1]) | (group[order][1:] != group[order][:-1])])
    string = np.empty(len(order), np.int64)
    string[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    one = order[first]
    value = np.minimum.reduceat(doc[order], first)
    windows = length[one] - window + 1
    place = np.concatenate([[0], np.cumsum(windows)])
    least = np.repeat(value, windows)
    # strings alone in their group share no window with another
    grouped = group[one]
    size = np.diff(np.append(_firsts(grouped), len(grouped)))
    several = np.flatnonzero(np.repeat(size > 1, size))
    border = np.append(_firsts(grouped[several]), len(several))
    symbols = np.concatenate([[0], np.cumsum(length[one[several]] + 1)])
    at = 0
    while at < len(border) - 1:
        to = max(at + 1, int(np.searchsorted(symbols[border], symbols[border[at]] + batch, "right")) - 1)
        which = several[border[at] : border[to]]
        lengths = length[one[which]]
        found = bwt.common_minimum(data[_spread(offset[one[which]], lengths)], lengths, value[which], window)
        least[_spread(place[which], windows[which])] = found
        at = to
    # back to where each string first stands in its block
    done = 0
    for blk, _, _, _, docs, starts, *echo in read:
        own = string[done : done + len(docs)]
        done += len(docs)
        counts = windows[own]
        again = least[_spread(place[own], counts)] < np.repeat(docs, counts)
        where = np.repeat(starts.astype(np.int64), counts) + _spread(np.zeros(len(own), np.int64), counts)
        edge = np.zeros(len(again) + 1, bool)
        edge[np.cumsum(counts)] = True
        begin = again & np.concatenate([[True], ~again[:-1] | edge[1:-1]])
        last = again & np.concatenate([~again[1:] | edge[1:-1], [True]])
        if begin.any() or any(map(len, echo)):
            yield blk, pack(where[begin].astype(np.uint32), (where[last] + window).astype(np.uint32), *echo)


def removed_flags(block: Block, answers: list[tuple[int, bytes]], window: int) -> np.ndarray:
    change = np.zeros(len(block.data) + 1, np.int32)
    read = [unpack(data, *[np.uint32] * 7) for _, data in answers] or [[np.zeros(0, np.uint32)] * 7]
    begin, end, whole_begin, whole_end, twin, first, length = (np.concatenate(x).astype(np.int64) for x in zip(*read, strict=True))
    order = np.argsort(begin)
    begin, end = begin[order], end[order]
    # a range begins with a window of its string, and a window belongs to one string
    low, high = np.searchsorted(begin, first), np.searchsorted(begin, first + length - window, "right")
    copied, shift = _spread(low, high - low), np.repeat(twin - first, high - low)
    for a, b in ((begin, end), (whole_begin, whole_end), (begin[copied] + shift, end[copied] + shift)):
        np.add.at(change, a, 1)
        np.add.at(change, b, -1)
    return np.cumsum(change, dtype=np.int32)[:-1] > 0


def digest(block: Block, answers: list[tuple[int, bytes]], window: int) -> pa.Table:
    gone = removed_flags(block, answers, window)
    size, removed, spans, hashes = [], [], [], []
    for i in block.rows():
        own = slice(block.offsets[i], block.offsets[i + 1])
        flags, data = gone[own], block.data[own]
        n = int(np.count_nonzero(flags))
        size.append(len(data))
        removed.append(n)
        spans.append(len(textnum.runs(flags)[0]) if n else 0)
        hashes.append(hashlib.sha256(data[~flags] if n else data).hexdigest())
    return pa.table({"doc_id": block.ids, "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(hashes, pa.string())})


def find_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_strings: int = HOT_STRINGS, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """The blocks, and for each the byte ranges to remove."""
    blocks, plan = in_blocks(docs, block_bytes, bucket_bytes)
    shared = from_buckets(from_blocks(blocks, lambda block: least_hashes(block, plan, window, gram)), lambda messages: shared_hashes(messages, hot_strings))

    def send(blk: int, block: Block, answers: list[tuple[int, bytes]]) -> pa.Table:
        return message_table((blk, bucket, data) for bucket, data in send_strings(block, answers, plan, window, gram)) if answers else message_table([])

    strings = with_answers(blocks, shared, send, "blk int, bucket int, data binary")
    return blocks, from_buckets(strings, lambda messages: judge(messages, window, batch))


def dedup(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    blocks, found = find_ranges(docs, **sizes)
    window = sizes.get("window", WINDOW)
    return with_answers(blocks, found, lambda _, block, answers: digest(block, answers, window), RESULT)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
