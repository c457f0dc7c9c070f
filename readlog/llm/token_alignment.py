"""Cross-tokenizer alignment of each distinct text once.

Texts are shuffled whole, so equal ones meet and count how often they occur; a text that most documents have is one row by
the partial aggregates before the shuffle. Each distinct text gets a space before it, is encoded by both tokenizers, and cut into groups
where tokens of both end at one byte. All pairs of an A and a B token of a group are links. A group's pairs are made from its distinct ids
with their multiplicities, so a long stretch without a common end costs no more than its distinct ids.

Texts stay in blocks of a fixed size, a row a block, written once. A block names each of its id pairs once, with how many
documents have it; counts are summed by Spark, and come back to the blocks that asked. Pairs that most blocks have meet
their blocks by broadcast, as ``components.with_group`` bounds it. Documents get their text's measures by its sha256.

Cases: null and empty texts, and texts whose tokens' joined bytes are not the text with its space, have zeros and an empty hash;
such texts' tokens count nowhere; strings of special tokens are plain text; very long texts are encoded whole; repeated rows get a
row each and count each as a document; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlog.llm import textnum
from readlog.llm.components import with_group
from readlog.llm.storage import checkpoint, documents
from readlog.llm.tokens import default_paths, encoder

#: Bytes of text of a block, and of what is aligned at a time; pairs that are expanded at a time.
BLOCK, PIECE, PAIRS = 4 << 20, 1 << 20, 1 << 21
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_SPACE, _SHIFT = "▁", 32


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ByteTable:
    """The bytes of each id, end to end."""

    def __init__(self, entries: list[bytes]):
        self.sizes = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(entries) + b"\0", np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Pair:
    """Both tokenizers, from texts to ids and from ids to bytes."""

    def __init__(self, paths: tuple[str, str] | None, model: str | None):
        import sentencepiece

        first = encoder(paths or default_paths()).ordinary
        self._first = first
        self._second = sentencepiece.SentencePieceProcessor(model_file=model or piece_path())
        self.a = ByteTable([first.decode_single_token_bytes(i) for i in range(first.n_vocab)])
        self.b = ByteTable([self._bytes(i) for i in range(self._second.get_piece_size())])
        # each number's decimal digits, and a place for what follows
        self.digits = ByteTable([f"{i} ".encode() for i in range(max(len(self.a.sizes), len(self.b.sizes)))])

    def _bytes(self, i: int) -> bytes:
        piece = self._second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._second.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = [self._first.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64) for t in texts]
        return a, [np.array(ids, np.int64) for ids in self._second.encode(texts, num_threads=1)]


@lru_cache(1)
def tokenizer_pair(paths: tuple[str, str] | None, model: str | None) -> Pair:
    return Pair(paths, model)


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*parts, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, parts)])


def _faithful(ids: np.ndarray, first: np.ndarray, table: ByteTable, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row's tokens, joined, are the row's bytes."""
    ends = np.concatenate([[0], np.cumsum(table.sizes[ids])])[first]
    same = np.diff(ends) == np.diff(offsets)
    got = table.joined(ids[np.repeat(same, np.diff(first))])
    want = data[np.repeat(same, np.diff(offsets))]
    rows = np.flatnonzero(same)
    wrong = np.searchsorted(np.cumsum(np.diff(offsets)[same]), np.flatnonzero(got != want), "right")
    same[rows[wrong]] = False
    return same


def _group_texts(pair: Pair, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;`` of all groups end to end, and where each merged token's part ends."""
    count_a, count_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    place_a = np.arange(len(a)) + (np.cumsum(count_b) - count_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(count_a)[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a] = np.where(np.append(group_a[1:] != group_a[:-1], True), ord("|"), ord(","))
    mark[place_b] = np.where(np.append(group_b[1:] != group_b[:-1], True), ord(";"), ord(","))
    text, ends = pair.digits.joined(ids), np.cumsum(pair.digits.sizes[ids])
    text[ends - 1] = mark
    return text, ends


def _distinct(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(weights[order], begin) if len(begin) else weights[:0]


def _linked(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, row_of: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, occurrences) of all links."""
    key_a, n_a = np.unique(group_a << _SHIFT | a, return_counts=True)
    key_b, n_b = np.unique(group_b << _SHIFT | b, return_counts=True)
    low = np.searchsorted(key_b >> _SHIFT, key_a >> _SHIFT)
    width = np.searchsorted(key_b >> _SHIFT, key_a >> _SHIFT, "right") - low
    total, mask, at = np.cumsum(width), (1 << _SHIFT) - 1, 0
    found = []
    while at < len(key_a):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, "right")))
        w = width[at:to]
        left = np.repeat(np.arange(at, to), w)
        right = np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w) + low[left]
        pairs = (key_a[left] & mask) << _SHIFT | key_b[right] & mask
        rows, times = row_of[key_a[left] >> _SHIFT], n_a[left] * n_b[right]
        order = np.lexsort((pairs, rows))
        rows, pairs, times = rows[order], pairs[order], times[order]
        begin = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (pairs[1:] != pairs[:-1])))
        found.append((rows[begin], pairs[begin], np.add.reduceat(times, begin)))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (key_a, key_a, key_a)


def align(pair: Pair, texts: list[str], step: int = PAIRS) -> tuple[np.ndarray, list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """n_a, n_b, n_groups, n_links of each text, the digest of its groups, and (row, pair, occurrences) of the links."""
    raw = [b" " + t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    (a, first_a), (b, first_b) = map(_flat, pair.encode(texts))
    good = _faithful(a, first_a, pair.a, data, offsets) & _faithful(b, first_b, pair.b, data, offsets)
    rows = np.flatnonzero(good)
    a, b = a[np.repeat(good, np.diff(first_a))], b[np.repeat(good, np.diff(first_b))]
    measures, digests = np.zeros((4, len(texts)), np.int64), [b""] * len(texts)
    measures[0, rows], measures[1, rows] = np.diff(first_a)[good], np.diff(first_b)[good]
    end_a, end_b = np.cumsum(pair.a.sizes[a]), np.cumsum(pair.b.sizes[b])
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    row_of = rows[np.searchsorted(np.cumsum(np.diff(offsets)[good]), common)]
    measures[2] = np.bincount(row_of, minlength=len(texts))
    np.add.at(measures[3], row_of, np.bincount(group_a, minlength=len(common)) * np.bincount(group_b, minlength=len(common)))
    text, ends = _group_texts(pair, a, b, group_a, group_b, len(common))
    last = np.append(0, ends)[np.append(0, np.cumsum((measures[0] + measures[1])[rows]))]
    for row, begin, end in zip(rows.tolist(), last[:-1].tolist(), last[1:].tolist(), strict=True):
        digests[row] = hashlib.sha256(text[begin : end - 1]).digest()
    return measures, digests, _linked(a, b, group_a, group_b, row_of, step)


def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers from 0, compressed by planes of bytes."""
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


BLOCKS = "blk long, prints binary, digests binary, copies binary, measures binary, vocabulary binary, keys binary, times binary"


def blocks_of(texts: DataFrame, paths: tuple[str, str] | None = None, model: str | None = None, block: int = BLOCK) -> DataFrame:
    """Distinct texts (text, n), aligned, a row a block: what each text measures, and its links as places in the block's vocabulary of pairs."""

    def row(parts: list[tuple]) -> pa.RecordBatch:
        prints, digests, copies, measures, links, n = [], [], [], [], [], 0
        for some_prints, some_copies, some_measures, some_digests, (rows, pairs, times) in parts:
            links.append((rows + n, pairs, times))
            n += len(some_prints)
            prints += some_prints
            digests += [d.ljust(32, b"\0") for d in some_digests]
            copies.append(some_copies)
            measures.append(some_measures)
        rows, pairs, times = (np.concatenate(x) for x in zip(*links, strict=True))
        vocabulary, place = np.unique(pairs, return_inverse=True)
        keys, times = _distinct(rows * len(vocabulary) + place, times)
        values = (
            int.from_bytes(prints[0][:8], "little", signed=True), b"".join(prints), b"".join(digests), squeeze(np.concatenate(copies)), squeeze(np.concatenate(measures, axis=1).ravel()),
            squeeze(np.diff(vocabulary, prepend=0)), squeeze(np.diff(keys, prepend=0)), squeeze(times),
        )
        kinds = [pa.int64()] + [pa.binary()] * 7
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, parts, size = tokenizer_pair(paths, model), [], 0
        for batch in batches:
            for piece in textnum.pieces(batch, limit=PIECE):
                texts = piece.column("text").to_pylist()
                prints = [hashlib.sha256(t.encode()).digest() for t in texts]
                parts.append((prints, piece.column("n").to_numpy(), *align(pair, texts)))
                size += sum(map(len, texts))
                if size >= block:
                    yield row(parts)
                    parts, size = [], 0
        if parts:
            yield row(parts)

    return texts.select("text", "n").mapInArrow(run, BLOCKS)


def _links_of(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, and text, place in the vocabulary and occurrences of each link."""
    vocabulary, keys = np.cumsum(unsqueeze(block["vocabulary"])), np.cumsum(unsqueeze(block["keys"]))
    width = max(1, len(vocabulary))
    return vocabulary, keys // width, keys % width, unsqueeze(block["times"])


def pairs_of(blocks: DataFrame) -> DataFrame:
    """blk, pair, n: how many documents of a block have the pair linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                vocabulary, text, place, _ = _links_of(block)
                n = np.zeros(len(vocabulary), np.int64)
                np.add.at(n, place, unsqueeze(block["copies"])[text])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block["blk"])), pa.array(vocabulary), pa.array(n)], ["blk", "pair", "n"])

    return blocks.select("blk", "copies", "vocabulary", "keys", "times").mapInArrow(run, "blk long, pair long, n long")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, count, best (whether no other pair of its A id has more), n (rows of ``pairs`` with it)."""
    sums = pairs.groupBy("pair").agg(F.sum("n").alias("count"), F.count("*").alias("n"))
    of_a = W.partitionBy(F.shiftright("pair", _SHIFT))  # at most as many rows as the second vocabulary has ids
    return sums.withColumn("best", F.col("count") == F.max("count").over(of_a))


def measured(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """print, n, the measures and groups_sha256 of each distinct text."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy(), kind="stable")
        pairs, counts = right.column("pair").to_numpy()[order], right.column("count").to_numpy()[order]
        best = right.column("best").to_numpy()[order].astype(np.int64)
        columns: list[list] = [[] for _ in range(9)]
        for block in left.to_pylist():
            vocabulary, text, place, times = _links_of(block)
            n = len(block["prints"]) // 32
            measures = unsqueeze(block["measures"]).reshape(4, n)
            at = np.searchsorted(pairs, vocabulary)
            n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(n_best, text, times * best[at][place])
            np.add.at(count_sum, text, times * counts[at][place])
            columns[0] += [block["prints"][i : i + 32] for i in range(0, 32 * n, 32)]
            columns[1].append(unsqueeze(block["copies"]))
            for column, values in zip(columns[2:8], [*measures, n_best, count_sum], strict=True):
                column.append(values)
            columns[8] += [block["digests"][i : i + 32].hex() if k else "" for i, k in zip(range(0, 32 * n, 32), measures[0].tolist(), strict=True)]
        numbers = [pa.array(np.concatenate([*c, np.zeros(0, np.int64)])) for c in columns[1:8]]
        return pa.table([pa.array(columns[0], pa.binary()), *numbers, pa.array(columns[8], pa.string())], names=["print", "n", *MEASURES, "groups_sha256"])

    schema = "print binary, n long, " + ", ".join(f"{m} long" for m in MEASURES) + ", groups_sha256 string"
    return blocks.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(run, schema)


def alignment(docs: DataFrame, paths: tuple[str, str] | None = None, model: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row a row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    full = F.coalesce(F.col("text") != "", F.lit(False))
    distinct = rows.filter(full).groupBy("text").agg(F.count("*").alias("n"))
    blocks = checkpoint(blocks_of(distinct, paths, model, block))
    pairs = pairs_of(blocks)
    counts = checkpoint(pair_counts(pairs))
    asked = with_group(pairs.select("blk", "pair"), counts, ["pair"], ["count", "best"], counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    texts = checkpoint(measured(blocks, asked))
    prints = rows.filter(full).select("doc_id", F.unhex(F.sha2("text", 256)).alias("print"))
    values = [*MEASURES, "groups_sha256"]
    found = with_group(prints, texts, ["print"], values, texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    none = rows.filter(~full).select("doc_id", *[F.lit(0).cast("long").alias(m) for m in MEASURES], F.lit("").alias("groups_sha256"))
    return found.select("doc_id", *values).unionByName(none)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(documents(spark, sf_dir))
