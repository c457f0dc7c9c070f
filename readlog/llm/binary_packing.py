"""Token ids in fixed-size rows, by best-fit-decreasing packing.

Each input partition tokenises its documents and packs them in lots of a fixed number of tokens: documents longer than
a row are split without loss, pieces are taken longest first, and each goes to the fullest row that still has room,
found in a segment tree over free capacities. What is written are the packed id matrix, row by row, the cumulative
segment lengths of each row, and positions that start anew with each segment. Lots are independent, so there is no
shuffle and nothing grows with the corpus; at most one row a lot is badly filled.

Cases: null or empty text is the single end id; a very long text is split over as many rows as it needs; pieces of
equal length go in the order in which they were read; repeated rows are packed once each; an empty table gives no rows;
extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlog.llm.storage import documents, shared_dir

CAPACITY, END, LOT = 2048, 50256, 1 << 20
SCHEMA = "n_tokens int, doc_ids array<bigint>, starts array<bigint>, cu_seqlens array<int>, ids binary, positions binary"


class Rooms:
    """A segment tree that counts the open rows of each free capacity, and finds the smallest that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, free: int, n: int) -> None:
        at = free + self.size
        while at:
            self.tree[at] += n
            at >>= 1

    def put(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self._add(free, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, row) of a row with the least capacity of need or more."""
        at = need + self.size
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        free = at - self.size
        self._add(free, -1)
        return free, self.rows[free].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; no row holds more than capacity."""
    rooms, rows = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[i])
        if found is None:
            free, row = capacity, len(rows)
            rows.append([])
        else:
            free, row = found
        rows[row].append(i)
        if free > lengths[i]:
            rooms.put(free - lengths[i], row)
    return rows


def packed_rows(docs: DataFrame, capacity: int = CAPACITY, end: int = END, lot: int = LOT, paths: tuple[str, str] | None = None) -> DataFrame:
    """n_tokens, doc_ids and starts of the segments, cu_seqlens, ids (capacity unsigned 32-bit little-endian values, the
    end id as padding), positions (as many unsigned 32-bit values), row_id."""

    def flush(pieces: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for row in best_fit_decreasing([len(x[2]) // 4 for x in pieces], capacity):
            sizes = [len(pieces[i][2]) // 4 for i in row]
            bounds = np.cumsum([0, *sizes]).astype(np.int32)
            padding = capacity - int(bounds[-1])
            steps = np.arange(capacity, dtype=np.uint32)
            steps -= np.repeat(np.append(bounds[:-1], bounds[-1:] * (padding > 0)).astype(np.uint32), [*sizes, padding])
            values = (int(bounds[-1]), [pieces[i][0] for i in row], [pieces[i][1] for i in row], bounds.tolist(), b"".join(pieces[i][2] for i in row) + np.full(padding, end, "<u4").tobytes(), steps.astype("<u4").tobytes())
            for column, value in zip(out, values, strict=True):
                column.append(value)
        kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from readlog.llm.tokens import encoder

        encode, last, pieces, tokens = encoder(paths), np.array([end], "<u4").tobytes(), [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 256):
                for key, text in zip(ids[at : at + 256], batch.column(1).slice(at, 256).to_pylist(), strict=True):
                    data = encode(text) + last
                    for start in range(0, len(data), 4 * capacity):
                        piece = data[start : start + 4 * capacity]
                        pieces.append((key, start // 4, piece))
                        tokens += len(piece) // 4
                        if tokens >= lot:
                            yield flush(pieces)
                            pieces, tokens = [], 0
        if pieces:
            yield flush(pieces)

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
    return packed.select("*", F.monotonically_increasing_id().alias("row_id"))


def write_rows(rows: DataFrame, folder: str) -> DataFrame:
    """The id matrices with segment lengths and positions, one Parquet part a task; returns the table as written."""
    rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def op7_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents, writes the rows to the shared folder, and returns digests of what was written."""
    rows = write_rows(packed_rows(documents(spark, sf_dir)), f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}")
    return rows.select("row_id", "doc_ids", "starts", "cu_seqlens", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))
