"""Packing by power-of-two decomposition.

A document's ids, with id 0 at the end, are cut into whole sequences and then into pieces whose lengths are the powers
of two of what is left. A piece is a sequence of its own, so no sequence crosses documents and none needs padding;
pieces of equal length form a bucket, from which equally shaped batches are read. Tokenising and cutting are one pass
over each input partition, without a shuffle or state, so hot sources and copies have no effect.

Cases: null or empty text is the single id 0; a very long text becomes as many whole sequences as it fills; the string
of a special token in a text is that token's id; repeated rows are packed once each; an empty table gives no rows; extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlog.llm.storage import documents

CAPACITY = 1024


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """n as whole sequences, then descending powers of two."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def binary_pieces(docs: DataFrame, capacity: int = CAPACITY, paths: tuple[str, str] | None = None, ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, bucket, ids (optional), sequence_id, offset: one row a piece."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids binary" * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from readlog.llm.tokens import encoder

        encode = encoder(paths)
        for batch in batches:
            keys = batch.column(0)
            for at in range(0, batch.num_rows, 256):
                rows, starts, lengths, crcs, totals, blobs = [], [], [], [], [], []
                for i, text in enumerate(batch.column(1).slice(at, 256).to_pylist(), at):
                    data = memoryview(encode(text) + b"\0\0\0\0")
                    n, start = len(data) // 4, 0
                    for length in piece_lengths(n, capacity):
                        piece = data[4 * start : 4 * (start + length)]
                        rows.append(i)
                        starts.append(start)
                        lengths.append(length)
                        crcs.append(zlib.crc32(piece))
                        totals.append(n)
                        if ids:
                            blobs.append(bytes(piece))
                        start += length
                size = np.array(lengths, np.int64)
                columns = [keys.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(size), pa.array(crcs, pa.int64()), pa.array(totals, pa.int64()), pa.array(np.log2(size).astype(np.int32))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(blobs, pa.binary())] * ids, names + ["ids"] * ids)

    cut_docs = docs.select("doc_id", "text").mapInArrow(cut, schema)
    return cut_docs.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """Packed ids by bucket: one folder for each power of two."""
    pieces.write.partitionBy("bucket").parquet(folder)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_pieces(documents(spark, sf_dir), ids=False)
