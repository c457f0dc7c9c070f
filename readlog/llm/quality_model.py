"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, a few numpy passes a batch. Trees are fitted with logistic loss on binned statistics
of a bounded sample of labelled rows, in one task; they are complete, so a tree is three flat arrays, and scoring
walks all documents of a batch through a level at a time.

Cases: null text is empty, and empty texts are scored like others; a very long text is read whole; repeated labels of a
row all count; splits that tie go to the first statistic and cut; without labels every score is 0.5; an empty table gives
no rows; labels, lang and source are not read when scoring, nor are extra columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readlog.llm import textnum
from readlog.llm.storage import documents

#: Labelled rows that a fit uses, those of least id hash.
SAMPLE = 10_000
TREES, DEPTH, BINS, RATE, LEAST, CUT = 60, 4, 48, 0.2, 10, 0.3
CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "symbol": b"#*$%&|<>", "mark": b"!?", "stop": b".,;:",
    "line": b"\n", "bracket": b"()[]{}=_/\\@^~+", "wide": bytes(range(128, 256)),
}
NAMES = ("bytes", "words", "word_bytes", "distinct_words", "same_as_before", "distinct_triples", "common_word", "lines", "distinct_lines", "words_a_line", *CLASSES)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, NAMES) statistics of whole texts."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    start, end, first = textnum.word_spans(data, offsets)
    words, n = np.diff(first), len(start)
    hashes = textnum.word_hashes(data, start, end, 31)
    prefix, powers = textnum.item_prefix(hashes, 32)
    triples = textnum.window_hash(prefix, powers, 3)
    row = textnum.rows_of(first, n)
    again = np.zeros(rows, np.int64)
    if n > 1:
        again = np.bincount(row[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])], minlength=rows)
    breaks = np.unique(np.concatenate([np.flatnonzero(data == 10), offsets[1:] - 1, offsets[:-1][size > 0] - 1])) if len(data) else np.zeros(0, np.int64)
    breaks = breaks[(breaks >= -1) & (breaks < len(data))]
    begin, stop = breaks[:-1] + 1, breaks[1:] + (data[breaks[1:]] != 10) if len(breaks) > 1 else breaks[:0]
    full = stop > begin
    begin, stop = begin[full], stop[full]
    byte_sum, byte_powers = textnum.byte_prefix(data, 33)
    lines = textnum.range_hash(byte_sum, byte_powers, begin, stop) if len(begin) else np.zeros(0, np.uint64)
    line_first = np.searchsorted(begin, offsets)
    distinct, common, three, distinct_lines = (np.zeros(rows) for _ in range(4))
    for i in range(rows):
        a, b = first[i], first[i + 1]
        if b > a:
            ordered = np.sort(hashes[a:b])
            edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
            distinct[i], common[i] = len(edge) - 1, np.diff(edge).max()
        if b - a > 2:
            three[i] = len(np.unique(triples[a : b - 2]))
        if line_first[i + 1] > line_first[i]:
            distinct_lines[i] = len(np.unique(lines[line_first[i] : line_first[i + 1]]))
    word_count, line_count = np.maximum(words, 1), np.diff(line_first)
    out = [np.log1p(size), np.log1p(words), np.bincount(row, end - start, rows) / word_count, distinct / word_count, again / word_count, three / np.maximum(words - 2, 1), common / word_count,
           np.log1p(line_count), distinct_lines / np.maximum(line_count, 1), words / np.maximum(line_count, 1)]
    for members in CLASSES.values():
        table = np.zeros(256, bool)
        table[list(members)] = True
        total = np.concatenate([[0], np.cumsum(table[data])])
        out.append((total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1))
    return np.stack(out, 1)


@dataclass
class Trees:
    """Complete trees of one depth: at node i, values above threshold[i] go to 2i + 2, others to 2i + 1."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: int = LEAST) -> Trees:
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    model = Trees(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    total, parts = np.full(len(y), model.base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, curve, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best, at = np.zeros(width), np.zeros((width, 2), np.int64)
            for f in range(x.shape[1]):
                key = (node - first) * bins + binned[:, f]
                g, h, n = (np.bincount(key, w, width * bins).reshape(width, bins).cumsum(1) for w in (gradient, curve, None))
                left = g**2 / (h + 1)
                right = (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1)
                gain = left + right - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain[(n < least) | (n[:, -1:] - n < least)] = 0
                cut = gain.argmax(1)
                better = gain[np.arange(width), cut] > best + 1e-9
                best[better] = gain[np.arange(width), cut][better]
                at[better] = np.stack([np.full(width, f), cut], 1)[better]
            for w in np.flatnonzero(best > 0):
                f, cut = at[w]
                feature[first + w], threshold[first + w] = f, cuts[f][cut] if cut < len(cuts[f]) else np.inf
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - (2**depth - 1)
        g, h = np.bincount(leaf, gradient, 2**depth), np.bincount(leaf, curve, 2**depth)
        value = -rate * g / (h + 1)
        total += value[leaf]
        parts.append((feature, threshold, value))
    return Trees(*map(np.stack, zip(*parts, strict=True)), model.base)


def with_statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """``carry`` columns and ``x``, the statistics of the text."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textnum.pieces(batch, limit=1 << 20):
                x = statistics(*textnum.text_bytes(piece.column("text")))
                bounds = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in carry), pa.ListArray.from_arrays(bounds, pa.array(x.ravel()))], [*carry, "x"])

    return docs.select(*carry, "text").mapInArrow(run, f"{fields}, x array<double>")


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from the ``sample`` labelled rows of least id hash outside the held-out part."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"), F.xxhash64("doc_id", F.lit(5)).alias("_h"))
    picked = known.orderBy("_h", "_id", "_y").limit(sample)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")), "_h", "_id", "_y")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_h", "ascending"), ("_id", "ascending"), ("_y", "ascending")])
        x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(NAMES))
        model = fit_trees(x, table.column("_y").to_numpy().astype(float))
        return pa.table({"feature": [model.feature.ravel().tolist()], "threshold": [model.threshold.ravel().tolist()], "leaf": [model.leaf.ravel().tolist()], "base": [model.base]}, pa.schema([("feature", pa.list_(pa.int64())), ("threshold", pa.list_(pa.float64())), ("leaf", pa.list_(pa.float64())), ("base", pa.float64())]))

    found = rows.groupBy().applyInArrow(run, "feature array<bigint>, threshold array<double>, leaf array<double>, base double").first()
    if found is None:
        return fit_trees(np.zeros((0, len(NAMES))), np.zeros(0))
    nodes = 2**DEPTH - 1
    return Trees(np.array(found["feature"], np.int64).reshape(-1, nodes), np.array(found["threshold"], float).reshape(-1, nodes), np.array(found["leaf"], float).reshape(-1, nodes + 1), found["base"])


def predict(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textnum.pieces(batch, limit=1 << 20):
                scores = sent.value.score(statistics(*textnum.text_bytes(piece.column("text"))))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(scores), pa.array((scores >= CUT).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
