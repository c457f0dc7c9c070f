"""MinHash near-dedup with circulant signatures.

Two different permutations of 32-bit values give all coordinates: the first maps a shingle, the second, shifted circularly
by k, gives coordinate k. Thirty-two bands of four coordinates propose candidates: a pair at similarity 0.75 is missed with
a probability of 5e-6. Documents with equal shingle sets are one node from the start. The nodes of a band value are
linked to its smallest, so a value that a third of all documents have costs one edge a document; components of those
edges are the groups in which links are confirmed.

Links are confirmed on full shingle sets, group by group: a search from the smallest unvisited document compares it
with all that are left at once, and a document that was reached is compared with what is left then, so a group of
close copies takes a few passes rather than all pairs. A group larger than ``group_shingles`` is dealt into parts, of
which each also gets the same few anchors of the group. Most of a large group is copies of the same, which the anchors
join across parts; whatever is then not in the group's largest class is compared with every part. So no link is lost, no
task holds more than two parts, and work is that of a group's minority against the group rather than of all pairs.

Cases: a text without words has no set, is linked with nothing and is its own class; fewer than five words are one
shingle; a very long text has all of its shingles; an empty table gives no rows; rows that share a doc_id are documents of their own,
linked by their own texts, so they may differ in class and in ``kept``, and equal rows get equal results; rows with a null
doc_id are returned with a null class and kept; extra columns, whatever their names, are not read, and ``keep_one`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readlog.llm import textnum
from readlog.llm.components import components, with_group
from readlog.llm.storage import checkpoint, documents

SHINGLE, BANDS, ROWS, PERCENT = 5, 32, 4, 75
#: Shingles of a task, and members of a large group that all of its parts get.
GROUP_SHINGLES, ANCHORS = 4_000_000, 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as hashes, and where each text's start."""
    data = textnum.lower_ascii(data)
    start, end, first = textnum.word_spans(data, offsets)
    prefix, powers = textnum.item_prefix(textnum.word_hashes(data, start, end, 11), 12)
    hashes = textnum.window_hash(prefix, powers, width)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(hashes[a : b - width + 1]))
        elif b > a:
            sets.append(textnum.mix64(textnum.range_hash(prefix, powers, np.array([a]), np.array([b])) + np.uint64(b - a)))
        else:
            sets.append(hashes[:0])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate([*sets, hashes[:0]]), np.concatenate([[0], np.cumsum(sizes)])


#: Shifts and factors of the two permutations: that of shingles, and that which is shifted for each coordinate.
SIGMA = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None))
PI = ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None))


def permute(x: np.ndarray, spare: np.ndarray, steps: tuple) -> None:
    """A bijection of 32-bit values, in place."""
    for shift, factor in steps:
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)


def signatures(items: np.ndarray, first: np.ndarray, n: int = BANDS * ROWS, step: int = 1 << 16) -> np.ndarray:
    """Circulant MinHash: (sets, n) coordinates; all ones for an empty set."""
    out = np.full((len(first) - 1, n), 0xFFFFFFFF, np.uint32)
    base = (items >> np.uint64(32)).astype(np.uint32)
    permute(base, np.empty_like(base), SIGMA)
    full = np.flatnonzero(np.diff(first))
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(first[full], first[full[at]] + step, "right")) - 1)
        rows = full[at:to]
        begin, end = first[rows[0]], first[rows[-1] + 1]
        part, starts = base[begin:end], first[rows] - begin
        x, spare = np.empty_like(part), np.empty_like(part)
        for k in range(n):
            np.subtract(part, np.uint32(k), out=x)
            permute(x, spare, PI)
            out[rows, k] = np.minimum.reduceat(x, starts)
        at = to
    return out


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text: rows of one id are told apart by a hash of their texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, set_a, set_b (a 128-bit fingerprint of the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in textnum.pieces(batch):
                items, first = shingle_sets(*textnum.text_bytes(piece.column("text")))
                sizes = np.diff(first)
                sums = [np.concatenate([[0], np.cumsum(textnum.mix64(items ^ np.uint64(salt)), dtype=np.uint64)]).astype(np.uint64) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                prints = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
                coordinates = signatures(items, first).astype(np.uint64).reshape(len(sizes), BANDS, ROWS)
                bands = np.zeros((len(sizes), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = textnum.mix64(bands * np.uint64(31) + coordinates[:, :, r] + np.uint64(1))
                arrays = [piece.column("doc_id"), piece.column("text_key"), pa.array(sizes), *map(pa.array, prints), pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands"])

    return _texts(docs).mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<bigint>")


def confirm(items: np.ndarray, first: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first member of each set's class among these sets."""
    n = len(first) - 1
    root, sizes = np.full(n, -1), np.diff(first)
    _, dense = np.unique(items, return_inverse=True)
    hit = np.zeros(len(items) + 1, bool)
    left, of = np.arange(n), dense
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed], queue = seed, [seed]
        while queue:
            q = queue.pop()
            keep = root[left] < 0
            if not keep.any():
                return root
            if keep.mean() < 0.7:
                of = of[np.repeat(keep, sizes[left])]
                left = left[keep]
                keep = keep[keep]
            own = dense[first[q] : first[q + 1]]
            hit[own] = True
            starts = np.concatenate([[0], np.cumsum(sizes[left])[:-1]])
            common = np.add.reduceat(hit[of].astype(np.int32), starts)
            hit[own] = False
            linked = left[keep & (100 * common >= percent * (sizes[left] + sizes[q] - common))]
            root[linked] = seed
            queue.extend(linked.tolist())
    return root


def _confirmed(texts: DataFrame, places: DataFrame, dealt: DataFrame) -> DataFrame:
    """Edges (a, b) between members of one task; ``places``: node and whose text it has (doc_id, text_key); ``dealt``: node and
    the task's key (root, p, q)."""
    rows = texts.join(dealt.join(places, "node"), ["doc_id", "text_key"]).select("node", "text", "root", "p", "q")

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        _, order = np.unique(nodes, return_index=True)
        table = table.take(pa.array(order))
        nodes = nodes[order]
        root = confirm(*shingle_sets(*textnum.text_bytes(table.column("text"))))
        moved = root != np.arange(len(root))
        return pa.table({"a": pa.array(nodes[moved]), "b": pa.array(nodes[root[moved]])})

    return rows.groupBy("root", "p", "q").applyInArrow(run, "a long, b long")


def links(docs: DataFrame, groups: DataFrame, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Confirmed edges (a, b) within candidate groups, which join what all links join; ``groups``: node, root, n_shingles, and
    whose text it has (doc_id, text_key)."""
    texts, places = _texts(docs), groups.select("node", "doc_id", "text_key")
    sums = checkpoint(groups.groupBy("root").agg(F.sum("n_shingles").alias("all"), F.count("*").alias("n")))
    parts = F.greatest(F.lit(1), F.ceil(F.col("all") / group_shingles)).cast("int")
    members = with_group(groups, sums.select("root", parts.alias("parts"), "n"), ["root"], ["parts"], groups.count())
    placed = members.select("node", "root", "n_shingles", "parts", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("p"))
    if sums.filter(parts > 1).isEmpty():
        return _confirmed(texts, places, placed.select("node", "root", "p", F.lit(-1).alias("q")))
    placed = checkpoint(placed)
    large = placed.filter("parts > 1")
    by_hash = W.partitionBy("root").orderBy(F.xxhash64("node", F.lit(3)), "node")
    anchors = large.select("*", F.row_number().over(by_hash).alias("rank")).filter(F.col("rank") <= ANCHORS)
    everywhere = anchors.select("node", "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    first = checkpoint(_confirmed(texts, places, placed.select("node", "root", "p").unionByName(everywhere).distinct().withColumn("q", F.lit(-1))))
    classes = checkpoint(components(first).select("node", F.col("root").alias("cls")))
    named = checkpoint(large.join(classes, "node", "left").withColumn("cls", F.coalesce("cls", "node")))
    largest = named.groupBy("root", "cls").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("cls", F.struct("n", "cls")).alias("main"), F.sum("n").alias("n"))
    total = named.count()
    others = with_group(named, largest, ["root"], ["main"], total).filter("cls <> main")
    lots = others.groupBy("root").agg(F.ceil(F.sum("n_shingles") / group_shingles).cast("int").alias("lots"), F.count("*").alias("n"))
    lots = checkpoint(lots.withColumn("lots", F.greatest(F.lit(1), F.col("lots"))))
    # each lot of others meets each part of its group
    left = with_group(others.select("node", "root", "parts"), lots, ["root"], ["lots"], total)
    left = left.select("node", "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), F.pmod(F.xxhash64("node", F.lit(9)), "lots").cast("int").alias("q"))
    right = with_group(large.select("node", "root", "p"), lots, ["root"], ["lots"], total)
    right = right.select("node", "root", "p", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("q"))
    return first.unionByName(_confirmed(texts, places, left.unionByName(right).distinct()))


def _classes(docs: DataFrame, group_shingles: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id: one row a row."""
    sketched = checkpoint(sketches(docs))
    real, key = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL"), ["set_a", "set_b", "n_shingles"]
    # a node is a set: its number is its own, and stands from this checkpoint on; the smallest document lends it its text
    first = F.min(F.struct("doc_id", "text_key"))
    sets = real.groupBy(*key).agg(first.alias("first"), F.min_by("bands", F.struct("doc_id", "text_key")).alias("bands"), F.count("*").alias("n"))
    nodes = checkpoint(sets.select(F.monotonically_increasing_id().alias("node"), *key, "first.*", "bands", "n"))
    n_nodes = nodes.count()
    banded = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    hubs = checkpoint(banded.groupBy("band", "value").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1"))
    near = with_group(banded, hubs, ["band", "value"], ["hub"], BANDS * n_nodes).filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    groups = components(near)
    sized = checkpoint(groups.join(nodes.select("node", "n_shingles", "doc_id", "text_key"), "node"))
    classes = components(links(docs, sized, group_shingles))
    named = checkpoint(nodes.drop("bands").join(classes, "node", "left").withColumn("cls", F.coalesce("root", "node")))
    least = named.groupBy("cls").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    found = with_group(named.select(*key, "cls", F.col("n").alias("copies")), least, ["cls"], ["component_id"], n_nodes)
    copies = found.select(*key, "component_id", F.col("copies").alias("n"))
    rows = sketched.select("doc_id", "text_key", *key)
    alone = rows.filter("n_shingles = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    linked = with_group(rows.filter("n_shingles > 0 AND doc_id IS NOT NULL"), checkpoint(copies), key, ["component_id"], sketched.count())
    return linked.unionByName(alone).drop("set_a", "set_b")


def near_duplicates(docs: DataFrame, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row."""
    rows = _classes(docs, group_shingles).select("doc_id", "n_shingles", "component_id")
    return rows.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """docs without those that are near copies of one with a smaller id. Rows that share an id go by their own texts."""
    gone = _classes(docs, group_shingles).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_key")).distinct()
    packed = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_key"))
    return packed.join(gone, (F.col("_key") == F.col("_gone")) & (F.col("_text_key") == F.col("_gone_key")), "left_anti").select("_doc.*")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
