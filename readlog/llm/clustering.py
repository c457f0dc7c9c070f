"""Centroid clustering: Lloyd's rounds whose assignment is Fagin's threshold algorithm.

Components are whole numbers, floor(1024 x), so distances and means are exact and reruns agree. Each dimension has the
centroids in order of their values. For a vector, each dimension's list is walked outward from the vector's own value, one
centroid at a time and the nearer side first. A centroid met in any list has its distance computed in full. One that
no list has shown yet is at least as far in each dimension as that list's frontier, so as soon as the sum of the squared frontier
distances is strictly above the best distance, the best is final; being strict, equal distances are all seen, and the
smaller number wins.

Vectors are packed once and written to the shared folder. A round is one pass: tasks add up their own vectors by
centroid, and k times dim sums come to the driver, however many vectors there are. A cluster with most vectors is no hot
key, since vectors themselves are never shuffled.

Cases: vectors that are null, of another length, or with a null, NaN or infinite component are left out; components beyond
2**27 after scaling (a value of 131,072) count as that bound, so that distances stay within 64 bits; rows that share a
vec_id are vectors of their own, and of several with the smallest hash the smaller packed vector starts first; a null
vec_id starts last; fewer vectors than k give as many centroids; an empty cluster keeps its centroid; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readlog.llm.storage import checkpoint

K, DIM, ROUNDS, SEED, SCALE = 8, 64, 10, 3, 1024
BOUND, STEP, FAR = 1 << 27, 1024, np.iinfo(np.int64).max


def whole_components(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of ``dim`` finite components, and those as whole numbers."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    usable = np.flatnonzero(sizes == dim)
    values = column.take(pa.array(usable)).flatten().cast(pa.float64()).fill_null(np.nan)
    values = values.to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(values).all(axis=1)
    return usable[good], np.clip(np.floor(values[good] * SCALE), -BOUND, BOUND).astype(np.int64)


def packed_vectors(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id, vector: the usable vectors, as ``dim`` little-endian 32-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, values = whole_components(batch.column(1), dim)
            packed = [row.tobytes() for row in values.astype("<i4")]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(packed, pa.binary())], ["vec_id", "vector"])

    ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return ids.mapInArrow(run, "vec_id long, vector binary")


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, its squared distance, and how many distances were computed in full.

    Doubles hold sums of squares exactly up to 2**53, which components within 2**22 keep to; beyond, integers are used.
    """
    n, (k, dim) = len(values), centroids.shape
    exact = dim * 4 * max(np.abs(values).max(initial=0), np.abs(centroids).max(initial=0)) ** 2 < 1 << 53
    values, centroids = (x.astype(np.float64 if exact else np.int64) for x in (values, centroids))
    order = np.argsort(centroids, axis=0, kind="stable")
    # a border on both sides of each list, farther than any value
    border = np.full((1, dim), 4 * BOUND, values.dtype)
    lists = np.concatenate([-border, np.take_along_axis(centroids, order, axis=0), border])
    names = np.concatenate([order[:1], order, order[-1:]])
    dims = np.arange(dim)
    best, number, computed = np.full(n, np.inf if exact else FAR), np.zeros(n, np.int64), 0
    seen = np.zeros((n, k), bool)
    active, left = np.arange(n), values
    # places in the lists, row by row: of the last value below the vector's, and of the first that isn't
    low = np.stack([np.searchsorted(lists[1:-1, d], values[:, d]) for d in dims], axis=1) * dim + dims
    high = low + dim
    for _ in range(k):
        below, above = left - lists.take(low), lists.take(high) - left
        down = below <= above
        frontier, met = np.minimum(below, above), names.take(np.where(down, low, high))
        low, high = low - dim * down, high + dim * ~down
        fresh = np.zeros((len(active), k), bool)
        fresh.put(met + k * np.arange(len(active))[:, None], True)
        fresh &= ~seen[active]
        seen[active] |= fresh
        for c in np.flatnonzero(fresh.any(axis=0)):
            at = np.flatnonzero(fresh[:, c])
            rows, apart = active[at], left[at] - centroids[c]
            distance = np.einsum("ij,ij->i", apart, apart)
            computed += len(at)
            better = (distance < best[rows]) | ((distance == best[rows]) & (c < number[rows]))
            best[rows[better]], number[rows[better]] = distance[better], c
        undecided = np.einsum("ij,ij->i", frontier, frontier) <= best[active]
        if not undecided.any():
            break
        active, left, low, high = active[undecided], left[undecided], low[undecided], high[undecided]
    return number, best.astype(np.int64), computed


def _vectors(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, batch.num_rows, STEP):
        part = batch.column("vector").slice(at, STEP)
        yield at, np.frombuffer(b"".join(part.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, position, total, n: sums over the vectors nearest to each centroid; position -1 for the count alone."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, values in _vectors(batch, dim):
                number, _, _ = nearest(values, centroids)
                for c in np.unique(number):
                    sums[c] += values[number == c].sum(axis=0)
                counts += np.bincount(number, minlength=k)
        arrays = [np.repeat(np.arange(k), dim), np.tile(np.arange(dim), k), sums.ravel(), np.repeat(counts, dim)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], ["cluster", "position", "total", "n"])

    parts = vectors.select("vector").mapInArrow(run, "cluster long, position long, total long, n long")
    return parts.groupBy("cluster", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def first_centroids(vectors: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "vector").limit(k).collect()
    return np.array([np.frombuffer(r.vector, "<i4") for r in rows], np.int64).reshape(-1, dim)


def moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Each centroid at the floor of its vectors' mean; ``sums`` has k times dim rows."""
    out = centroids.copy()
    for r in sums.collect():
        if r.n:
            out[r.cluster, r.position] = r.total // r.n
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, values in _vectors(batch, dim):
                number, best, _ = nearest(values, centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(values)), pa.array(number, pa.int32()), pa.array(best)], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "vector").mapInArrow(run, "vec_id long, cluster int, distance long")


def kmeans(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of ``rows`` (vec_id, embedding) after ``rounds`` moves, and the centroids."""
    vectors = checkpoint(packed_vectors(rows, dim))
    centroids = first_centroids(vectors, k, seed, dim)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        after = moved(centroids, cluster_sums(vectors, centroids))
        if (after == centroids).all():  # nothing would move in any later round either
            break
        centroids = after
    return assigned(vectors, centroids), centroids


def with_inertia(members: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``members`` with cluster_inertia, inertia and centroid_sha256; one row a centroid is broadcast."""
    members = checkpoint(members)
    sums = {r.cluster: r.s for r in members.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = [(c, sums[c], sum(sums.values()), prints[c]) for c in sorted(sums)]
    few = members.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def oracle(k: int = K, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> str:
    """DuckDB SQL for the query: all distances, one step a round."""
    near = """a{r} AS MATERIALIZED (SELECT id, vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM
  (SELECT id, vec_id, v, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{r}) GROUP BY id, vec_id, v)"""
    move = """c{n} AS MATERIALIZED (SELECT c{r}.c, coalesce(m.w, c{r}.w) AS w FROM c{r} LEFT JOIN
  (SELECT c, list(floor_mean ORDER BY i) AS w FROM (SELECT c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS floor_mean
   FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) m ON m.c = c{r}.c)"""
    steps = []
    for r in range(rounds):
        steps += [near.format(r=r), move.format(r=r, n=r + 1)]
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w FROM (SELECT *, sha256('{seed}:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT {k})),
{", ".join([*steps, near.format(r=rounds)])}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c"""
