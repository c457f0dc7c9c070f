import hashlib
import math

import duckdb
import numpy as np
import pytest

from readlog.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string, vector int, position int, n int"
TESTDATA = "/root/testdata/sf0.001"


def plain(rows, k=8, rounds=10, seed=3, dim=4):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of (vec_id, embedding)."""
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x):
            kept.append((vec_id, [max(-clustering.BOUND, min(clustering.BOUND, math.floor(1024 * float(np.float32(v))))) for v in x]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == i]
            if own:
                centroids[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(vec_id, *nearest(v)) for vec_id, v in kept]
    inertia = sum(d for _, d, _ in last)
    return sorted(((v, c, d, sum(e for _, e, o in last if o == c), inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for v, d, c in last), key=repr)


def result(frame, **options):
    return sorted(map(tuple, clustering.with_inertia(*clustering.kmeans(frame, **options)).collect()), key=repr)


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", "d", 2, 3, 4) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("k", "dim", "top"), [(3, 2, 3), (8, 3, 4), (40, 4, 30), (1, 5, 3), (8, 1, 3), (8, 64, 1 << 22), (8, 64, 1 << 27)])
def test_nearest_is_exact_with_ties(k, dim, top):
    r = np.random.default_rng(k * dim)
    values, centroids = r.integers(-top, top + 1, (500, dim)), r.integers(-top, top + 1, (k, dim))
    values[:5] = centroids[:1]
    number, best, computed = clustering.nearest(values, centroids)
    apart = ((values[:, None] - centroids[None]) ** 2).sum(2)
    assert (number == apart.argmin(1)).all() and (best == apart.min(1)).all() and computed <= 500 * k


def test_walk_stops_early():
    """Well-parted centroids: the nearest and a neighbour on either side are computed, of fifty."""
    r = np.random.default_rng(1)
    centroids = 1000 * np.arange(50)[:, None] + r.integers(0, 9, (50, 16))
    values = centroids[r.integers(0, 50, 2000)] + r.integers(-20, 20, (2000, 16))
    number, best, computed = clustering.nearest(values, centroids)
    apart = ((values[:, None] - centroids[None]) ** 2).sum(2)
    assert (number == apart.argmin(1)).all() and (best == apart.min(1)).all()
    assert computed <= 3 * 2000


def test_kmeans_against_plain(spark):
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.normal(i % 5, 0.2, 4)]) for i in range(200)]
    rows += [(300 + i, [0.25, 0.5, -0.125, 1.0]) for i in range(60)]  # copies
    rows += [(7, [1.0, 2.0, 3.0, 4.0]), (7, [4.0, 3.0, 2.0, 1.0]), (None, [0.5] * 4), (None, None)]
    rows += [(400, None), (401, []), (402, [1.0] * 3), (403, [1.0] * 5), (404, [1.0, None, 1.0, 1.0]), (405, [1.0, math.nan, 1.0, 1.0]), (406, [math.inf, 1.0, 1.0, 1.0]), (407, [-0.0001, 0.0, 0.0001, -1e-9]), (408, [3e30, -3e30, 1.0, 0.0])]
    assert result(frame_of(spark, rows), dim=4) == plain(rows)


def test_fewer_vectors_than_centroids_and_ties(spark):
    rows = [(i, [1.0, 1.0]) for i in range(3)]
    got = result(frame_of(spark, rows), dim=2)
    assert got == plain(rows, dim=2) and {r[1] for r in got} == {0}
    assert result(frame_of(spark, [(1, None)]), dim=2) == [] == result(spark.createDataFrame([], SCHEMA), dim=2)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{TESTDATA}/embeddings.parquet'")
    rows = con.sql(clustering.oracle())
    got = clustering.op12_centroid_clustering(spark, TESTDATA).select(*rows.columns)
    assert sorted(map(tuple, got.collect())) == sorted(rows.fetchall())
