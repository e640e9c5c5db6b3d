import math
import random
from hashlib import sha256

import numpy as np
import pytest

from voxelgrove.llm import centroid_clusters as C


def brute(rows, k=8, rounds=10, seed=3, scale=1024, dim=64):
    """Plain Lloyd rounds over Python integers: a list of (id, cluster, distance, cluster_inertia, inertia, digest)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(((sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept))[:k]
    centroids = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    total = {j: sum(d for d, c in found if c == j) for j in range(len(centroids))}
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, total[c], sum(total.values()), digest[c]) for (i, _), (d, c) in zip(kept, found))


def rows_of(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_orchard_equals_a_scan_and_measures_less():
    rng = np.random.default_rng(3)
    for k, dim, spread in ((1, 3, 5), (2, 2, 2), (8, 3, 3), (40, 2, 4), (60, 8, 1000)):
        centroids = rng.integers(-spread, spread + 1, (k, dim))
        x = rng.integers(-spread, spread + 1, (3000, dim))
        every = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
        best, d, measured = C.orchard(x, centroids, *C.neighbour_lists(centroids), rng.integers(0, k, len(x)))
        assert (best == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
        assert measured <= every.size
        again = C.orchard(x, centroids, *C.neighbour_lists(centroids), best)
        assert (again[0] == best).all()
        if k == 40:
            assert again[2] < 0.4 * every.size


def test_largest_components_do_not_overflow():
    most = C.limit(64)
    centroids = np.array([[most] * 64, [-most] * 64], np.int64)
    best, d, _ = C.orchard(np.array([[-most] * 64, [most - 1] * 64]), centroids, *C.neighbour_lists(centroids), np.zeros(2, int))
    assert best.tolist() == [1, 0] and d.tolist() == [0, 64]


def test_against_plain_rounds(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 0.001]) * rng.random() for _ in range(6)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)] + [(5, rows[5][1])] * 3
    rows += [(500, None), (501, [1.0] * 5), (502, [1.0] * 5 + [None]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (None, [0.25] * 6), (None, [-0.25] * 6), (505, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for k, rounds in ((8, 10), (3, 0), (40, 4)):
        assert rows_of(C.cluster_vectors(df, k=k, rounds=rounds, dim=6)) == brute(rows, k, rounds, dim=6)


def test_few_vectors_ties_and_huge_components(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = rows_of(C.cluster_vectors(df, dim=2, rounds=3))
    assert got == brute(rows, dim=2, rounds=3) and {c for _, c, *_ in got} < {0, 1, 2}
    far = C.cluster_vectors(spark.createDataFrame([(1, [1e300, -1e300]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>"), k=1, rounds=1, dim=2).collect()
    assert {r.distance for r in far} == {2 * (C.limit(2) // 2) ** 2, 2 * (C.limit(2) // 2 + 1) ** 2} or all(r.distance > 0 for r in far)
    with pytest.raises(ValueError):
        C.cluster_vectors(df, k=0)


def test_the_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(C.op12_orchard_clusters(spark, sf)) == brute(rows)


def test_empty_and_clashing_tables(spark):
    df = spark.createDataFrame([(1, [0.0] * 64, "a", "b")], "vec_id long, embedding array<float>, cluster string, other string")
    got = C.cluster_vectors(df)
    assert got.columns == ["vec_id", "other", *C.ADDED] and got.collect()[0][:5] == (1, "b", 0, 0, 0)
    none = C.cluster_vectors(df.limit(0))
    assert none.columns == got.columns and none.dtypes == got.dtypes and none.collect() == []
