"""Clustering against brute force over every vector and centroid."""

import hashlib
import random

import numpy as np
import pytest

from runlens.llm import clustering

D = clustering.DIMENSIONS


def brute(rows, clusters, rounds):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == D and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in named[:clusters]]
    far = lambda q, c: sum((x - y) ** 2 for x, y in zip(q, c))
    nearest = lambda q: min((far(q, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest(q)[1] for _, q in kept]
        for c in range(len(centroids)):
            own = [q for (_, q), a in zip(kept, at) if a == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    told = [(i, *nearest(q)[::-1]) for i, q in kept]
    inertia = [sum(d for _, a, d in told if a == c) for c in range(len(centroids))]
    return sorted(map(str, ((i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in told)))


def vectors(n, seed):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.4) for _ in range(D)] for _ in range(5)]
    out = [(i, [float(np.float32(x + rnd.gauss(0, 0.2))) for x in rnd.choice(centres)]) for i in range(n)]
    same = out[0][1]
    out += [(n + i, same) for i in range(n // 3)] + [(3, out[3][1]), (3, out[4][1]), (None, out[5][1]), (None, [0.0] * D)]
    return out + [(-1, None), (-2, []), (-3, [1.0] * (D - 1)), (-4, [None] + [0.0] * (D - 1)), (-5, [float("nan")] + [0.0] * (D - 1)), (-6, [float("inf")] + [0.0] * (D - 1)), (-7, [5.0] * D)]


@pytest.mark.parametrize("n,clusters,rounds,bits", [(120, 16, 3, 5), (60, 4, 2, 1), (40, 7, 3, 3)])
def test_clusters_equal_brute_force(spark, n, clusters, rounds, bits):
    rows = vectors(n, n)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as key", "2 as cluster", "3 as q", "4 as distance")
    got = clustering.cluster_vectors(df, clusters=clusters, rounds=rounds, bits=bits).collect()
    assert sorted(map(str, map(tuple, got))) == brute(rows, clusters, rounds)


def test_few_or_no_vectors(spark):
    schema = "vec_id string, embedding array<float>"
    rows = [("a", [0.5] * D), ("b", [-0.5] * D)]
    assert sorted(map(str, map(tuple, clustering.cluster_vectors(spark.createDataFrame(rows, schema)).collect()))) == brute(rows, 16, 3)
    assert clustering.cluster_vectors(spark.createDataFrame([], schema)).collect() == []
    assert clustering.cluster_vectors(spark.createDataFrame([("a", [3e38] * D), ("b", [-3e38] * D), ("c", [0.0] * D)], schema)).count() == 3


def test_bounds_hold_every_distance():
    rnd = np.random.default_rng(3)
    q, centroids = rnd.integers(-50, 50, (300, D)), rnd.integers(-50, 50, (6, D))
    for bits in (1, 3, 5):
        edges = [np.quantile(q[:, d], [i / (1 << bits) for i in range(1, 1 << bits)]).astype(np.int64) for d in range(D)]
        bounds = np.array([[q[:, d].min(), *sorted(e), q[:, d].max() + 1] for d, e in enumerate(edges)])
        near, far = clustering.distance_tables(bounds, centroids)
        cells = clustering.cells_of(q, bounds)
        exact = ((q[:, None] - centroids) ** 2).sum(2)
        assert (near[np.arange(D), cells].sum(1) <= exact).all() and (exact <= far[np.arange(D), cells].sum(1)).all()
