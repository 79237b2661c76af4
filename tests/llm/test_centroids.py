import hashlib
import math

import numpy as np

from asofia.llm import centroids, oracle
from asofia.llm.queries import ORACLE_SQL, QUERIES
from duck import same


def test_matches_sql(spark):
    same(spark, QUERIES["op11_centroid_clustering"], ORACLE_SQL["op11_centroid_clustering"])


def test_planes_give_exact_dot_products():
    rng = np.random.default_rng(5)
    for most in (0, 1, 5, 300, (1 << 26) - 1):
        a, b = rng.integers(-most - 1, most + 1, (50, 64)), rng.integers(-most - 1, most + 1, (1, 64))
        left, right = centroids.planes_of(a), centroids.planes_of(b)
        assert (centroids.components_of(left) == a).all() and (centroids.components_of(right) == b).all()
        assert (centroids.dots(left, right[0]) == a @ b[0]).all() and (centroids.norms(left) == (a * a).sum(axis=1)).all()
        near, distance = centroids.nearest(left, [right[0], centroids.planes_of(a[:1])[0]])
        both = np.stack([((a - b) ** 2).sum(axis=1), ((a - a[0]) ** 2).sum(axis=1)])
        assert (distance == both.min(axis=0)).all() and (near == both.argmin(axis=0)).all()


def brute(rows, clusters, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None), key=lambda x: x[0])
    c = [v for _, v in first[:clusters]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), k) for k, x in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        near = assign()
        for k in range(len(c)):
            own = [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == k]
            if own:
                c[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = assign()
    inertia = [sum(d for d, n in near if n == k) for k in range(len(c))]
    return sorted((str(i), k, d, inertia[k], sum(inertia), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, near, strict=True))


def test_odd_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 64)]) for i in range(60)]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (61, None), (62, []), (63, [0.1] * 63), (64, [0.1] * 63 + [None]), (65, [0.1] * 63 + [math.nan]), (66, [0.1] * 63 + [math.inf]), (67, [0.0] * 64), (68, [5000.5] * 64)]
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, planes string, n int").repartition(5)
    run = lambda df, **kw: sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.centroid_clusters(df, **kw).collect())
    assert run(table) == brute(rows, 16, 3)
    assert run(table, clusters=100, rounds=1) == brute(rows, 100, 1)
    assert run(table.limit(0)) == [] and run(table.filter("vec_id is null")) == []
    assert run(table.withColumn("embedding", table.embedding.cast("array<float>")).filter("vec_id < 61"))[0][4] > 0
    big = [(1, [2.0**19] * 64), (2, [2.0**20] * 64), (3, [-(2.0**20)] * 64), (4, [-(2.0**21)] * 64)]  # the second and the last are beyond 27 planes
    assert [r[0] for r in run(spark.createDataFrame(big, "vec_id long, embedding array<float>"))] == ["1", "3"]


def test_empty_centroids_stay(spark):
    rows = [(i, [0.5] * 64) for i in range(30)]
    assert {r[1] for r in brute(rows, 16, 3)} == {0}
    found = centroids.centroid_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.cluster for r in found} == {0} and {r.distance for r in found} == {0}


def test_sql_has_the_rounds_asked_for():
    assert "a3 as" in oracle.centroids(16, 3) and "a4 as" not in oracle.centroids(16, 3)
