import hashlib
import math

import duckdb
import numpy as np
import pytest
from nichewright.llm import centroids as C
from nichewright.llm import queries
from pyspark.sql import functions as F


def brute(rows, k, rounds, factor=256, salt="2:"):
    """(vec_id, cluster, distance, centroid hash) in Python integers, every vector against every centroid."""
    kept = [(i, [math.floor(factor * x) for x in v]) for i, v in rows]
    draw = lambda i: (i is None, hashlib.sha256(f"{salt}{i}".encode()).hexdigest())
    centre = [v for _, v in sorted(kept, key=lambda r: (*draw(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centre))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own, strict=True) if o == n] for n in range(len(centre))]
        centre = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else c for g, c in zip(groups, centre, strict=True)]
    found = [nearest(v) for _, v in kept]
    out = []
    for (i, _), (d, n) in zip(kept, found, strict=True):
        out.append((i, n, d, sum(e for e, m in found if m == n), sum(e for e, _ in found), hashlib.sha256(",".join(map(str, centre[n])).encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(rng, n, d, spread=0.2):
    centre = rng.normal(size=(7, d))
    return [(int(i), (centre[i % 7] + spread * rng.normal(size=d)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("k", "spread"), [(1, 0.2), (2, 0.2), (13, 0.05), (13, 2.0)])
def test_equals_brute_force(spark, k, spread):
    rows = vectors(np.random.default_rng(3), 150, 6, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert collected(C.exponion_clusters(df, F.col("embedding"), k, 4, 6)) == brute(rows, k, 4)


def test_ties_copies_and_empty_centroids(spark):
    """A small grid has ties everywhere, and copies that start several equal centroids, all but one of which stay empty."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(0, 3, 4) / 256).tolist()) for i in range(120)] + [(500 + i, [0.0] * 4) for i in range(60)] + [(7, [0.0] * 4)] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert collected(C.exponion_clusters(df, F.col("embedding"), 25, 5, 4)) == brute(rows, 25, 5)


def test_fewer_vectors_than_centroids_and_null_ids(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.25, 1.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cluster int")
    assert collected(C.exponion_clusters(df, F.col("embedding"), 40, 5, 2)) == brute(rows, 40, 5)
    assert collected(C.exponion_clusters(df, F.col("embedding"), 2, 5, 2)) == brute(rows, 2, 5)


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert collected(C.exponion_clusters(df, F.col("embedding"), 5, 2, 2)) == brute([rows[0], rows[-1]], 5, 2)
    assert C.exponion_clusters(df.where("vec_id = 2"), F.col("embedding")).collect() == []
    assert C.exponion_clusters(df.limit(0), F.col("embedding")).dtypes[0] == ("vec_id", "bigint")


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.uniform(-3e5, 3e5, (60, 3)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert collected(C.exponion_clusters(df, F.col("embedding"), 9, 3, 3)) == brute(rows, 9, 3)
    wide = spark.createDataFrame([(1, [1e30] * 3), (2, [-1e300] * 3)], "vec_id long, embedding array<double>")
    assert {r.distance for r in C.exponion_clusters(wide, F.col("embedding"), 1, 0, 3).collect()} == {0, 3 * (2 * C.MOST) ** 2}


def test_the_ball_leaves_most_centroids_out():
    rng = np.random.default_rng(8)
    x = np.floor(256 * np.array([v for _, v in vectors(rng, 2000, 8, 0.05)])).astype(np.int64)
    centre = x[:64].copy()
    own, upper, lower = np.zeros(len(x), int), np.full(len(x), np.inf), np.zeros(len(x))
    before, scans = None, []
    for _ in range(6):
        search = C.Exponion(centre, before)
        own, upper, lower = search.assign(x, own, upper, lower)
        d = C.squared(x, centre)
        assert (own == d.argmin(1)).all()
        assert (upper**2 * (1 + 1e-6) + 1e-6 >= d.min(1)).all() and (np.maximum(lower, 0) ** 2 <= np.partition(d, 1, 1)[:, 1] * (1 + 1e-6) + 1e-6).all()
        before, centre = centre, np.stack([x[own == c].sum(0) // max(1, (own == c).sum()) if (own == c).any() else centre[c] for c in range(64)])
        scans.append(search.scanned)
    assert max(scans[1:]) < 0.3 * len(x) * 64


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op11_exponion"]).fetchall())
    got = queries.op11_exponion(spark, "/root/testdata/sf0.001").select(*(c[0] for c in con.description))
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 500
