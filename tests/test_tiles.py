import numpy as np
import pytest
from nichewright import catalog
from nichewright.operators import clustering, tiles, transport


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    z = rng.integers(0, 5, size=(2500, 3)).astype(float)  # many copies and ties; more rows than a tile
    ids, niche = rng.permutation(9000)[:2500], rng.integers(0, 4, size=2500)
    niche[:1] = 9  # a singleton
    vectors = spark.createDataFrame([(int(i), v) for i, v in zip(ids, z.tolist())] + [(9999, None)], "row_idx long, z array<double>").repartition(5)
    labels = spark.createDataFrame([(int(i), int(n)) for i, n in zip(ids, niche)] + [(9999, 0)], "row_idx long, niche int")
    order = np.argsort(ids)
    ids, z, niche = ids[order], z[order], niche[order]
    return vectors, labels, ids, niche, ((z[:, None] - z[None]) ** 2).sum(-1)


def test_nearest(rows):
    vectors, _, ids, _, d = rows
    got = {(r.i, r["rank"]): (r.j, r.cost) for r in tiles.knn(vectors, 7).collect()}
    want = {}
    for a in range(len(ids)):
        near = [b for b in np.lexsort((ids, d[a]))[:8] if b != a][:7]
        want |= {(ids[a], n + 1): (ids[b], d[a, b]) for n, b in enumerate(near)}
    assert got == want
    few = vectors.where("row_idx < 30")
    n = few.count()
    assert tiles.knn(few, 40).count() == n * (n - 1) and tiles.knn(vectors.where("z is null"), 3).count() == 0


@pytest.mark.parametrize("within", [False, True])
def test_niche_sums(rows, within):
    vectors, labels, ids, niche, d = rows
    got = {(r.i, r.li, r.lj): (r.total, r.n) for r in tiles.niche_sums(vectors, labels, within).collect()}
    want = {}
    for a in range(len(ids)):
        for name in np.unique(niche):
            own = (niche == name) & (np.arange(len(ids)) != a)
            if own.any() and (not within or name == niche[a]):
                want[ids[a], niche[a], name] = (d[a, own].sum(), own.sum())
    assert got == want


def test_extremes_and_percentiles(rows):
    vectors, labels, ids, niche, d = rows
    same, other = niche[:, None] == niche[None], np.triu(np.ones_like(d, bool), 1)
    got = {r.i: (r.between, r.within) for r in tiles.extremes(vectors, labels).collect()}
    assert got == {i: (d[a][~same[a]].min(), d[a][same[a]].max()) for a, i in enumerate(ids)}
    found = tiles.percentiles(vectors, labels, {0: 0.37, 1: 0.95})
    assert found == pytest.approx({0: np.quantile(d[~same & other], 0.37), 1: np.quantile(d[same & other], 0.95)}, abs=1e-12)
    alone = labels.where("niche = 9")
    assert tiles.percentiles(vectors, alone, {0: 0.05, 1: 0.95}) == {0: None, 1: None}


def test_medoids_without_a_table_of_pairs(rows):
    vectors, labels = (df.where("row_idx < 1200") for df in rows[:2])
    distance = transport.mirrored(transport.squared_euclidean(vectors))
    own = labels.where("row_idx < 9999")
    assert clustering.farthest_vectors(vectors, own, 5) == clustering.farthest_first(distance, own, 5)
    a, b = (f(x, own, 4, 8) for f, x in ((clustering.kmedoids_of_vectors, vectors), (clustering.kmedoids, distance)))
    assert a[1] == b[1] and sorted(a[0].collect()) == sorted(b[0].collect())


@pytest.mark.parametrize("name", ["ot_knn", "ot_knn_distance_graph", "ot_knn_affinity_local", "ot_knn_affinity_global", "assignment_score", "silhouette", "medoid_db", "percentile_dunn", "minimum_dunn", "cluster_medoids", "farthest_first", "kmedoids", "leiden_labels"])
def test_queries_make_no_table_of_pairs(spark, monkeypatch, name):
    def none(*_, **__):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(transport, "squared_euclidean", none)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
