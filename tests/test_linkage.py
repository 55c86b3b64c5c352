import numpy as np
import pytest
from nichewright import catalog
from nichewright.operators import clustering, transport


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    z = np.concatenate([rng.normal(size=(220, 3)), np.tile(rng.normal(size=(2, 3)), (30, 1))])  # two groups of thirty copies
    ids = rng.permutation(2000)[: len(z)]
    return spark.createDataFrame([(int(i), v) for i, v in zip(ids, z.tolist())], "row_idx long, z array<double>").repartition(4)


@pytest.mark.parametrize("tail", [8, 64, 500])
def test_linkage_of_vectors_equals_that_of_their_distances(vectors, tail):
    ids, ks = vectors.select("row_idx"), (2, 7, 40, 150)
    want = clustering.agglomerate(transport.squared_euclidean(vectors), ids, ks, 500).collect()
    merges = clustering.average_merges_of_vectors(vectors, ids, tail)
    assert sorted(clustering.cut(merges, ids, ks).collect()) == sorted(want)
    found = merges.collect()
    assert len({r.b for r in found}) == len(found) == vectors.count() - 1 and sum(r.height == 0 for r in found) == 58


def test_cases(spark, vectors):
    ids = vectors.select("row_idx")
    assert clustering.agglomerate_vectors(vectors.limit(0), ids.limit(0), (2,)).count() == 0
    for bad in (None, [1.0, None, 2.0], [1.0, float("nan"), 2.0]):
        rows = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, bad)], "row_idx long, z array<double>")
        with pytest.raises(ValueError):
            clustering.agglomerate_vectors(rows, rows, (2,))


def test_query_makes_no_table_of_pairs(spark, monkeypatch):
    def none(*_, **__):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(transport, "squared_euclidean", none)
    assert catalog.QUERIES["agglomerative_labels"](spark, "/root/testdata/sf0.001").count() > 0


def test_rounds_meet_each_pair_of_clusters_once(spark, monkeypatch):
    from nichewright.operators import tiles

    monkeypatch.setattr(tiles, "folded", None)
    vectors = spark.createDataFrame([(i, [float(i * i), 1.0]) for i in range(40)], "row_idx long, z array<double>")
    assert clustering.average_merges_of_vectors(vectors, vectors.select("row_idx"), tail=4).count() == 39
