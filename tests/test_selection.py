import numpy as np
import pytest
from nichewright import catalog
from nichewright.config import METRICS
from nichewright.operators import clustering, transport


def test_selection_by_tiles_equals_that_by_pairs(spark):
    z = np.random.default_rng(2).normal(size=(60, 3))
    vectors = spark.createDataFrame([(3 * i, v) for i, v in enumerate(z.tolist())], "row_idx long, z array<double>")
    ids, ks = vectors.select("row_idx"), (2, 5, 40)
    want, got = clustering.select_model(transport.mirrored(transport.squared_euclidean(vectors)), ids, ks, names=METRICS), clustering.select_model_of_vectors(vectors, ids, ks, METRICS)
    for a, b in zip(*(t[0].orderBy("k").collect() for t in (want, got)), strict=True):
        assert a.asDict() == pytest.approx(b.asDict(), rel=1e-9)
    assert sorted(want[1].collect()) == sorted(got[1].collect())


@pytest.mark.parametrize("name", ["model_selection", "pseudo_ch"])
def test_queries_make_no_table_of_pairs(spark, monkeypatch, name):
    def none(*_, **__):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(transport, "squared_euclidean", none)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_candidates_are_scored_without_a_pass_each(spark, monkeypatch):
    from nichewright.operators import tiles

    monkeypatch.setattr(tiles, "folded", None)
    assert catalog.QUERIES["model_selection"](spark, "/root/testdata/sf0.001").count() == 5
