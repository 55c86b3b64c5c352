import numpy as np
import pytest
from nichewright import catalog
from nichewright.operators import metrics, moments, tiles, transport


def _table(spark, kind):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(80, 3))
    niche = rng.integers(0, 6, 80)
    niche[0] = 9  # a singleton
    if kind == "copies":
        z[40:] = z[:40]
    if kind == "far":
        z = z * 1e-6 + 1000.0 * niche[:, None]
    if kind == "equal":
        z[:] = 0.1 + rng.random(3)
    if kind == "one":
        niche[:] = 2
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(z.tolist())], "row_idx long, z array<double>").repartition(3)
    return vectors, spark.createDataFrame(list(enumerate(niche.tolist())), "row_idx long, niche int")


@pytest.mark.parametrize("kind", ["plain", "copies", "far", "equal", "one"])
def test_moments_give_what_pairs_give(spark, kind):
    vectors, labels = _table(spark, kind)
    rows = moments.rows_of(vectors, labels)
    found = moments.gathered(rows)
    pairs = metrics.labelled(transport.mirrored(transport.squared_euclidean(vectors)), labels)
    want = metrics.within_between(pairs).first()["ratio"]
    got = moments.within_between(rows, found)
    assert got == (want if want is None else pytest.approx(want, rel=1e-9))
    want = metrics.calinski_harabasz(pairs, labels).first()[0]
    got = moments.calinski_harabasz(found)
    assert got == (want if want is None else pytest.approx(want, rel=1e-9))
    by = lambda df: {(r.i, r.li, r.lj): (r.total, r.n) for r in df.collect()}
    want, got = by(tiles.niche_sums(vectors, labels)), by(moments.niche_sums(rows, found))
    assert got.keys() == want.keys()
    assert all(got[k][1] == v[1] and got[k][0] == pytest.approx(v[0], rel=1e-9) for k, v in want.items())


def test_without_rows_or_with_too_many_numbers_there_are_none(spark, monkeypatch):
    vectors, labels = _table(spark, "plain")
    assert moments.gathered(moments.rows_of(vectors.where("row_idx < 0"), labels)) is None
    monkeypatch.setattr(moments, "MOST_NUMBERS", 100)
    assert moments.gathered(moments.rows_of(vectors, labels)) is None


@pytest.mark.parametrize("name", ["pseudo_ch", "within_between"])
def test_queries_make_no_pairs(spark, monkeypatch, name):
    def none(*_, **__):
        raise AssertionError("all pairs")

    monkeypatch.setattr(transport, "squared_euclidean", none)
    monkeypatch.setattr(tiles, "folded", none)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").first()[0] is not None
