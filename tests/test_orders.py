import numpy as np
import pytest
from nichewright import catalog
from nichewright.operators import orders, tiles
from pyspark.sql import functions as F


def _table(spark, z, niche):
    vectors = spark.createDataFrame([(3 * i, v) for i, v in enumerate(z.tolist())], "row_idx long, z array<double>").repartition(3)
    return vectors, spark.createDataFrame([(3 * i, int(c), int(c) // 2) for i, c in enumerate(niche)], "row_idx long, niche int, half int")


@pytest.mark.parametrize("kind", ["plain", "ties", "equal", "far", "wide", "one"])
def test_percentiles_are_those_of_all_pairs(spark, monkeypatch, kind):
    rng = np.random.default_rng(8)
    z, niche = rng.normal(size=(150, 3)), rng.integers(0, 6, 150)
    if kind == "ties":
        z = np.round(z)
    if kind == "equal":
        z[:] = 0.3
    if kind == "far":
        z = z * 1e-7 + 5e4
    if kind == "wide":
        z[:5] *= 1e25
    if kind == "one":
        niche[:] = 1
    vectors, labels = _table(spark, z, niche)
    # Small enough that guesses miss, bins are many values wide and blocks meet others.
    for name, v in (("SAMPLE", 50), ("NEAR", 1e-3), ("BINS", 8), ("FEW", 20), ("BLOCK", 40)):
        monkeypatch.setattr(orders, name, v)
    got = orders.percentiles(vectors, labels, {0: 0.05, 1: 0.95}, ("niche", "half"))
    i, j = np.triu_indices(150, 1)
    cost = np.zeros(len(i))
    for k in range(3):
        cost += (z[i, k] - z[j, k]) ** 2
    for found, of in zip(got, (niche, niche // 2), strict=True):
        same = of[i] == of[j]
        for side, share in ((0, 0.05), (1, 0.95)):
            own = cost[same == bool(side)]
            assert found[side] == (pytest.approx(np.quantile(own, share), rel=1e-13) if len(own) else None)


def test_rows_that_are_not_finite_and_none_at_all(spark):
    z = np.random.default_rng(0).normal(size=(30, 2))
    vectors, labels = _table(spark, z, np.arange(30) % 3)
    odd = vectors.withColumn("z", F.when(F.col("row_idx") == 6, F.array(F.lit(float("nan")), F.lit(0.0))).otherwise(F.col("z")))
    assert orders.percentiles(odd, labels, {0: 0.05}) == [tiles.percentiles(odd, labels, {0: 0.05})]
    assert orders.percentiles(vectors.where("row_idx < 0"), labels, {0: 0.05, 1: 0.5}) == [{0: None, 1: None}]


@pytest.mark.parametrize("kind", ["plain", "ties", "far", "two"])
def test_nearest_clusters_are_those_of_tiles(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    z = np.abs(rng.normal(size=(2 if kind == "two" else 300, 4)))
    z = np.round(z) if kind == "ties" else z * 1e-6 + 700 if kind == "far" else z
    monkeypatch.setattr(orders, "BLOCK", 60)
    monkeypatch.setattr(orders, "PART", 500)
    rows = _table(spark, z, np.zeros(len(z)))[0].withColumn("niche", F.lit(0).cast("long"))
    want = tiles.folded(rows, tiles.NearestCluster, tiles.NearestCluster.schema)
    split = rows.select("row_idx", F.slice("z", 1, 3).alias("z"), F.col("z")[3].alias("spread"))
    assert sorted(map(tuple, orders.nearest_clusters(split, len(z), orders.centre_of(split)).collect())) == sorted(map(tuple, want.collect()))


def test_percentile_dunn_meets_each_pair_in_few_passes(spark, monkeypatch):
    passes = []
    made = orders._counted
    monkeypatch.setattr(orders, "_counted", lambda *a: passes.append(1) or made(*a))
    monkeypatch.setattr(tiles, "folded", None)
    assert catalog.QUERIES["percentile_dunn"](spark, "/root/testdata/sf0.001").first()[0] > 0 and len(passes) <= 2
