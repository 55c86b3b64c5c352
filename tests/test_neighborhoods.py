import random

import pytest
from nichewright import catalog
from nichewright.operators import measures, neighborhoods, neighbors
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), float(rng.randrange(-20, 40)), float(rng.randrange(60)), i % 3) for i in range(1500)]
    rows += [(2000, "a", None, 1.0, 0), (2001, "a", float("nan"), 1.0, 0), (2002, "far", 1e6, 1.0, 0), (2003, "", 0.0, 0.0, 0), (2004, "", 0.0, 0.0, 0)]
    return spark.createDataFrame(rows, "row_idx long, sample_id string, x double, y double, state long").repartition(3)


def same(got, want, *columns):
    a, b = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()) for df in (got, want))
    assert len(a) > 100 and len(a) == len(b) and all(x == pytest.approx(y, abs=1e-8) for x, y in zip(a, b, strict=True))


def test_nearest(cells):
    same(neighborhoods.nearest_within(cells, 5.0, 3), neighbors.nearest_within(neighbors.radius_edges(cells, 5.0), 3), "row_idx", "neighbor", "distance", "rank")


@pytest.mark.parametrize("kernel,anchor,isolated", [("gaussian", True, "anchor_fallback"), ("inverse", False, "anchor_fallback"), ("uniform", False, "zero_dummy")])
def test_supports(cells, kernel, anchor, isolated):
    edges = neighbors.radius_edges(cells, 4.0).withColumn("weight", measures.kernel_weight(F.col("distance"), 4.0, kernel))
    same(neighborhoods.supports(cells, 4.0, kernel, anchor, isolated), measures.assemble(cells, edges, anchor, isolated), "row_idx", "neighbor", "distance", "weight", "mass")


@pytest.mark.parametrize("by_state", [False, True])
def test_caps(cells, by_state):
    edges = neighbors.radius_edges(cells, 9.0).withColumn("weight", measures.kernel_weight(F.col("distance"), 9.0, "gaussian")).withColumn("state", F.col("neighbor") % 3)
    edges = edges.join(cells.select(F.col("row_idx").alias("neighbor"), F.col("state").alias("s")), "neighbor").withColumn("state", F.col("s")).drop("s")
    for most in (2, 6):
        same(neighborhoods.capped(cells if by_state else cells.drop("state"), 9.0, most), measures.cap_neighbors(edges, 9.0, most, by_state=by_state), "row_idx", "neighbor", "weight")


@pytest.mark.parametrize("name", ["cap_radial_shell", "cap_radial_shell_state", "isolated_anchor_fallback", "isolated_zero_dummy", "instance_neighbors_topk", "kernel_weights_gaussian", "kernel_weights_inverse", "kernel_weights_uniform"])
def test_queries_shuffle_no_edges(spark, monkeypatch, name):
    def none(*_, **__):
        raise AssertionError("a table of edges")

    monkeypatch.setattr(neighbors, "radius_edges", none)
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and "Join" not in plan and "Window" not in plan
