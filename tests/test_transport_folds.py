import numpy as np
import pytest
from nichewright import catalog
from nichewright.functions import kernels
from nichewright.operators import graphs, transport
from pyspark.sql import functions as F

KERNEL = {"epsilon": 0.5, "sweeps": 3}


@pytest.fixture(scope="module")
def packed(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in rng.permutation(90)[:70]:
        m = int(rng.integers(1, 9))
        mass = rng.random(m)
        rows.append((int(i), m, (mass / mass.sum()).tolist(), rng.normal(size=3 * m).round(1).tolist()))
    rows += [(i + 100, *r[1:]) for i, *r in [(r[0], *r) for r in rows[:20]]]  # copies, so that costs tie
    return spark.createDataFrame([(r[0], *r[-3:]) for r in rows], "row_idx long, m int, masses array<double>, tokens array<double>").repartition(3)


def test_self_costs_are_taken_off_where_pairs_are_made(packed):
    plain, own = transport.pair_costs(packed, block=16, **KERNEL), transport.self_costs(packed, **KERNEL)
    want = {(r.i, r.j): r.cost for r in transport.debias(plain, own).collect()}
    for block in (16, 128):
        got = {(r.i, r.j): r.cost for r in transport.distances(packed, block=block, **KERNEL).collect()}
        assert got.keys() == want.keys() and len(got) == 90 * 89 // 2 and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
    few = packed.where("row_idx < 20")
    want = {(r.i, r.j): r.cost for r in transport.debias(transport.pair_costs(packed, few, **KERNEL), own).collect()}
    got = {(r.i, r.j): r.cost for r in transport.distances(packed, few, block=16, **KERNEL).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


@pytest.mark.parametrize("block", [16, 128])
def test_nearest_equals_the_ranks_of_all_pairs(packed, block):
    both = transport.mirrored(transport.distances(packed, **KERNEL)).withColumn("cost", F.round("cost", 2))
    want = sorted((r.i, r["rank"], r.j, r.cost) for r in graphs.knn(both, 5).collect())
    assert sorted((r.i, r["rank"], r.j, r.cost) for r in transport.nearest(packed, 5, 2, block=block, **KERNEL).collect()) == want
    assert transport.nearest(packed.limit(1), 5, 2, **KERNEL).count() == 0 and transport.nearest(packed.where("m > 99"), 5, 2, **KERNEL).count() == 0


def test_rounds_as_spark_does(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.random(300) * 9, rng.integers(0, 10**7, 300) / 1e6 + 5e-7, np.nextafter(rng.integers(0, 10**7, 300) / 1e6 + 5e-7, 0), [0.0, 0.5, 1.0000005, 2.5e-6, 1e-9]])
    want = spark.createDataFrame([(n, float(v)) for n, v in enumerate(x)], "n int, v double").select("n", F.round("v", 6).alias("r")).orderBy("n").collect()
    assert transport.round_half_up(x, 6).tolist() == [r.r for r in want]


@pytest.mark.parametrize("name,step", [("debiased_transport", "debias"), ("cross_transport", "debias"), ("transport_knn", "mirrored")])
def test_queries_join_and_turn_no_table_of_pairs(spark, monkeypatch, name, step):
    def none(*_, **__):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(transport, step, none)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_arrays_fit_a_cache(monkeypatch):
    seen = []
    made = kernels.cost_matrix
    monkeypatch.setattr(kernels, "cost_matrix", lambda a, b: seen.append(made(a, b)) or seen[-1])
    side = object.__new__(transport._Side)
    side.ids, side.size, side.mass, side.token = np.arange(200), np.full(200, 40), np.full((200, 40), 1 / 40), np.random.default_rng(0).random((200, 40, 5))
    at = np.arange(200)
    transport._compute(side, side, at, at, "sinkhorn", 0.5, 3, 0.5, 1)
    assert max(a.nbytes for a in seen) <= 1 << 19
