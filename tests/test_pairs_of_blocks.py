"""Blocks are shuffled once a side, however many blocks they meet, and anchors are added where pairs are made."""

import numpy as np
import pytest
from nichewright import catalog
from nichewright.operators import transport

KERNEL = {"epsilon": 0.5, "sweeps": 3}


@pytest.fixture(scope="module")
def packed(spark):
    rng = np.random.default_rng(11)
    rows = [(i, 3, [0.5, 0.25, 0.25], rng.normal(size=6).tolist()) for i in range(60)]
    return spark.createDataFrame(rows, "row_idx long, m int, masses array<double>, tokens array<double>")


@pytest.mark.parametrize("crossed", [False, True])
def test_blocks_are_written_once_a_side(packed, crossed):
    pairs, _ = transport._planned(packed, packed if crossed else None, "sinkhorn", 0.5, 3, 0.5, 1, 8)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" in plan and pairs.count() == (64 if crossed else 36)


def test_shares_make_all_pairs_once(packed):
    found = [(r.i, r.j) for n in range(3) for r in transport.pair_costs(packed, block=8, share=(n, 3), **KERNEL).collect()]
    assert sorted(found) == [(i, j) for i in range(60) for j in range(i + 1, 60)]


@pytest.mark.parametrize("left,right", [(1, 1), (16, 16), (16, 1), (1, 16), (81, 81), (801, 801), (801, 1), (801, 40)])
def test_partitions_are_enough_and_small(left, right):
    p, q = transport._parts(left, right, 80)
    assert p <= left and q <= right and p * transport.MOST_BLOCKS >= left and q * transport.MOST_BLOCKS >= right and p * q >= min(80, left * right)


@pytest.mark.parametrize("mode", ["debiased", "sinkhorn"])
def test_anchors_equal_a_join_of_vectors(spark, packed, mode):
    rng = np.random.default_rng(3)
    z = [(i, None if i == 4 else [1.0, None] if i == 5 else rng.normal(size=2).tolist()) for i in range(59)]  # row 59 has none
    vectors = spark.createDataFrame(z, "row_idx long, z array<double>")
    few = packed.where("row_idx < 9")
    for other, other_vectors in ((None, None), (few, None), (few, vectors.where("row_idx > 2"))):
        plain = transport.distances(packed, other, mode, block=16, **KERNEL)
        want = {(r.i, r.j): r.cost for r in transport.anchor_penalty(plain, vectors, 0.3, other_vectors).collect()}
        got = {(r.i, r.j): r.cost for r in transport.distances(packed, other, mode, block=16, anchors=(0.3, vectors, other_vectors), **KERNEL).collect()}
        assert got.keys() == want.keys() and all(v is got[k] is None or got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())

def test_query_joins_no_table_of_pairs(spark, monkeypatch):
    def none(*_, **__):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(transport, "anchor_penalty", none)
    assert catalog.QUERIES["anchor_penalty"](spark, "/root/testdata/sf0.001").count() > 0
