"""Runs that are broken off and continue, stored self costs, seeded landmarks and supports without mass."""

import numpy as np
import pytest
from nichewright.config import NicheConfig
from nichewright.operators import assignment, measures, transport
from nichewright.plans import restart, runs
from nichewright.sources import bundle
from pyspark.sql import functions as F

PACKED = "row_idx long, m int, masses array<double>, tokens array<double>"
KERNEL = {"epsilon": 0.3, "sweeps": 8, "block": 4}


def packed_of(spark, n=23, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        m = int(rng.integers(1, 5))
        mass = rng.random(m)
        rows.append((i * 3, m, (mass / mass.sum()).tolist(), rng.normal(size=m * 2).tolist()))
    return spark.createDataFrame(rows, PACKED).repartition(3)


def of(df):
    return {(r.i, r.j): r.cost for r in df.collect()}


def test_a_broken_off_run_continues(spark, tmp_path, monkeypatch):
    """The third share fails; the next run computes that one and the ones after it, and no other."""
    packed, path = packed_of(spark), f"file://{tmp_path}/costs"
    want, computed, real = of(transport.pair_costs(packed, **KERNEL)), [], restart._write_share

    def counting(costs, where, share):
        computed.append(share)
        if share == 2 and len(computed) == 3:
            costs.limit(1).withColumn("share", F.lit(share)).write.mode("append").partitionBy("share").parquet(f"{where}/costs")  # what a crash leaves
            raise OSError("lost")
        return real(costs, where, share)

    monkeypatch.setattr(restart, "_write_share", counting)
    with pytest.raises(OSError, match="lost"):
        restart.stored_costs(packed, path, shares=5, **KERNEL)
    assert set(restart.finished_shares(spark, path)) == {0, 1}
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "costs" / "costs").rglob("share=[01]/*.parquet")}
    assert of(restart.stored_costs(packed.repartition(2), path, shares=5, **KERNEL)) == want
    assert computed == [0, 1, 2, 2, 3, 4] and sum(restart.finished_shares(spark, path).values()) == len(want) == 23 * 22 // 2
    assert files and all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert of(restart.stored_costs(packed, path, shares=5, **KERNEL)) == want and len(computed) == 6


def test_a_folder_of_other_costs_is_refused(spark, tmp_path):
    packed, path = packed_of(spark, 6), f"file://{tmp_path}/costs"
    restart.stored_costs(packed, path, shares=2, **KERNEL)
    for other, options in ((packed_of(spark, 6, seed=4), {}), (packed, {"epsilon": 0.4}), (packed, {"shares": 3})):
        with pytest.raises(ValueError, match="holds costs"):
            restart.stored_costs(other, path, **({"shares": 2} | KERNEL | options))
    assert restart.stored_costs(packed.limit(0), f"file://{tmp_path}/none", shares=2, **KERNEL).collect() == []


def test_exact_distances_by_shares_equal_those_at_once(spark, tmp_path):
    packed = packed_of(spark, 12)
    vectors = packed.select("row_idx", F.slice("tokens", 1, 2).alias("z"))
    config = NicheConfig(sweeps=6, anchor_weight=0.2, block=4)
    at_once, by_shares = (of(runs.exact_distance(packed, vectors, config, store)) for store in (None, f"file://{tmp_path}/d"))
    assert at_once == by_shares and len(at_once) == 66


def test_stored_self_costs_give_the_same_and_stale_ones_are_refused(spark, tmp_path):
    new, reference, path = packed_of(spark, 9), packed_of(spark, 4, seed=5), f"file://{tmp_path}/model"
    bundle.save_self_costs(path, reference, 0.3, 8)
    own = bundle.load_self_costs(spark, path, reference, 0.3, 8)
    kernel = {"epsilon": 0.3, "sweeps": 8}
    assert of(transport.distances(new, reference, "debiased", other_own=own, **kernel)) == of(transport.distances(new, reference, "debiased", **kernel))
    for stale in ((packed_of(spark, 4, seed=6), 0.3, 8), (reference, 0.2, 8), (reference, 0.3, 9)):
        with pytest.raises(ValueError, match="self costs"):
            bundle.load_self_costs(spark, path, *stale)
    assert bundle.load_self_costs(spark, f"{path}-none", reference, 0.3, 8) is None
    for bad in (own.limit(2), own.withColumn("self_cost", F.lit(-1.0)), own.withColumn("self_cost", F.lit(float("nan")))):
        with pytest.raises(ValueError, match="self costs"):
            transport.distances(new, reference, "debiased", other_own=bad, **kernel)


def blobs(spark, n=400):
    """Two samples of eight blobs of very different sizes, so that a plain draw misses the small ones."""
    rng = np.random.default_rng(8)
    share = np.array([0.6, 0.2, 0.08, 0.04, 0.03, 0.02, 0.02, 0.01])
    rows = []
    for s in range(2):
        centre = rng.normal(0, 20, (8, 3))
        for i, k in enumerate(rng.choice(8, n, p=share)):
            rows.append((s * n + i, "ab"[s], (centre[k] + rng.normal(0, 0.5, 3)).tolist()))
    full = spark.createDataFrame(rows, "row_idx long, sample_id string, z array<double>").repartition(3)
    return full.select("row_idx", "sample_id"), full.select("row_idx", "z"), rows


def test_seeded_landmarks_cost_less_than_drawn_ones(spark):
    cells, vectors, rows = blobs(spark)
    z, sample = {i: np.array(v) for i, _, v in rows}, {i: s for i, s, _ in rows}

    def cost(chosen):
        ids = [r.row_idx for r in chosen.collect()]
        assert len(ids) == len(set(ids)) == 16 and sum(sample[i] == "a" for i in ids) == 8
        return sum(min(((z[i] - z[j]) ** 2).sum() for j in ids if sample[j] == s) for i, s in sample.items())

    seeded = assignment.kmeans_landmarks(cells, vectors, 16)
    assert cost(seeded) < 0.5 * cost(assignment.sample_landmarks(cells, 16))
    assert cost(seeded) <= cost(assignment.kmeans_landmarks(cells, vectors, 16, starts=1))
    again = assignment.kmeans_landmarks(cells.repartition(5), vectors.repartition(2), 16)
    assert {r.row_idx for r in again.collect()} == {r.row_idx for r in seeded.collect()}


def test_supports_without_mass_are_uniform(spark):
    cells = spark.createDataFrame([(i, "a", 0.0, 0.0) for i in range(4)], "row_idx long, sample_id string, x double, y double")
    edges = spark.createDataFrame([(0, 1, 1.0, 0.0), (0, 2, 1.0, 0.0), (1, 0, 1.0, float("nan")), (1, 2, 1.0, 1.0), (2, 0, 1.0, 1.0), (2, 1, 1.0, 3.0), (3, 0, 1.0, float("inf"))], "row_idx long, neighbor long, distance double, weight double")
    mass = lambda **o: {(r.row_idx, r.neighbor): r.mass for r in measures.assemble(cells, edges, include_anchor=False, **o).collect()}
    assert mass(uniform_fallback=True) == {(0, 1): 0.5, (0, 2): 0.5, (1, 0): 0.5, (1, 2): 0.5, (2, 0): 0.25, (2, 1): 0.75, (3, 0): 1.0}
    assert mass()[0, 1] == 0.0
