import json

import numpy as np
import pytest
from nichewright import cli
from nichewright.config import NicheConfig
from nichewright.operators import transport
from nichewright.plans import runs
from nichewright.sources import bundle
from pyspark.sql import functions as F

CONFIG = NicheConfig(radius=2.5, max_neighbors=4, sweeps=10, candidates=(2, 3), scales="dimension", knn=2, isolated="anchor_fallback")


def cohort(spark, n=8):
    """Two samples, each with two kinds of cells that lie apart."""
    rng = np.random.default_rng(42)
    rows = [(s * 2 * n + k * n + i, "AB"[s], float(i + 100 * k), 0.0, (np.eye(5)[k] * 4 + rng.normal(0, 0.2, 5)).tolist()) for s in range(2) for k in range(2) for i in range(n)]
    full = spark.createDataFrame(rows, "row_idx long, sample_id string, x double, y double, z array<double>").repartition(3)
    return full.drop("z"), full.select("row_idx", "z")


def kinds(rows, n=8):
    return [{r.niche for r in rows if r.row_idx // n % 2 == k} for k in range(2)]


@pytest.mark.parametrize("changes", [{}, {"distance": "fgw", "fgw_rounds": 2, "structure": "knn_shortest_path"}, {"method": "kmedoids", "anchor_weight": 0.1}, {"method": "leiden", "knn": 6}])
def test_fit_tells_the_kinds_apart(spark, changes):
    run = runs.fit(*cohort(spark), NicheConfig(**{**CONFIG.to_dict(), **changes}))
    rows = run.tables["labels"].collect()
    a, b = kinds(rows)
    assert len(rows) == 32 and not a & b
    cells = run.tables["cells"].collect()
    assert all(r.ot_niche == f"ON{r.ot_niche_int}" and r.n_neighbors_retained_r2p5 <= 4 for r in cells)
    assert len({r.ot_niche_instance_int for r in cells}) == len({(r.sample_id, r.ot_niche_instance) for r in cells}) >= 4


def test_fit_refuses_what_is_too_large(spark):
    with pytest.raises(ValueError, match="exact run"):
        runs.fit(*cohort(spark), NicheConfig(**{**CONFIG.to_dict(), "max_exact_cells": 5}))


def test_landmarks_and_rough_clusters_agree_with_the_kinds(spark):
    cells, vectors = cohort(spark)
    for run in (runs.fit_by_landmarks(cells, vectors, CONFIG, 12, 6), runs.fit_rough_then_fine(cells, vectors, CONFIG, 3)):
        rows = run.tables["cells"].collect()
        a, b = kinds(rows)
        assert len(rows) == 32 and not a & b


@pytest.mark.parametrize("changes", [{}, {"distance": "fgw", "fgw_rounds": 2, "structure": "knn_shortest_path"}])
def test_candidate_costs_equal_all_pairs(spark, changes):
    """However the reference travels, the costs are those that all pairs give; unknown ids give nothing."""
    config = NicheConfig(**{**CONFIG.to_dict(), **changes})
    packed = runs.local_measures(*cohort(spark), config)[0]
    reference = packed.where("row_idx % 3 = 0")
    fgw = config.distance == "fgw"
    found = transport.pair_costs(packed, reference, "fgw" if fgw else "sinkhorn", config.epsilon, config.sweeps, config.fgw_alpha, config.fgw_rounds)
    every = {(r.i, r.j): r.cost for r in found.collect()}
    wanted = [(i, j) for i in range(32) for j in range(0, 32, 3) if (i + j) % 4] + [(5, 500), (500, 3), (4, 9), (4, 9)]
    candidates = spark.createDataFrame(wanted, "i long, j long")
    expected = sorted((i, j) for i, j in wanted if (i, j) in every)
    for most in (0, 8_000_000):
        got = runs.candidate_costs(packed, reference, candidates, config, most).collect()
        assert sorted((r.i, r.j) for r in got) == expected
        assert all(r.cost == pytest.approx(every[r.i, r.j], rel=1e-9, abs=1e-12) for r in got)
        assert runs.candidate_costs(packed, reference.limit(0), candidates, config, most).collect() == []


def test_bundle_round_trip_and_cache(spark, tmp_path):
    cells, vectors = cohort(spark)
    path = f"file://{tmp_path}/bundle"
    bundle.write_bundle({"cells": cells, "features": vectors}, path)
    bundle.write_table(spark.read.parquet(f"{path}/cells").where("row_idx < 5"), f"{path}/cells")
    assert bundle.read_bundle(spark, path, ("cells",))["cells"].count() == 5
    with pytest.raises(KeyError):
        bundle.read_bundle(spark, path, ("none",))
    with pytest.raises(KeyError):
        bundle.read_bundle(spark, path, ("cells",), {"cells": ("none",)})
    made = []
    make = lambda: made.append(1) or spark.range(3)
    reused = [bundle.cached(spark, f"{path}/c", request, make)[1] for request in ({"k": 1}, {"k": 1}, {"k": 2})]
    assert reused == [False, True, False] and len(made) == 2
    bundle.write_json(spark, f"{path}/s.json", {"b": np.float64("nan"), "a": (np.int64(3), np.arange(2)), "c": CONFIG})
    assert bundle.read_json(spark, f"{path}/s.json")["a"] == [3, [0, 1]] and bundle.read_json(spark, f"{path}/s.json")["b"] is None
    assert bundle.distance_store(5000) == "inline" and bundle.distance_store(5001) == "parquet"


def test_command_line(spark, tmp_path, capsys):
    cells, vectors = cohort(spark)
    bundle.write_bundle({"cells": cells, "features": vectors}, f"file://{tmp_path}/in")
    for command, more in (("fit", []), ("landmark", ["--landmarks", "12", "--landmark-candidates", "5"]), ("rough-fine", ["--rough-clusters", "3"])):
        out = f"file://{tmp_path}/{command}"
        assert cli.main([command, "--input", f"file://{tmp_path}/in", "--output", out, "--radius", "2.5", "--max-neighbors", "4", "--sweeps", "5", "--candidates", "2:3", "--scales", "none", "--knn", "2", "--dimensions", "3", *more], spark) == 0
        assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["config"]["candidates"] == [2, 3]
        assert spark.read.parquet(f"{out}/cells").count() == 32
    labels, medoids = bundle.load_reference(spark, f"file://{tmp_path}/fit/model")
    assert labels.count() == 32 and medoids.count() in (2, 3)


def test_pool_prepare_and_distribute(spark, tmp_path, capsys):
    for s in "ab":
        spark.createDataFrame([(f"{s}{i}", float(i), 0.0) for i in range(3)], "cell_id string, x double, y double").coalesce(1).toPandas().to_parquet(tmp_path / f"run_{s}_done.parquet")
    base = f"file://{tmp_path}"
    assert cli.main(["pool-inputs", "--input", base, "--output", f"{base}/pooled", "--glob", "run_*.parquet", "--prefix", "run_", "--suffix", "_done", "--case", "upper"], spark) == 0
    pooled = spark.read.parquet(f"{base}/pooled/cells")
    assert {r.sample_id for r in pooled.collect()} == {"A", "B"}
    with pytest.raises(FileNotFoundError):
        cli.main(["pool-inputs", "--input", base, "--output", f"{base}/none", "--glob", "x_*.parquet"], spark)
    counts = spark.createDataFrame([(i, g, float((i * 7 + len(g)) % 5)) for i in range(6) for g in ("g", "gg", "ggg", "gggg")], "row_idx long, gene string, value double")
    bundle.write_bundle({"counts": counts, "cells": spark.range(6).select(F.col("id").alias("row_idx"), F.lit("f").alias("source_file"))}, f"{base}/b")
    for reused in (False, True):
        cli.main(["prepare-inputs", "--input", f"{base}/b", "--output", f"{base}/b"], spark)
        assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"rows": 6, "reused": reused}
    assert cli.main(["distribute-prepared-inputs", "--input", f"{base}/b", "--prepared", f"{base}/b/features", "--output", f"{base}/back"], spark) == 0
