"""The table of niches by tiles, and the command that takes vectors from elsewhere."""

import json
from collections import Counter

import nichewright
import numpy as np
import pytest
from nichewright import cli
from nichewright.operators import plots
from pyspark.sql import functions as F

CELLS = "row_idx long, sample_id string, x double, y double, niche int, tx string"


def test_levels_sum_the_finer_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2] if i % 7 else None, float(x), float(y), int(i % 3) if i % 5 else None, "clash") for i, (x, y) in enumerate(rng.uniform(-40, 40, (300, 2)))]
    odd = [(900, "a", None, 1.0, 0, ""), (901, "a", float("nan"), 1.0, 0, ""), (902, "a", float("inf"), 1.0, 0, "")]
    found = plots.niche_grid(spark.createDataFrame(rows + odd, CELLS), 2.5, 4).collect()
    want = Counter((n, s, int(x // (2.5 * 2**n)), int(y // (2.5 * 2**n)), k) for n in range(4) for _, s, x, y, k, _ in rows)
    assert {tuple(r)[:5]: r.cells for r in found} == want
    share = {(r.level, r.sample_id, r.tx, r.ty): (r.niche, r.share) for r in plots.commonest(spark.createDataFrame([(0, "a", 0, 0, 2, 3), (0, "a", 0, 0, 1, 3), (0, "a", 0, 1, 4, 1)], "level int, sample_id string, tx long, ty long, niche int, cells long")).collect()}
    assert share == {(0, "a", 0, 0): (1, 0.5), (0, "a", 0, 1): (4, 1.0)}


def test_empty_and_wrong(spark):
    cells = spark.createDataFrame([], CELLS)
    assert plots.niche_grid(cells, 1.0, 2).collect() == []
    for bad in ((0.0, 2), (1.0, 0)):
        with pytest.raises(ValueError, match="positive"):
            plots.niche_grid(cells, *bad)


def test_vectors_from_elsewhere(spark, tmp_path, capsys):
    base = f"file://{tmp_path}"
    spark.createDataFrame([(0, "f", "a"), (1, "f", "b")], "row_idx long, source_file string, cell_id string").write.parquet(f"{base}/in/cells")
    outer = spark.createDataFrame([("f", "b", [1.0, 2.0]), ("f", "a", [3.0, 4.0])], "source_file string, cell_id string, z array<double>")
    outer.write.parquet(f"{base}/outer")
    call = ["align-external", "--input", f"{base}/in", "--external", f"{base}/outer", "--output", f"{base}/out"]
    assert cli.main([*call, "--dimensions", "2"], spark) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"rows": 2}
    assert {r.row_idx: r.z for r in spark.read.parquet(f"{base}/out/features").collect()} == {0: [3.0, 4.0], 1: [1.0, 2.0]}
    with pytest.raises(ValueError, match="dimensions"):
        cli.main([*call, "--dimensions", "3"], spark)


def test_pooling_tags_cells_and_refuses_repeats(spark, tmp_path):
    base = f"file://{tmp_path}"
    for name, ids in (("s_a", "xyz"), ("s_b", "xy")):
        spark.createDataFrame([(c, float(i), 1.0) for i, c in enumerate(ids)], "cell_id string, x double, y double").toPandas().to_parquet(tmp_path / f"{name}.parquet")
    assert cli.main(["pool-inputs", "--input", base, "--output", f"{base}/out", "--glob", "s_*.parquet", "--prefix", "s_"], spark) == 0
    rows = spark.read.parquet(f"{base}/out/cells").collect()
    assert {r.pooled_id for r in rows} == {"a:x", "a:y", "a:z", "b:x", "b:y"} and {(r.x, r.y) for r in rows} == {(r.original_x, r.original_y) for r in rows}
    spark.createDataFrame([("x", 0.0, 0.0)] * 2, "cell_id string, x double, y double").toPandas().to_parquet(tmp_path / "s_c.parquet")
    with pytest.raises(ValueError, match="c:x"):
        cli.main(["pool-inputs", "--input", base, "--output", f"{base}/none", "--glob", "s_*.parquet", "--prefix", "s_"], spark)
    spark.range(2).select(F.lit(1.0).alias("x")).toPandas().to_parquet(tmp_path / "t_d.parquet")
    with pytest.raises(KeyError, match="lack"):
        cli.main(["pool-inputs", "--input", base, "--output", f"{base}/none", "--glob", "t_*.parquet"], spark)


def test_exports():
    assert {"fit", "assign", "fit_by_landmarks", "NicheConfig", "pool", "distances", "niche_grid"} <= set(nichewright.__all__) and len(nichewright.__all__) >= 28
