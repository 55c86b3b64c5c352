"""Option names and defaults, selection by resolution and metric, saved models, and distribution by cell names."""

import json

import numpy as np
import pytest
from nichewright import cli
from nichewright.config import OPTION_NAMES, NicheConfig, metric_names
from nichewright.operators import clustering, metrics, pooling
from nichewright.plans import runs
from nichewright.sources import bundle
from pyspark.sql import functions as F

from tests.test_operators import ids, relation
from tests.test_runs import cohort, kinds


def test_names_and_defaults():
    plain = NicheConfig()
    assert (plain.radial_shells, plain.fgw_alpha, plain.knn, plain.scale_pairs, plain.dimensions, plain.instance_max_neighbors) == (3, 0.25, 30, 10_000, 32, 512)
    for name in ("complete_euclidean", "local_knn_shortest_path", "radius_graph_shortest_path", "binary_edge_distance", "adjacency"):
        NicheConfig(structure=name)
    for name in ("sinkhorn", "debiased_entropic_transport", "sinkhorn_divergence", "fused_gromov_wasserstein"):
        NicheConfig(distance=name)
    for name in ("agglomerative", "kmedoids", "pam", "leiden_ot_knn"):
        NicheConfig(method=name)
    made = NicheConfig.of(radius_um=3.0, spatial_weight=0.5, candidate_n_clusters=[2, 3], ot_knn=4)
    assert (made.radius, made.weights, made.candidates, made.knn) == (3.0, (1.0, 0.5, 0.1), (2, 3), 4)
    assert NicheConfig.of(**json.loads(json.dumps(made.to_dict()))) == made
    assert set(OPTION_NAMES.values()) <= set(plain.to_dict())
    with pytest.raises(ValueError, match="two names"):
        NicheConfig.of(radius=1.0, radius_um=2.0)
    for bad in ({"method": "other"}, {"cap_mode": "other"}, {"model_selection_metrics": ("other",)}, {"instance_radius": 0.0}, {"candidate_resolutions": (0.0,)}):
        with pytest.raises(ValueError):
            NicheConfig(**bad)


def test_metric_names():
    assert metric_names(()) == ("silhouette", "calinski_harabasz", "davies_bouldin", "percentile_dunn")
    assert metric_names(("pseudo_ch", "medoid_db", "percentile_dunn_05_95", "Minimum-Dunn", "dunn")) == ("calinski_harabasz", "davies_bouldin", "percentile_dunn", "minimum_dunn")


def groups(sizes, seed=3):
    """Distances of points on a line, in groups that lie 20 apart."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([20 * g + rng.random(n) for g, n in enumerate(sizes)])
    return np.abs(np.subtract.outer(x, x))


def test_selection_by_metric_and_resolution(spark):
    d = groups((5, 5, 5))
    table, _ = clustering.select_model(relation(spark, d), ids(spark, 15), (2, 3, 4), names=("minimum_dunn",))
    assert table.where("best").first()["k"] == 3 and "rank_minimum_dunn" in table.columns and "rank_silhouette" not in table.columns
    table, labels = clustering.select_resolution(relation(spark, d), ids(spark, 15), (1.0, 0.5, 1.0, -1.0), k=4)
    assert sorted(r.resolution for r in table.collect()) == [0.5, 1.0]
    of = [r.niche for r in labels.orderBy("row_idx").collect()]
    assert [len(set(of[i : i + 5])) for i in (0, 5, 10)] == [1, 1, 1] and len(set(of)) == 3
    with pytest.raises(ValueError, match="positive"):
        clustering.select_resolution(relation(spark, d), ids(spark, 15), (0.0,))
    assert clustering.community_labels(relation(spark, d).limit(0), ids(spark, 0)).count() == 0


def test_within_between_leaves_out_zeros_between(spark):
    d = np.array([[0, 1, 0, 4], [1, 0, 6, 2], [0, 6, 0, 3], [4, 2, 3, 0]], float)
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "row_idx long, niche int")
    ratio = metrics.within_between(metrics.labelled(relation(spark, d), labels)).first()["ratio"]
    assert ratio == pytest.approx(((1 + 3) / 2) / ((4 + 6 + 2) / 3))
    one = metrics.within_between(metrics.labelled(relation(spark, d), labels.withColumn("niche", F.lit(0)))).first()["ratio"]
    assert one is None


def test_feasibility_and_empty_cohorts(spark):
    config = NicheConfig(max_exact_cells=10)
    assert runs.feasibility(10, config)["status"] == "admitted" and runs.feasibility(11, config)["status"] == "refused"
    assert runs.feasibility(11, NicheConfig(max_exact_cells=10, force=True), 66.0)["days"] == pytest.approx(1 / 86400)
    cells, vectors = cohort(spark)
    with pytest.raises(ValueError, match="no vectors"):
        runs.fit(cells.limit(0), vectors.limit(0), config)


def test_genes_must_agree(spark):
    rows = spark.createDataFrame([(s, i, g) for s in "ab" for i, g in enumerate("xyz")], "sample_id string, gene_idx int, gene string")
    assert [r.gene for r in pooling.check_genes(rows).orderBy("gene_idx").collect()] == ["x", "y", "z"]
    swapped = rows.withColumn("gene", F.when(F.expr("sample_id = 'b' AND gene = 'x'"), "w").otherwise(F.col("gene")))
    for bad in (swapped, rows.where("NOT (sample_id = 'b' AND gene = 'z')"), rows.unionByName(rows.limit(1))):
        with pytest.raises(ValueError, match="genes differ"):
            pooling.check_genes(bad)
    assert pooling.check_genes(rows.limit(0)).count() == 0


def test_features_go_back_by_cell_name(spark):
    pooled = spark.createDataFrame([(0, "f", "A:c1"), (1, "f", "A:c:2"), (2, "g", "B:c1")], "row_idx long, source_file string, pooled_id string")
    prepared = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "row_idx long, z array<double>")
    sources = spark.createDataFrame([("f", "c:2", 5), ("f", "c1", 6), ("g", "c1", 7)], "source_file string, cell_id string, row_idx int")
    got = pooling.distribute_to_sources(prepared, pooled, sources)
    assert {(r.source_file, r.cell_id, r.row_idx): r.z for r in got.collect()} == {("f", "c:2", 5): [2.0], ("f", "c1", 6): [1.0], ("g", "c1", 7): [3.0]}
    with pytest.raises(KeyError, match="no pooled rows"):
        pooling.distribute_to_sources(prepared, pooled.where("source_file = 'f'"), sources)
    for bad in (sources.withColumn("cell_id", F.lit("c1")), sources.withColumn("cell_id", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="one to one"):
            pooling.distribute_to_sources(prepared, pooled, bad)
    with pytest.raises(KeyError, match="neither"):
        pooling.distribute_to_sources(prepared, pooled.drop("pooled_id"), sources)


def test_fit_saves_a_model_that_assigns(spark, tmp_path, capsys):
    cells, vectors = cohort(spark)
    base = f"file://{tmp_path}"
    bundle.write_bundle({"cells": cells, "features": vectors}, f"{base}/in")
    options = ["--radius-um", "2.5", "--max-neighbors", "4", "--sinkhorn-iters", "5", "--candidate-n-clusters", "2:3", "--ground-cost-normalization", "dimension", "--ot-knn", "2", "--embedding-dim", "3", "--model-selection-metrics", "silhouette,minimum_dunn"]
    assert cli.main(["fit", "--input", f"{base}/in", "--output", f"{base}/out", *options], spark) == 0
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert summary["convergence"]["pairs"] > 0 and summary["features"]["warning"] and bundle.read_json(spark, f"{base}/out/feasibility.json")["status"] == "admitted"
    assert cli.main(["assign", "--model", f"{base}/out", "--input", f"{base}/in", "--output", f"{base}/new"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"cells": 32, "unknown": 0}
    own = {r.row_idx: r.niche for r in spark.read.parquet(f"{base}/out/labels").collect()}
    rows = spark.read.parquet(f"{base}/new/cells").collect()
    a, b = kinds(rows)
    assert not a & b and np.mean([own[r.row_idx] == r.niche for r in rows]) > 0.9
    assert cli.main(["fit", "--input", f"{base}/in", "--output", f"{base}/few", *options, "--max-cells", "9", "--max-exact-cells", "8"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["status"] == "refused" and not bundle.exists(spark, f"{base}/few/cells")
