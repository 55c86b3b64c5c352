"""Empty tables give empty results, whose columns stay, and nulls take no part."""

import pytest
from nichewright.config import NicheConfig
from nichewright.operators import assignment, clustering, components, features, graphs, measures, metrics, neighbors, plots, pooling, structures, transport
from nichewright.plans import runs
from pyspark.sql import functions as F

CELLS = "row_idx long, sample_id string, x double, y double"
RELATION = "i long, j long, cost double"
EDGES = "row_idx long, neighbor long, distance double, weight double, state int"
LABELS = "row_idx long, niche int"
PACKED = "row_idx long, m int, masses array<double>, tokens array<double>, structure array<double>"
VECTORS = "row_idx long, z array<double>"
SUPPORT = "row_idx long, neighbor long, distance double, weight double, mass double"
TOKENS = f"{SUPPORT}, z array<double>, rx double, ry double, rr double"

EMPTY = {
    "radius_edges": lambda t: neighbors.radius_edges(t(CELLS), 3.0),
    "nearest_within": lambda t: neighbors.nearest_within(t(EDGES), 3),
    "neighbor_counts": lambda t: neighbors.neighbor_counts(t(CELLS), t(EDGES)),
    "cap_neighbors": lambda t: measures.cap_neighbors(t(EDGES), 3.0, 2),
    "assemble": lambda t: measures.assemble(t(CELLS), t(EDGES)),
    "state_labels": lambda t: measures.state_labels(t(VECTORS), 4),
    "library_size_log1p": lambda t: features.library_size_log1p(t("row_idx long, value double")),
    "column_stats": lambda t: features.column_stats(t(VECTORS)),
    "sparse_rows": lambda t: features.sparse_rows(t("row_idx long, gene string, normalised double"), ["a"]),
    "tile_layout": lambda t: pooling.tile_layout(pooling.sample_summary(t(CELLS))),
    "pair_costs": lambda t: transport.pair_costs(t(PACKED)),
    "cross_costs": lambda t: transport.pair_costs(t(PACKED), t(PACKED), "fgw"),
    "self_costs": lambda t: transport.self_costs(t(PACKED), 0.05, 5),
    "distances": lambda t: transport.distances(t(PACKED)),
    "mirrored": lambda t: transport.mirrored(t(RELATION)),
    "squared_euclidean": lambda t: transport.squared_euclidean(t(VECTORS)),
    "packed_structures": lambda t: structures.packed_structures(t("row_idx long, m int, masses array<double>, tokens array<double>, rel array<double>"), "knn_shortest_path"),
    "knn": lambda t: graphs.knn(t(RELATION), 3),
    "knn_distance_graph": lambda t: graphs.knn_distance_graph(t(RELATION), 3),
    "knn_affinity": lambda t: graphs.knn_affinity(t(RELATION), 3),
    "instances": lambda t: graphs.instances(t(LABELS), t(EDGES)),
    "connected_components": lambda t: components.connected_components(t("a long, b long")),
    "assignment_score": lambda t: metrics.assignment_score(t(RELATION), t(LABELS)),
    "medoids": lambda t: metrics.medoids(t(RELATION), t(LABELS)),
    "agglomerate": lambda t: clustering.agglomerate(t(RELATION), t(LABELS).select("row_idx"), (2, 3)),
    "community_labels": lambda t: clustering.community_labels(t(RELATION), t(LABELS).select("row_idx")),
    "assign_by_medoids": lambda t: assignment.assign_by_medoids(t(RELATION), t("medoid long, niche int")),
    "landmark_margin": lambda t: assignment.landmark_margin(t(RELATION)),
    "landmark_candidates": lambda t: assignment.landmark_candidates(t(VECTORS), t(VECTORS), 3),
    "tokens": lambda t: measures.tokens(t(SUPPORT), t(CELLS), t(VECTORS), 3.0),
    "scaled_tokens": lambda t: measures.scaled_tokens(t(TOKENS), (1.0, 1.0, 1.0), (1.0, 1.0, 1.0)),
    "packed": lambda t: measures.packed(t("row_idx long, neighbor long, mass double, rx double, ry double, token array<double>")),
    "kmedoids": lambda t: clustering.kmedoids(t(RELATION), t(LABELS).select("row_idx"), 3)[0],
    "average_merges": lambda t: clustering.average_merges(t(RELATION), t(LABELS).select("row_idx")),
    "community_edges": lambda t: clustering.community_edges(t("i long, j long, affinity double"), t(LABELS).select("row_idx")),
    "distribute": lambda t: pooling.distribute(t("k long, f double"), t("k long"), ("k",)),
    "tagged": lambda t: pooling.tagged(t("cell_id string, x double, y double"), F.lit("s")),
    "planned": lambda t: transport.planned(t("sample_id string, n long, support long"), 5, 2),
    "niche_grid": lambda t: plots.niche_grid(t("sample_id string, x double, y double, niche int"), 1.0, 2),
    "sparse_column_stats": lambda t: features.sparse_column_stats(t("gene string, normalised double"), 0),
    "propagate": lambda t: assignment.propagate(t("row_idx long, representative long"), t(LABELS)),
}


@pytest.mark.parametrize("name", EMPTY)
def test_an_empty_table_gives_an_empty_result(spark, name):
    found = EMPTY[name](lambda schema: spark.createDataFrame([], schema))
    assert found.columns and found.collect() == []


def test_columns_of_any_name_stay(spark):
    rows = [(0, j, float(j), 1.0, f"n{j}", j) for j in range(1, 6)] + [(9, 1, 1.0, 1.0, "few", 1)]
    edges = spark.createDataFrame(rows, "row_idx long, neighbor long, distance double, weight double, _n string, _key int")
    got = measures.cap_neighbors(edges, 6.0, 2).collect()
    assert len(got) == 3 and all(tuple(r) in set(rows) for r in got)
    layout = pooling.tile_layout(spark.createDataFrame([("a", 1, 0.0, 1.0, 0.0, 1.0, "kept")], "sample_id string, n_cells long, min_x double, max_x double, min_y double, max_y double, _at string"))
    assert layout.first()["_at"] == "kept"


def test_null_vectors_take_no_part(spark):
    rows = spark.createDataFrame([(0, [0.0, 1.0]), (1, None), (2, [3.0, 1.0])], VECTORS)
    assert {(r.i, r.j) for r in assignment.landmark_candidates(rows, rows.dropna(), 1).collect()} == {(0, 0), (2, 2)}
    assert {(r.i, r.j) for r in transport.squared_euclidean(rows).collect()} == {(0, 2)}
    assert {r.row_idx for r in measures.state_labels(rows, 2).collect()} == {0, 2}
    assert features.column_stats(rows).where(F.col("mean").isNull()).count() == 0


def test_scales_and_medoids_of_nothing(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert tuple(measures.sampled_scales(none(TOKENS), 10, 1).first()) == (1.0, 1.0, 1.0)
    assert structures.structure_scale(none("row_idx long, m int, structure array<double>"), 10).first()["scale"] == 1.0
    assert clustering.farthest_first(none(RELATION), none("row_idx long"), 3) == []
    for plan in (runs.fit, runs.fit_by_landmarks, runs.fit_rough_then_fine):
        with pytest.raises(ValueError, match="no vectors"):
            plan(none(CELLS), none(VECTORS), NicheConfig())
