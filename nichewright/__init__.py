"""Spark-native niche analytics over tables of cells with coordinates and feature vectors."""

from nichewright.config import NicheConfig
from nichewright.operators.assignment import assign_by_medoids, kmeans_landmarks, rough_clusters, sample_landmarks
from nichewright.operators.clustering import agglomerate, community_labels, kmedoids, select_model, select_resolution
from nichewright.operators.features import EmbeddingState, fit_embedding, library_size_log1p
from nichewright.operators.graphs import instances, knn_affinity, knn_distance_graph
from nichewright.operators.measures import assemble, cap_neighbors, component_scales, tokens
from nichewright.operators.metrics import assignment_score, medoids, scores
from nichewright.operators.neighbors import radius_edges
from nichewright.operators.plots import niche_grid
from nichewright.operators.pooling import distribute_to_sources, pool, tile_layout
from nichewright.operators.transport import distances, pair_costs
from nichewright.plans.runs import Run, assign, feasibility, fit, fit_by_landmarks, fit_rough_then_fine

__version__ = "0.2.0"

__all__ = [n for n, v in globals().items() if not n.startswith("_") and getattr(v, "__module__", "").startswith("nichewright.")]
