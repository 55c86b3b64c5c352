"""Settings of a niche run, checked when they are made, and the grammar of list options."""

from __future__ import annotations

from dataclasses import asdict, dataclass

KERNELS = {"uniform": "uniform", "binary": "uniform", "none": "uniform", "inverse": "inverse", "inverse_distance": "inverse", "gaussian": "gaussian", "rbf": "gaussian"}
STRUCTURES = {"complete_euclidean": "complete", "complete": "complete"} | dict.fromkeys(("local_knn_shortest_path", "knn_shortest_path"), "knn") | dict.fromkeys(("radius_graph_shortest_path", "radius_shortest_path"), "radius") | dict.fromkeys(("binary_edge_distance", "binary_edge", "adjacency"), "binary")
DISTANCES = {"sinkhorn": "sinkhorn", "fgw": "fgw", "fused_gromov_wasserstein": "fgw"} | dict.fromkeys(("sinkhorn_divergence", "debiased", "debiased_sinkhorn", "debiased_entropic_transport"), "debiased")
METHODS = {"agglomerative": "agglomerative", "kmedoids": "kmedoids", "pam": "kmedoids", "leiden": "leiden", "leiden_ot_knn": "leiden"}
#: Scores of model selection, by name, each better the larger it is; the first four are the default.
METRICS = ("silhouette", "calinski_harabasz", "davies_bouldin", "percentile_dunn", "minimum_dunn")
METRIC_NAMES = {m: m for m in METRICS} | dict.fromkeys(("pseudo_calinski_harabasz", "pseudo_ch", "ch"), "calinski_harabasz") | dict.fromkeys(("medoid_davies_bouldin", "medoid_db", "db"), "davies_bouldin") | dict.fromkeys(("percentile_dunn_05_95", "dunn"), "percentile_dunn")
ISOLATED = ("anchor_fallback", "zero_dummy", "error")
SCALES = ("none", "dimension", "sampled_median")


def canonical(name: str, of: dict[str, str], what: str) -> str:
    """The name an alias stands for; case and hyphens don't matter."""
    found = of.get(name.strip().lower().replace("-", "_"))
    if found is None:
        raise ValueError(f"unknown {what} {name!r}; known: {', '.join(sorted(of))}")
    return found


def metric_names(names: tuple[str, ...]) -> tuple[str, ...]:
    """Canonical, distinct metric names in their order, the default ones for none; an unknown one raises ValueError."""
    return tuple(dict.fromkeys(canonical(n, METRIC_NAMES, "metric") for n in names)) or METRICS[:4]


#: Longer names of options, as they are common in stored settings; ``NicheConfig.of`` and the command line take both.  Fixed values.
OPTION_NAMES = {
    "radius_um": "radius",
    "graph_kernel": "kernel",
    "cap_state_clusters": "n_states",
    "isolated_policy": "isolated",
    "ground_cost_normalization": "scales",
    "ground_cost_sample_pairs": "scale_pairs",
    "sinkhorn_epsilon": "epsilon",
    "sinkhorn_iters": "sweeps",
    "distance_mode": "distance",
    "fgw_iters": "fgw_rounds",
    "fgw_node_feature_mode": "fgw_features",
    "fgw_structure_mode": "structure",
    "fgw_structure_knn": "structure_knn",
    "fgw_structure_radius_fraction": "structure_radius_fraction",
    "fgw_structure_normalization": "fgw_structure_scale",
    "fgw_structure_sample_pairs": "structure_pairs",
    "block_size": "block",
    "max_ot_work_units": "max_ot_work",
    "max_fgw_work_units": "max_fgw_work",
    "force_large_exact_ot": "force",
    "cluster_method": "method",
    "candidate_n_clusters": "candidates",
    "ot_knn": "knn",
    "ot_affinity_scaling": "affinity",
    "instance_radius_um": "instance_radius",
    "embedding_method": "embedding",
    "embedding_dim": "dimensions",
}


@dataclass(frozen=True)
class NicheConfig:
    """Everything a run needs; unknown names and numbers out of range raise ValueError here, before any Spark job."""

    radius: float = 50.0
    max_neighbors: int = 32
    include_anchor: bool = True
    kernel: str = "gaussian"
    cap_mode: str = "radial_shell_state"
    radial_shells: int = 3
    n_states: int = 16
    isolated: str = "anchor_fallback"
    structure: str = "local_knn_shortest_path"
    structure_knn: int = 6
    structure_radius_fraction: float = 0.5
    scales: str = "sampled_median"
    scale_pairs: int = 10_000
    weights: tuple[float, float, float] = (1.0, 0.25, 0.1)
    distance: str = "debiased"
    epsilon: float = 0.05
    sweeps: int = 50
    fgw_alpha: float = 0.25
    fgw_rounds: int = 5
    fgw_features: str = "expression_only"
    fgw_structure_scale: str = "sampled_median"
    structure_pairs: int = 10_000
    anchor_weight: float = 0.0
    block: int = 64
    target_block_memory_gib: float | None = None
    max_exact_cells: int = 5000
    max_ot_work: float = 5e11
    max_fgw_work: float = 1e12
    force: bool = False
    method: str = "agglomerative"
    n_clusters: int | None = None
    candidates: tuple[int, ...] = tuple(range(5, 31))
    model_selection_metrics: tuple[str, ...] = METRICS[:4]
    knn: int = 30
    affinity: str = "local"
    leiden_resolution: float = 1.0
    candidate_resolutions: tuple[float, ...] | None = None
    instance_radius: float | None = None
    instance_max_neighbors: int = 512
    embedding: str = "pca"
    dimensions: int = 32
    expression_batch_key: str | None = None
    standardize_precomputed: bool = True
    allow_umap_as_feature: bool = False
    seed: int = 1337

    def __post_init__(self):
        canonical(self.kernel, KERNELS, "kernel")
        canonical(self.structure, STRUCTURES, "structure")
        canonical(self.distance, DISTANCES, "distance")
        canonical(self.method, METHODS, "method")
        metric_names(self.model_selection_metrics)
        for name, allowed in (("isolated", ISOLATED), ("fgw_features", ("full_token", "expression_only", "expression_plus_radial")), ("fgw_structure_scale", ("none", "sampled_median")), ("scales", SCALES), ("affinity", ("local", "global")), ("cap_mode", ("radial_shell", "radial_shell_state"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"unknown {name} {getattr(self, name)!r}; known: {', '.join(allowed)}")
        for name in ("radius", "max_neighbors", "radial_shells", "sweeps", "fgw_rounds", "knn", "epsilon", "leiden_resolution", "instance_radius", "instance_max_neighbors", "dimensions", "target_block_memory_gib"):
            if getattr(self, name) is not None and not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")
        if self.candidate_resolutions is not None and not any(r > 0 for r in self.candidate_resolutions):
            raise ValueError("candidate_resolutions must have a positive value")

    @classmethod
    def of(cls, **options) -> NicheConfig:
        """A config from options by their own or their longer names (``OPTION_NAMES``), and from the three weights one by one."""
        found = {OPTION_NAMES.get(k, k): v for k, v in options.items()}
        if len(found) < len(options):
            raise ValueError("an option is given by two names")
        weights = list(found.pop("weights", cls.weights))
        for n, name in enumerate(("expression_weight", "spatial_weight", "distance_weight")):
            weights[n] = found.pop(name, weights[n])
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()}, weights=tuple(weights))

    def to_dict(self) -> dict:
        return asdict(self)


def parse_int_list(value: str) -> tuple[int, ...]:
    """``5:8`` and ``8-5`` are inclusive ranges, up or down; commas join entries."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in value.split(","))):
        sep = ":" if ":" in part else "-" if "-" in part[1:] else None
        if sep is None:
            out.append(int(part))
            continue
        a, b = (int(x) for x in part.split(sep))
        out += range(a, b + 1) if a <= b else range(a, b - 1, -1)
    return tuple(out)


def parse_float_list(value: str) -> tuple[float, ...]:
    return tuple(float(p) for p in value.split(",") if p.strip())


def parse_string_list(value: str) -> tuple[str, ...]:
    return tuple(p.strip() for p in value.split(",") if p.strip())
