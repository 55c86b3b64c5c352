"""Whole runs: an exact fit, assignment through landmarks, and rough clusters within samples followed by a fine one of these."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichewright.config import DISTANCES, KERNELS, METHODS, NicheConfig, canonical
from nichewright.functions import kernels
from nichewright.operators import assignment, clustering, graphs, measures, metrics, neighbors, plots, structures, transport
from nichewright.plans import restart
from nichewright.plans.storage import materialise


@dataclass
class Run:
    """The tables of a run by name, and its summary."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    summary: dict = field(default_factory=dict)


def local_measures(cells: DataFrame, vectors: DataFrame, config: NicheConfig, states: DataFrame | None = None, scales: dict | None = None, uniform_fallback: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """(packed measures, counts, scales): the capped, weighted and scaled neighborhoods, with structures for fgw.

    ``cells`` is (row_idx, sample_id, x, y) and ``vectors`` (row_idx, z).  A cap mode that ends in ``state`` uses ``states`` (row_idx,
    state), which k-means gives if they aren't passed.  ``scales`` are those of an earlier run, {"components": (z, position, radius),
    "structure": number}; measures are only comparable under the same ones.  A table without a vector raises ValueError.
    """
    first = vectors.where(F.col("z").isNotNull()).first()
    if first is None:
        raise ValueError("there are no vectors")
    if states is None and config.cap_mode.endswith("state"):
        states = measures.state_labels(vectors, config.n_states, config.seed)
    kernel = canonical(config.kernel, KERNELS, "kernel")
    edges = neighbors.radius_edges(cells, config.radius)
    edges = materialise(edges.withColumn("weight", measures.kernel_weight(F.col("distance"), config.radius, kernel)), "edges")
    with_state = edges if states is None else edges.join(states.select(F.col("row_idx").alias("neighbor"), "state"), "neighbor", "left")
    by_state = config.cap_mode.endswith("state") and states is not None
    capped = materialise(measures.cap_neighbors(with_state.select("row_idx", "neighbor", "distance", "weight", *(["state"] if by_state else [])), config.radius, config.max_neighbors, config.radial_shells, config.seed, by_state), "capped")
    support = measures.assemble(cells, capped, config.include_anchor, config.isolated, uniform_fallback)
    token_rows = materialise(measures.tokens(support, cells, vectors, config.radius), "tokens")
    scales = dict(scales or {"components": measures.component_scales(token_rows, config.scales, config.scale_pairs, config.seed)})
    fgw = canonical(config.distance, DISTANCES, "distance") == "fgw"
    held = config.fgw_features if fgw else "full_token"
    width = len(first["z"]) + {"full_token": 3, "expression_only": 0, "expression_plus_radial": 1}[held]
    packed = measures.packed(measures.scaled_tokens(token_rows, config.weights, tuple(scales["components"]), held), width)
    if fgw:
        packed = structures.packed_structures(packed, config.structure, config.structure_knn, config.structure_radius_fraction)
        if config.fgw_structure_scale != "none":
            packed = materialise(packed, "structures")
            if "structure" not in scales:
                scales["structure"] = structures.structure_scale(packed, config.structure_pairs, config.seed).first()["scale"]
            packed = structures.normalised_structures(packed, scales["structure"])
    full = neighbors.neighbor_counts(cells, edges, "n_full")
    counts = full.join(neighbors.neighbor_counts(cells, capped, "n_retained"), "row_idx")
    return materialise(packed, "measures"), materialise(counts, "counts"), scales


def _kernel(config: NicheConfig) -> dict:
    return {"epsilon": config.epsilon, "sweeps": config.sweeps, "alpha": config.fgw_alpha, "rounds": config.fgw_rounds}


def exact_distance(packed: DataFrame, vectors: DataFrame, config: NicheConfig, store: str | None = None) -> DataFrame:
    """(i, j, cost) of all pairs i < j, after the guards; with a folder ``store`` a run that was broken off continues (``plans.restart``)."""
    size = packed.agg(F.count("*").alias("n"), F.max("m").alias("m")).first()
    fgw = canonical(config.distance, DISTANCES, "distance") == "fgw"
    work = transport.pairwise_work(size["n"], size["m"] or 1, config.sweeps, config.fgw_rounds if fgw else 0)
    transport.admit(work, config.max_fgw_work if fgw else config.max_ot_work, size["n"], config.max_exact_cells, config.force)
    block = transport.block_size(size["m"] or 1, config.block, config.target_block_memory_gib, fgw)
    made = restart.stored_costs(packed, store, "fgw" if fgw else "sinkhorn", block=block, **_kernel(config)) if store else None
    costs = transport.distances(packed, mode=config.distance, costs=made, block=block, **_kernel(config))
    return materialise(transport.anchor_penalty(costs, vectors, config.anchor_weight), "distance")


def cluster(distance: DataFrame, ids: DataFrame, config: NicheConfig) -> tuple[DataFrame, DataFrame | None]:
    """(labels, selection table or None) of the upper triangle ``distance``."""
    both = materialise(transport.mirrored(distance), "distance")
    method, names = canonical(config.method, METHODS, "method"), config.model_selection_metrics
    if method == "leiden" and not config.candidate_resolutions:
        return clustering.community_labels(both, ids, config.knn, config.affinity, config.leiden_resolution, config.seed), None
    if method == "leiden":
        table, labels = clustering.select_resolution(both, ids, config.candidate_resolutions, config.knn, config.affinity, names, config.seed)
    else:
        candidates = (config.n_clusters,) if config.n_clusters else config.candidates
        table, labels = clustering.select_model(both, ids, candidates, method, names)
    return labels, table


def checks(packed: DataFrame, config: NicheConfig) -> dict:
    """For the summary: how far the plans of a sample are from convergence, or how many structures fell apart."""
    if canonical(config.distance, DISTANCES, "distance") == "fgw":
        return {"structures": structures.diagnostics(packed, config.structure).first().asDict()}
    return {"convergence": transport.convergence_sample(packed, config.epsilon, config.sweeps).first().asDict()}


def feasibility(cells: int, config: NicheConfig, pairs_per_second: float | None = None) -> dict:
    """What all pairs of so many cells would take at most, and whether the guards let them run."""
    fgw = canonical(config.distance, DISTANCES, "distance") == "fgw"
    rounds, support = config.fgw_rounds if fgw else 0, config.max_neighbors + config.include_anchor
    found = transport.feasibility(cells, support, config.sweeps, rounds, pairs_per_second or 1.0)
    if not pairs_per_second:
        found["days"] = None
    try:
        transport.admit(found, config.max_fgw_work if fgw else config.max_ot_work, cells, config.max_exact_cells, config.force)
    except ValueError as error:
        return found | {"cells": cells, "status": "refused", "reason": str(error)}
    return found | {"cells": cells, "status": "admitted", "reason": None}


def fit(cells: DataFrame, vectors: DataFrame, config: NicheConfig, states: DataFrame | None = None, store: str | None = None) -> Run:
    """Niches of a cohort small enough for all pairs: labels, scores, instances, affinities, medoids and a summary.

    With a folder ``store`` the distances are kept there share by share, and a run that was broken off takes them up.
    """
    began = time.time()
    packed, counts, scales = local_measures(cells, vectors, config, states)
    distance = exact_distance(packed, vectors, config, store)
    labels, selection = cluster(distance, cells, config)
    both = materialise(transport.mirrored(distance), "distance")
    labels = materialise(labels, "labels")
    scored = metrics.assignment_score(both, labels)
    edges = neighbors.nearest_within(neighbors.radius_edges(cells, config.instance_radius or config.radius), config.instance_max_neighbors)
    found = graphs.instances(labels, edges).select("row_idx", F.col("instance"), F.col("name").alias("instance_name"))
    density = counts.select("row_idx", *(c.alias(n) for n, c in neighbors.density_columns(F.col("n_full"), F.col("n_retained"), config.radius).items()))
    out = cells.join(scored.withColumnsRenamed({"niche": "ot_niche_int", "score": "ot_niche_assignment_score"}), "row_idx").join(found.withColumnsRenamed({"instance": "ot_niche_instance_int", "instance_name": "ot_niche_instance"}), "row_idx").join(density, "row_idx")
    out = out.withColumn("ot_niche", F.concat(F.lit("ON"), F.col("ot_niche_int").cast("string")))
    medoids = metrics.medoids(both, labels)
    run = Run({"cells": materialise(out, "cells"), "distance": distance, "affinity": graphs.knn_affinity(both, config.knn, config.affinity), "labels": labels, "medoids": medoids, "measures": packed})
    run.tables["plot_grid"] = plots.niche_grid(run.tables["cells"], config.radius, niche="ot_niche_int")
    if selection is not None:
        run.tables["selection"] = selection
    sizes = metrics.size_summary(labels).first().asDict()
    run.summary = {"config": config.to_dict(), "sizes": sizes, "cells": cells.count(), "scales": scales, "runtime_seconds": time.time() - began} | checks(packed, config)
    return run


def assign(cells: DataFrame, vectors: DataFrame, config: NicheConfig, reference: DataFrame, medoids: DataFrame, scales: dict, threshold: float = 0.0, states: DataFrame | None = None, reference_vectors: DataFrame | None = None, reference_own: DataFrame | None = None) -> DataFrame:
    """(row_idx, nearest, niche, cost, score): new cells against the medoids of an earlier run.

    ``reference_own`` are the medoids' self costs, if that run stored them; they are checked and save computing them again.
    ``reference`` holds the medoids' packed measures, ``medoids`` is (niche, medoid), and ``config`` and ``scales`` are that run's.  Only
    pairs of a cell and a medoid are computed, after the guard on their work.
    """
    packed, _, _ = local_measures(cells, vectors, config, states, scales)
    fgw = canonical(config.distance, DISTANCES, "distance") == "fgw"
    size = {n: df.agg(F.count("*").alias("n"), F.max("m").alias("m")).first() for n, df in (("new", packed), ("old", reference))}
    work = transport.cross_work(size["new"]["n"], size["old"]["n"], size["new"]["m"] or 1, size["old"]["m"] or 1, config.sweeps, config.fgw_rounds if fgw else 0)
    transport.admit(work, config.max_fgw_work if fgw else config.max_ot_work, force=config.force)
    costs = transport.distances(packed, reference, mode=config.distance, other_own=reference_own, block=config.block, **_kernel(config))
    if config.anchor_weight and reference_vectors is not None:
        costs = transport.anchor_penalty(costs, vectors, config.anchor_weight, reference_vectors)
    return assignment.assign_by_medoids(costs, medoids, threshold)


def _padded(masses: list, tokens: list) -> tuple[np.ndarray, np.ndarray]:
    width, d = max(map(len, masses)), len(tokens[0]) // len(masses[0])
    mass, token = np.zeros((len(masses), width)), np.zeros((len(masses), width, d))
    for n, (w, t) in enumerate(zip(masses, tokens, strict=True)):
        mass[n, : len(w)], token[n, : len(w)] = w, np.reshape(t, (len(w), d))
    return mass, token


def _squares(values: list, masses: list, width: int) -> np.ndarray:
    out = np.zeros((len(values), width, width))
    for n, (v, w) in enumerate(zip(values, masses, strict=True)):
        out[n, : len(w), : len(w)] = np.reshape(v, (len(w), len(w)))
    return out


def candidate_costs(packed: DataFrame, reference: DataFrame, candidates: DataFrame, config: NicheConfig, most_sent: int = 8_000_000) -> DataFrame:
    """(i, j, cost) for the pairs of ``candidates`` (i, j) only, up to 256 pairs in one array.

    A reference of at most ``most_sent`` numbers is sent to every task once, and a cell's row carries its own measure and the ids of its
    candidates.  For a larger one each row carries the two measures of its pair.  Pairs whose cell or reference has no measure give no
    row; repeated pairs are repeated.
    """
    fgw = canonical(config.distance, DISTANCES, "distance") == "fgw"
    columns = ["masses", "tokens"] + ["structure"] * fgw
    kernel = _kernel(config)

    def values(a: list[list], b: list[list]) -> np.ndarray:
        (ma, ta), (mb, tb) = _padded(a[0], a[1]), _padded(b[0], b[1])
        cost = kernels.cost_matrix(ta, tb)
        if not fgw:
            return kernels.sinkhorn_cost(cost, ma, mb, kernel["epsilon"], kernel["sweeps"])
        sa, sb = _squares(a[2], a[0], ma.shape[1]), _squares(b[2], b[0], mb.shape[1])
        return kernels.fgw_cost(cost, sa, sb, ma, mb, kernel["alpha"], kernel["epsilon"], kernel["sweeps"], kernel["rounds"])

    def rows_of(i: list, j: list, cost: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "cost": cost})

    numbers = reference.agg(F.sum(sum((F.size(c) for c in columns), F.lit(0)).cast("long"))).first()[0] or 0
    if numbers > most_sent:
        side = lambda df, key, tag: df.select(F.col("row_idx").alias(key), *(F.col(c).alias(f"{c}_{tag}") for c in columns))
        rows = candidates.select("i", "j").join(side(reference, "j", "b"), "j").join(side(packed, "i", "a"), "i")

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    r = batch.slice(start, 256).to_pydict()
                    yield rows_of(r["i"], r["j"], values(*([r[f"{c}_{tag}"] for c in columns] for tag in "ab")))

        return rows.mapInArrow(pairs, "i long, j long, cost double")

    table = reference.select("row_idx", *columns).collect()  # bounded by most_sent
    sent = packed.sparkSession.sparkContext.broadcast({r.row_idx: tuple(np.array(r[c], float) for c in columns) for r in table})
    wanted = candidates.groupBy("i").agg(F.sort_array(F.collect_list("j")).alias("js"))
    rows = packed.select(F.col("row_idx").alias("i"), *columns).join(wanted, "i")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                i, js = piece.column("i").to_pylist(), piece.column("js").to_pylist()
                own = [[v.values.to_numpy(zero_copy_only=False) for v in piece.column(c)] for c in columns]
                all_pairs = [(n, j) for n, wanted_js in enumerate(js) for j in wanted_js if j in known]
                for at in range(0, len(all_pairs), 256):
                    some = all_pairs[at : at + 256]
                    yield rows_of([i[n] for n, _ in some], [j for _, j in some], values([[c[n] for n, _ in some] for c in own], [[known[j][c] for _, j in some] for c in range(len(columns))]))

    return rows.mapInArrow(cells, "i long, j long, cost double")


def fit_by_landmarks(cells: DataFrame, vectors: DataFrame, config: NicheConfig, n_landmarks: int = 1000, candidates: int = 100, states: DataFrame | None = None) -> Run:
    """Niches of landmarks, the cells nearest to k-means centres of each sample: every cell takes the niche of the nearest of its
    candidate landmarks."""
    packed, counts, scales = local_measures(cells, vectors, config, states, uniform_fallback=True)
    landmarks = materialise(assignment.kmeans_landmarks(cells, vectors, n_landmarks, seed=config.seed), "landmarks")
    reference = materialise(packed.join(landmarks.select("row_idx"), "row_idx", "left_semi"), "reference")
    distance = exact_distance(reference, vectors, config)
    labels, selection = cluster(distance, landmarks, config)
    near = assignment.landmark_candidates(vectors, vectors.join(landmarks.select("row_idx"), "row_idx", "left_semi"), candidates)
    best = assignment.landmark_margin(candidate_costs(packed, reference, near, config))
    placed = materialise(assignment.propagate(best, labels, "landmark"), "assigned")
    edges = neighbors.radius_edges(cells.join(placed.select("row_idx", "niche"), "row_idx"), config.radius, same="niche")
    found = graphs.instances(placed.select("row_idx", "niche"), edges)
    tables = {"cells": cells.join(placed, "row_idx").join(found.select("row_idx", "instance", "name"), "row_idx").join(counts, "row_idx"), "labels": labels, "distance": distance}
    return Run(tables | ({"selection": selection} if selection is not None else {}), {"config": config.to_dict(), "landmarks": landmarks.count(), "scales": scales} | checks(reference, config))


def fit_rough_then_fine(cells: DataFrame, vectors: DataFrame, config: NicheConfig, rough: int = 20, representative_only: bool = False, states: DataFrame | None = None) -> Run:
    """k-means within each sample, then niches of the representatives, which their members take over."""
    packed, counts, scales = local_measures(cells, vectors, config, states, uniform_fallback=True)
    full = cells.join(vectors, "row_idx").join(counts.select("row_idx", F.col("n_full").alias("n_neighbors")), "row_idx")
    members = materialise(assignment.rough_clusters(full, rough, seed=config.seed), "rough")
    ids = members.select(F.col("representative").alias("row_idx")).distinct()
    graph = packed.join(ids, "row_idx", "left_semi")
    if representative_only:
        return Run({"members": members, "representatives": graph}, {"config": config.to_dict()})
    distance = exact_distance(materialise(graph, "representatives"), vectors, config)
    labels, selection = cluster(distance, ids, config)
    tables = {"cells": assignment.propagate(members, labels), "labels": labels, "representatives": graph, "distance": distance}
    return Run(tables | ({"selection": selection} if selection is not None else {}), {"config": config.to_dict(), "representatives": ids.count(), "scales": scales})
