"""Command line: ``python -m nichewright fit | landmark | rough-fine | assign | pool-inputs | prepare-inputs | distribute-prepared-inputs | align-external``."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nichewright.config import DISTANCES, OPTION_NAMES, NicheConfig, canonical, parse_float_list, parse_int_list, parse_string_list
from nichewright.operators import features, pooling
from nichewright.plans import runs
from nichewright.plans.storage import discard, made, materialise
from nichewright.sources import bundle

_LISTS = {"candidates": parse_int_list, "weights": parse_float_list, "model_selection_metrics": parse_string_list, "candidate_resolutions": parse_float_list}
_OPTIONAL = {"n_clusters": int, "expression_batch_key": str}
_log = logging.getLogger("nichewright")


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="nichewright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("fit", "landmark", "rough-fine"):
        p = commands.add_parser(name)
        p.add_argument("--input", required=True, help="bundle with the tables cells (row_idx, sample_id, x, y) and features (row_idx, z)")
        p.add_argument("--output", required=True)
        p.add_argument("--feature-name", default="z", help="what the vectors are called where they come from")
        p.add_argument("--spatial-scale", type=float, default=1.0)
        p.add_argument("--max-cells", type=int, help="take the first rows by row_idx only")
        p.add_argument("--distance-store", choices=("auto", "inline", "parquet"), default="auto", help="parquet: fit keeps the distances share by share and continues where it was broken off; auto: above --max-exact-cells")
        p.add_argument("--pairs-per-second", type=float, help="a measured rate, for the estimate in feasibility.json")
        for f in dataclasses.fields(NicheConfig):
            flags = ["--" + n.replace("_", "-") for n in (f.name, *(k for k, v in OPTION_NAMES.items() if v == f.name))]
            if isinstance(f.default, bool):
                p.add_argument(*flags, action=argparse.BooleanOptionalAction, default=f.default, dest=f.name)
            else:
                kind = _LISTS.get(f.name) or _OPTIONAL.get(f.name) or (float if f.default is None else type(f.default))
                p.add_argument(*flags, type=kind, default=f.default, dest=f.name)
        for flag in ("--expression-weight", "--spatial-weight", "--distance-weight"):
            p.add_argument(flag, type=float)
        if name == "landmark":
            p.add_argument("--landmarks", type=int, default=1000)
            p.add_argument("--landmark-candidates", type=int, default=100)
        if name == "rough-fine":
            p.add_argument("--rough-clusters", type=int, default=20)
            p.add_argument("--representative-only", action="store_true")
    assign = commands.add_parser("assign", help="niches of new cells by the medoids that fit saved")
    assign.add_argument("--model", required=True, help="the output of fit")
    assign.add_argument("--input", required=True)
    assign.add_argument("--output", required=True)
    assign.add_argument("--spatial-scale", type=float, default=1.0)
    assign.add_argument("--threshold", type=float, default=0.0, help="cells of a smaller margin get niche -1")
    pool = commands.add_parser("pool-inputs")
    prepare = commands.add_parser("prepare-inputs")
    distribute = commands.add_parser("distribute-prepared-inputs")
    align = commands.add_parser("align-external", help="features of a bundle from a table (source_file, cell_id, z)")
    for p in (pool, prepare, distribute, align):
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
    for flag, default in (("--glob", "*.parquet"), ("--prefix", ""), ("--suffix", ""), ("--case", "preserve")):
        pool.add_argument(flag, default=default)
    pool.add_argument("--key", default="cell_id", help="the column that names a cell within its sample")
    pool.add_argument("--layout-columns", type=int)
    pool.add_argument("--layout-gap", type=float)
    prepare.add_argument("--overwrite", action="store_true")
    pool.add_argument("--genes", help="directory of Parquet files (gene_idx, gene), one a sample, that must agree")
    distribute.add_argument("--prepared", required=True)
    distribute.add_argument("--sources", help="directory of the source files; without it rows are matched by row_idx")
    distribute.add_argument("--glob", default="*.parquet")
    distribute.add_argument("--overwrite", action="store_true")
    align.add_argument("--external", required=True)
    align.add_argument("--dimensions", type=int, help="the length that every vector must have")
    return parser


def _cohort(spark: SparkSession, path: str, scale: float):
    """(cells, features) of a bundle."""
    found = bundle.read_bundle(spark, path, ("cells", "features"), {"cells": ("row_idx", "x", "y"), "features": ("row_idx", "z")})
    cells = found["cells"].withColumns({"x": F.col("x") * scale, "y": F.col("y") * scale})
    return cells if "sample_id" in cells.columns else cells.withColumn("sample_id", F.lit("sample_0")), found["features"]


def _fit(spark: SparkSession, args) -> dict:
    options = {f.name: getattr(args, f.name) for f in dataclasses.fields(NicheConfig)}
    config = NicheConfig.of(**options, **{w: getattr(args, w) for w in ("expression_weight", "spatial_weight", "distance_weight") if getattr(args, w) is not None})
    cells, held = _cohort(spark, args.input, args.spatial_scale)
    if args.max_cells is not None:
        if args.max_cells < 1:
            raise ValueError("--max-cells must be positive")
        cells = cells.orderBy("row_idx").limit(args.max_cells)
        held = held.join(cells.select("row_idx"), "row_idx", "left_semi")
    if args.command == "fit":
        estimate = runs.feasibility(cells.count(), config, args.pairs_per_second)
        bundle.write_json(spark, f"{args.output}/feasibility.json", estimate)
        if estimate["cells"] > config.max_exact_cells and not config.force:
            _log.warning("all pairs were not run: %s", estimate["reason"])
            return estimate
    for warning in features.resolve_feature(args.feature_name, config.allow_umap_as_feature):
        _log.warning(warning)
    state = features.fit_embedding(held, method=config.embedding, dimensions=config.dimensions, standardise=config.standardize_precomputed)
    vectors = held.select("row_idx", state.transform(F.col("z")).alias("z"))
    _log.info("%s: embedding of %d dimensions fitted", args.command, len(state.components or state.mean))
    store = bundle.distance_store(cells.count(), args.distance_store, config.max_exact_cells)
    if args.command == "fit":
        run = runs.fit(cells, vectors, config, store=f"{args.output}/distance_shares" if store == "parquet" else None)
        settings = {"config": config.to_dict(), "scales": run.summary["scales"]}
        bundle.save_reference(f"{args.output}/model", run.tables["labels"], run.tables["medoids"], packed=run.tables["measures"], settings=settings)
        medoids = run.tables["medoids"].select(F.col("medoid").alias("row_idx"))
        bundle.write_table(vectors.join(medoids, "row_idx", "left_semi"), f"{args.output}/model/reference_vectors")
        if canonical(config.distance, DISTANCES, "distance") == "debiased":
            bundle.save_self_costs(f"{args.output}/model", spark.read.parquet(f"{args.output}/model/reference_measures"), config.epsilon, config.sweeps)
    elif args.command == "landmark":
        run = runs.fit_by_landmarks(cells, vectors, config, args.landmarks, args.landmark_candidates)
    else:
        run = runs.fit_rough_then_fine(cells, vectors, config, args.rough_clusters, args.representative_only)
    state.save(spark, f"{args.output}/embedding_state")
    bundle.write_bundle(run.tables, args.output)
    samples = cells.select("sample_id").distinct().count()
    run.summary["features"] = features.provenance(config.embedding, samples, config.expression_batch_key) | {"kind": features.feature_kind(args.feature_name, False)}
    run.summary["distance_store"] = store
    bundle.write_json(spark, f"{args.output}/summary.json", run.summary)
    _log.info("%s: written to %s", args.command, args.output)
    return run.summary


def _assign(spark: SparkSession, args) -> dict:
    model = f"{args.model}/model"
    settings = bundle.read_json(spark, f"{model}/settings.json")
    config = NicheConfig.of(**settings["config"])
    cells, held = _cohort(spark, args.input, args.spatial_scale)
    state = features.EmbeddingState.load(spark, f"{args.model}/embedding_state")
    vectors = held.select("row_idx", state.transform(F.col("z")).alias("z"))
    _, medoids = bundle.load_reference(spark, model)
    own = bundle.read_bundle(spark, model, ("reference_measures", "reference_vectors"))
    self_costs = bundle.load_self_costs(spark, model, own["reference_measures"], config.epsilon, config.sweeps)
    placed = runs.assign(cells, vectors, config, own["reference_measures"], medoids, settings["scales"], args.threshold, reference_vectors=own["reference_vectors"], reference_own=self_costs)
    bundle.write_table(cells.join(placed, "row_idx"), f"{args.output}/cells")
    written = spark.read.parquet(f"{args.output}/cells")
    return {"cells": written.count(), "unknown": written.where("niche = -1").count()}


def _pool(spark: SparkSession, args) -> dict:
    rows = pooling.read_samples(spark, args.input, args.glob, args.prefix, args.suffix, args.case)
    if args.genes:
        pooling.check_genes(pooling.read_samples(spark, args.genes))
    rows = pooling.tagged(rows, F.col("sample_id"), key=args.key)
    if (twice := pooling.repeated_ids(rows).first()) is not None:
        raise ValueError(f"{twice['count']} rows are called {twice['pooled_id']}")
    layout = pooling.tile_layout(pooling.sample_summary(rows), columns=args.layout_columns, gap=args.layout_gap)
    bundle.write_bundle({"cells": pooling.translate(rows, layout), "samples": layout}, args.output)
    return {"samples": layout.count()}


def _align(spark: SparkSession, args) -> dict:
    """The table features (row_idx, z) of a bundle from vectors that another program made, by file and cell."""
    cells = bundle.read_bundle(spark, args.input, ("cells",), {"cells": ("row_idx", "source_file", "cell_id")})["cells"]
    aligned = bundle.align_external(cells, spark.read.parquet(args.external), dimensions=args.dimensions)
    bundle.write_table(aligned.select("row_idx", "z"), f"{args.output}/features")
    return {"rows": spark.read.parquet(f"{args.output}/features").count()}


def _prepare(spark: SparkSession, args) -> dict:
    """Features (row_idx, z) of the table counts (row_idx, gene, value); reused while the request stays the same."""
    request = features.svd_request()

    def make():
        counts = bundle.read_bundle(spark, args.input, ("counts",))["counts"]
        found = counts.select("gene").where("gene is not null").distinct().limit(features.MOST_NUMBERS // 2 + 1)
        genes = sorted(str(r.gene) for r in found.collect())  # genes, not cells; bounded
        rows = features.sparse_rows(features.library_size_log1p(counts.withColumn("gene", F.col("gene").cast("string")), request["target_sum"]), genes)
        rows = materialise(rows, "sparse")
        k = min(request["components"], rows.count() - 1, len(genes) - 1)
        if not request["use_svd"] or k < 2:
            return features.dense_rows(rows, len(genes))
        axes = features.sparse_svd(rows, len(genes), k, request["n_iter"], request["random_state"])
        variance, share = features.sparse_variance(rows, axes)
        bundle.write_json(spark, f"{args.output}/explained_variance.json", {"variance": variance, "ratio": share})
        return features.sparse_project(rows, axes)

    table, reused = bundle.cached(spark, f"{args.output}/features", request, make, args.overwrite)
    return {"rows": table.count(), "reused": reused}


def _distribute(spark: SparkSession, args) -> dict:
    prepared = spark.read.parquet(args.prepared)
    pooled = bundle.read_bundle(spark, args.input, ("cells",))["cells"]
    if args.sources:
        stamp = f"{args.prepared}.fingerprint.json"
        request = {"prepared": args.prepared, "sources": args.sources, "glob": args.glob, "made_by": bundle.read_json(spark, stamp) if bundle.exists(spark, stamp) else None}
        make = lambda: pooling.distribute_to_sources(prepared, pooled, pooling.read_samples(spark, args.sources, args.glob).drop("sample_id"))
        table, reused = bundle.cached(spark, args.output, request, make, args.overwrite)
        return {"rows": table.count(), "reused": reused}
    joined = pooling.distribute(prepared, pooled, ("row_idx",))
    bundle.write_table(joined, args.output, partition_by=("source_file",) if "source_file" in joined.columns else ())
    return {"rows": joined.count()}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark, earlier = spark or SparkSession.builder.appName("nichewright").getOrCreate(), made()
    step = {"pool-inputs": _pool, "prepare-inputs": _prepare, "distribute-prepared-inputs": _distribute, "align-external": _align, "assign": _assign}.get(args.command, _fit)
    print(json.dumps(bundle.plain(step(spark, args)), sort_keys=True))
    _log.info("%d work folders removed", discard(spark, earlier))
    return 0


if __name__ == "__main__":
    sys.exit(main())
