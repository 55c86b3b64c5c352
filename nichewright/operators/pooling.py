"""Pooling of samples into one cohort, tile layout, and distribution of features back to their sources."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sample_id(file_name: Column, prefix: str = "", suffix: str = "", case: str = "preserve") -> Column:
    """The sample's name from a file name: directory and extension go, then the prefix, then the suffix."""
    if case not in ("preserve", "lower", "upper"):
        raise ValueError("case must be preserve, lower or upper")
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"\.[^.]*$", "")
    for anchored in ([f"^{re.escape(prefix)}"] if prefix else []) + ([f"{re.escape(suffix)}$"] if suffix else []):
        stem = F.regexp_replace(stem, anchored, "")
    return {"preserve": lambda c: c, "lower": F.lower, "upper": F.upper}[case](stem)


def read_samples(spark: SparkSession, directory: str, pattern: str = "*.parquet", prefix: str = "", suffix: str = "", case: str = "preserve") -> DataFrame:
    """The rows of all files in a directory that match, with ``source_file`` and ``sample_id``; no match raises FileNotFoundError."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.option("pathGlobFilter", pattern).option("mergeSchema", "true").parquet(directory)
    except AnalysisException as error:
        raise FileNotFoundError(f"no file in {directory} matches {pattern}") from error
    rows = rows.withColumn("source_file", F.col("_metadata.file_name"))
    return rows.withColumn("sample_id", sample_id(F.col("source_file"), prefix, suffix, case))


def pool(samples: list[tuple[str, DataFrame]], x: str = "x", y: str = "y", key: str = "cell_id", required: tuple[str, ...] = ()) -> DataFrame:
    """All rows of named samples under one schema, with sample_id, the original coordinates and a unique ``{sample}:{key}``."""
    if not samples:
        raise ValueError("nothing to pool")
    parts = []
    for name, rows in samples:
        try:
            parts.append(tagged(rows, F.lit(name), x, y, key, required))
        except KeyError as error:
            raise KeyError(f"sample {name}: {error.args[0]}") from error
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tagged(rows: DataFrame, sample: Column, x: str = "x", y: str = "y", key: str = "cell_id", required: tuple[str, ...] = ()) -> DataFrame:
    """The rows with sample_id, their coordinates as they came, and a unique ``{sample}:{key}``; a column that lacks raises KeyError."""
    if lacking := [c for c in (x, y, key, *required) if c not in rows.columns]:
        raise KeyError(f"the rows lack {', '.join(lacking)}")
    pooled = F.concat(sample.cast("string"), F.lit(":"), F.col(key).cast("string"))
    return rows.withColumns({"sample_id": sample, f"original_{x}": F.col(x), f"original_{y}": F.col(y), "pooled_id": pooled})


def repeated_ids(rows: DataFrame) -> DataFrame:
    """(pooled_id, count) of ids that more than one row has, or that are null."""
    return rows.groupBy("pooled_id").count().where("count > 1 OR pooled_id IS NULL")


def check_genes(genes: DataFrame) -> DataFrame:
    """(gene_idx, gene) that all samples of (sample_id, gene_idx, gene) share in one order; a difference raises ValueError.

    A gene belongs to the shared list if every sample has it, once, at the same place; null names and places count as values.
    """
    n = genes.select("sample_id").distinct().count()
    found = genes.groupBy("gene_idx", "gene").agg(F.count("*").alias("rows"), F.count_distinct("sample_id").alias("samples"), F.min("sample_id").alias("first"))
    if (bad := found.where((F.col("rows") != n) | (F.col("samples") != n)).orderBy("gene_idx", "gene").first()) is not None:
        raise ValueError(f"genes differ: {bad['gene']!r} at place {bad['gene_idx']} is in {bad['samples']} of {n} samples, {bad['first']} first")
    return found.select("gene_idx", "gene")


def sample_summary(cells: DataFrame) -> DataFrame:
    """(sample_id, n_cells, min_x, max_x, min_y, max_y)."""
    return cells.groupBy("sample_id").agg(F.count("*").alias("n_cells"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def tile_layout(summary: DataFrame, order: str = "sample_id", columns: int | None = None, gap: float | None = None) -> DataFrame:
    """The summary with layout_col, layout_row, shift_x and shift_y: samples stand on a grid, row by row, in the given order.

    There are as many columns as asked for, else the ceiling of the root of the number of samples; tiles are as wide and high as the
    largest sample, 1 at least, plus the gap, which is 10 spans, at least 10,000, unless given.  Further columns stay, whatever their
    names; earlier ones of the four names are replaced.
    """
    whole = Window.partitionBy()
    n, at = F.count("*").over(whole), F.row_number().over(Window.orderBy(order)) - 1
    cols = F.lit(columns) if columns else F.ceil(F.sqrt(n))
    width, height = (F.max(F.col(f"max_{a}") - F.col(f"min_{a}")).over(whole) for a in "xy")
    between = F.lit(float(gap)) if gap is not None else F.greatest(F.lit(10000.0), F.lit(10.0) * F.greatest(width, height))
    tile = F.struct(at.alias("at"), cols.cast("long").alias("cols"), (F.greatest(width, F.lit(1.0)) + between).alias("x"), (F.greatest(height, F.lit(1.0)) + between).alias("y"))
    placed = summary.select(F.struct(*summary.columns).alias("own"), tile.alias("tile"))
    col, row = F.col("tile.at") % F.col("tile.cols"), F.floor(F.col("tile.at") / F.col("tile.cols"))
    made = {"layout_col": col.cast("int"), "layout_row": row.cast("int"), "shift_x": col * F.col("tile.x"), "shift_y": row * F.col("tile.y")}
    return placed.select(*(F.col("own").getField(c).alias(c) for c in summary.columns if c not in made), *(c.alias(n) for n, c in made.items()))


def translate(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """The cells with pooled_x and pooled_y: their place in the sample's tile.  Samples are few, but not provably: no hint is given."""
    tiles = layout.select("sample_id", "min_x", "min_y", "layout_col", "layout_row", "shift_x", "shift_y")
    moved = cells.join(tiles, "sample_id")
    return moved.withColumns({"pooled_x": F.col("x") + F.col("shift_x") - F.col("min_x"), "pooled_y": F.col("y") + F.col("shift_y") - F.col("min_y")}).drop("min_x", "min_y")


def columns_for(n: int) -> int:
    return math.ceil(math.sqrt(n))


def distribute(pooled: DataFrame, sources: DataFrame, keys: tuple[str, ...] = ("source_file", "cell_id"), check: bool = True) -> DataFrame:
    """The source rows with the pooled features of equal keys; a row without one, or a repeated key, raises ValueError."""
    if check and not (bad := violations(pooled, sources, keys)).isEmpty():
        raise ValueError(f"keys that don't map one to one: {bad.limit(5).collect()}")
    return sources.join(pooled, list(keys))


def cell_key(cells: DataFrame) -> Column:
    """A cell's name within its source file: ``cell_id``, else what follows the first colon of ``pooled_id``."""
    if "cell_id" in cells.columns:
        return cells["cell_id"].cast("string")
    if "pooled_id" in cells.columns:
        return F.regexp_replace(cells["pooled_id"], r"^[^:]*:", "")
    raise KeyError("cells have neither cell_id nor pooled_id")


def distribute_to_sources(prepared: DataFrame, pooled: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows of the source files with the features that were prepared for the pooled cells.

    ``prepared`` is (row_idx, z), ``pooled`` has row_idx, source_file and a cell's name (``cell_key``), and ``sources`` has source_file
    and such a name.  A source file without pooled rows raises KeyError, as does a missing column; names that don't map one to one,
    on either side, raise ValueError.  Null names match nothing and so count as missing.
    """
    for name, df, columns in (("prepared", prepared, ("row_idx", "z")), ("pooled", pooled, ("row_idx", "source_file")), ("source", sources, ("source_file",))):
        if lacking := [c for c in columns if c not in df.columns]:
            raise KeyError(f"{name} rows lack {', '.join(lacking)}")
    lost = sources.select("source_file").distinct().join(pooled.select("source_file").distinct(), "source_file", "left_anti")
    if (row := lost.first()) is not None:
        raise KeyError(f"no pooled rows come from {row['source_file']}")
    named = pooled.select("row_idx", "source_file", cell_key(pooled).alias("__nw_key")).join(prepared.select("row_idx", "z"), "row_idx").drop("row_idx")
    return distribute(named, sources.withColumn("__nw_key", cell_key(sources)), ("source_file", "__nw_key")).drop("__nw_key")


def violations(pooled: DataFrame, sources: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, problem): source rows without a pooled row, and keys that either side repeats."""
    missing = sources.join(pooled, list(keys), "left_anti").select(*keys, F.lit("missing").alias("problem"))
    twice = [df.groupBy(*keys).count().where("count > 1").select(*keys, F.lit(f"repeated in {name}").alias("problem")) for name, df in (("pooled", pooled), ("source", sources))]
    return reduce(DataFrame.unionByName, twice, missing)
