"""Radius self-joins within samples, by grid buckets.

A cell of the grid is as wide as the radius, so a point's neighbors lie in its own cell and the eight around it.  The probe side is
replicated to these nine cells and meets the build side in an equi-join on (sample, cell), which shuffles and spills like any
other and whose dense cells adaptive execution splits; no range predicate is left to a nested loop.

Cases: points with a null or non-finite coordinate have no neighbors; coincident points are neighbors of each other; rows of one id
aren't; a null sample is a sample of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichewright.functions.portable import finite


def radius_edges(cells: DataFrame, radius: float, same: str | None = None) -> DataFrame:
    """(row_idx, neighbor, distance) for all ordered pairs of one sample within ``radius``, from (row_idx, sample_id, x, y).

    ``same`` names a column that both ends must share as well; it joins the key, so it prunes before the shuffle.
    """
    if not radius > 0:
        raise ValueError("radius must be positive")
    keys = [c for c in ("sample_id", same) if c]
    points = cells.where(finite(F.col("x")) & finite(F.col("y"))).select("row_idx", *keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    placed = points.withColumns({"gx": F.floor(F.col("x") / radius), "gy": F.floor(F.col("y") / radius)})
    around = [F.struct((F.col("gx") + dx).alias("gx"), (F.col("gy") + dy).alias("gy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    probe = placed.withColumn("cell", F.explode(F.array(*around))).select("row_idx", "x", "y", *keys, F.col("cell.gx").alias("gx"), F.col("cell.gy").alias("gy"))
    build = placed.select(F.col("row_idx").alias("neighbor"), F.col("x").alias("nx"), F.col("y").alias("ny"), *(F.col(k).alias(f"n_{k}") for k in keys), F.col("gx").alias("ngx"), F.col("gy").alias("ngy"))
    on = [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in keys] + [F.col("gx") == F.col("ngx"), F.col("gy") == F.col("ngy")]
    distance = F.sqrt((F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y")))
    return probe.join(build, on).where(F.col("row_idx") != F.col("neighbor")).select("row_idx", "neighbor", distance.alias("distance")).where(F.col("distance") <= radius)


def nearest_within(edges: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest neighbors of each row, with their rank from 1, which replaces a column of that name; ties go by id."""
    order = Window.partitionBy("row_idx").orderBy("distance", "neighbor")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def neighbor_counts(cells: DataFrame, edges: DataFrame, name: str = "n_neighbors") -> DataFrame:
    """(row_idx, count) for every cell, 0 where it has no edge."""
    counted = edges.groupBy("row_idx").agg(F.count("*").alias(name))
    return cells.select("row_idx").join(counted, "row_idx", "left").select("row_idx", F.coalesce(name, F.lit(0)).alias(name))


def density_columns(full: Column, retained: Column, radius: float) -> dict[str, Column]:
    """The columns of retention and density, named by the radius with ``p`` for the decimal point."""
    tag = f"r{radius:g}".replace(".", "p")
    area = F.lit(3.141592653589793 * radius * radius)
    return {
        f"n_neighbors_full_{tag}": full.cast("int"),
        f"n_neighbors_retained_{tag}": retained.cast("int"),
        f"neighbor_retention_fraction_{tag}": retained / F.greatest(full, F.lit(1)),
        f"local_density_full_per_um2_{tag}": full / area,
        f"local_density_retained_per_um2_{tag}": retained / area,
    }
