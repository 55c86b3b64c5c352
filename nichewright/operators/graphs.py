"""kNN graphs over a distance relation, their affinities, and connected instances of labels.

Cases: ties go by id; rows with fewer than k neighbors keep them all; distances of 0 don't make a scale; a null label joins no instance
with another row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichewright.functions.portable import least_drawn, uniform
from nichewright.operators import neighborhoods
from nichewright.operators.components import connected_components


def knn(distance: DataFrame, k: int) -> DataFrame:
    """(i, j, cost, rank): the ``k`` nearest of each row; ties go by id.  ``distance`` holds both directions."""
    order = Window.partitionBy("i").orderBy("cost", "j")
    return distance.where("i <> j").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distance_scale(distance: DataFrame, n: int, most_rows: int = 512, seed: int = 1337) -> DataFrame:
    """One row (scale): the median positive distance, for many rows the median of sampled rows' medians; 1 without any, 1e-8 at least."""
    positive = distance.where("cost > 0")
    if n > most_rows:
        rows = least_drawn(positive.select("i").distinct().withColumn("u", uniform(seed, F.col("i"))), "u", ["i"], most_rows, n).select("i")
        positive = positive.join(rows, "i").groupBy("i").agg(F.median("cost").alias("cost"))
    return positive.agg(F.greatest(F.coalesce(F.median("cost"), F.lit(1.0)), F.lit(1e-8)).alias("scale"))


def _united(directed: DataFrame, value: str) -> DataFrame:
    """Each undirected pair once with the larger value, then both directions."""
    pairs = directed.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max(value).alias(value))
    return pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), value).unionByName(pairs.select(F.col("b").alias("i"), F.col("a").alias("j"), value))


def knn_distance_graph(distance: DataFrame | None, k: int, near: DataFrame | None = None) -> DataFrame:
    return _united(knn(distance, k) if near is None else near, "cost")


def knn_affinity(distance: DataFrame, k: int, scaling: str = "local", n: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """(i, j, affinity), symmetric: exp(-d / scale), or exp(-d^2 / (s_i s_j)) with s the distance of the last positive neighbor.

    Where ``near`` (``knn``) and ``n`` are given, ``distance`` is asked for the scale only.
    """
    if scaling not in ("local", "global"):
        raise ValueError("scaling must be local or global")
    near = knn(distance, k) if near is None else near
    scale = distance_scale(distance, n if n is not None else distance.select("i").distinct().count()).first()["scale"]
    if scaling == "global":
        return _united(near.withColumn("affinity", F.exp(-F.col("cost") / scale)), "affinity")
    own = near.groupBy("i").agg(F.coalesce(F.max_by(F.when(F.col("cost") > 0, F.col("cost")), F.when(F.col("cost") > 0, F.col("rank"))), F.lit(scale)).alias("s"))
    both = near.join(own.select("i", F.col("s").alias("si")), "i").join(own.select(F.col("i").alias("j"), F.col("s").alias("sj")), "j", "left")
    sigma = F.greatest(F.col("si") * F.coalesce("sj", F.lit(scale)), F.lit(1e-8))
    return _united(both.withColumn("affinity", F.exp(-F.col("cost") * F.col("cost") / sigma)), "affinity")


def instances(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(row_idx, niche, instance, name): components of same-label edges, numbered from 0 by label and smallest row.

    ``labels`` is (row_idx, niche) and ``edges`` (row_idx, neighbor) in either or both directions; rows without an edge stand alone.
    """
    of = lambda c: labels.select(F.col("row_idx").alias(c), F.col("niche").alias(f"l{c}"))
    same = edges.select(F.col("row_idx").alias("a"), F.col("neighbor").alias("b")).join(of("a"), "a").join(of("b"), "b").where("la = lb").select("a", "b")
    found = connected_components(same)
    return _named(labels.join(found, labels.row_idx == found.node, "left").select("row_idx", "niche", F.coalesce("component", "row_idx").alias("component")))


def instances_within(cells: DataFrame, radius: float) -> DataFrame:
    """``instances`` of (row_idx, niche, sample_id, x, y) over all pairs of a sample within ``radius``, without a table of edges.

    Rows of one sample and niche in a square of the grid, whose diagonal is below the radius, are linked whatever their number, so
    squares are linked in place of rows: where any two of their points lie within the radius (``neighborhoods.touching``).
    """
    placed, links = neighborhoods.touching(cells, radius)
    found = connected_components(links)
    return _named(placed.join(found, placed.square == found.node, "left").select("row_idx", "niche", F.coalesce("component", "square").alias("component")))


def _named(placed: DataFrame) -> DataFrame:
    """(row_idx, niche, instance, name) of (row_idx, niche, component)."""
    # A row for each component, not each cell, is numbered in one task.
    numbered = placed.select("niche", "component").distinct().select("niche", "component", (F.row_number().over(Window.orderBy("niche", "component")) - 1).alias("instance"), (F.row_number().over(Window.partitionBy("niche").orderBy("component")) - 1).alias("within"))
    return placed.join(numbered, ["niche", "component"]).select("row_idx", "niche", "instance", F.concat(F.lit("ON"), F.col("niche").cast("string"), F.lit("_"), F.col("within").cast("string")).alias("name"))
