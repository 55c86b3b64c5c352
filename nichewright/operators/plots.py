"""Tables that plots are made of: counts of niches by tiles of several sizes, so that a view of any width draws few marks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichewright.functions.portable import finite
from nichewright.plans.storage import materialise


def niche_grid(cells: DataFrame, size: float, levels: int = 6, niche: str = "niche") -> DataFrame:
    """(level, sample_id, tx, ty, niche, cells) of (sample_id, x, y, niche): level 0 has tiles of ``size``, each further one twice as wide.

    The cells are counted once, for the finest tiles; each level is summed from the one before.  A tile (tx, ty) starts at tx and ty
    times its width.  Cells with a coordinate that is null or not finite are left out, a null niche is one of its own, and an
    empty table gives none.
    """
    if not size > 0 or levels < 1:
        raise ValueError("size and levels must be positive")
    tile = lambda c: F.floor(F.col(c) / F.lit(float(size))).alias(f"t{c}")
    kept = cells.where(finite(F.col("x").cast("double")) & finite(F.col("y").cast("double")))
    finest = kept.select("sample_id", tile("x"), tile("y"), F.col(niche).alias("niche")).groupBy("sample_id", "tx", "ty", "niche").agg(F.count("*").alias("cells"))
    made = [materialise(finest, "grid")]
    for _ in range(levels - 1):
        half = lambda c: F.shiftright(c, 1).alias(c)
        coarser = made[-1].select("sample_id", half("tx"), half("ty"), "niche", "cells").groupBy("sample_id", "tx", "ty", "niche").agg(F.sum("cells").alias("cells"))
        made.append(materialise(coarser, "grid"))
    return reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("level"), "sample_id", "tx", "ty", "niche", "cells") for n, df in enumerate(made)))


def commonest(grid: DataFrame) -> DataFrame:
    """(level, sample_id, tx, ty, niche, cells, share): each tile's most frequent niche, ties to the smaller, and its share of the tile."""
    best = F.max(F.struct("cells", (-F.col("niche")).alias("n")))
    tiles = grid.groupBy("level", "sample_id", "tx", "ty").agg(best.alias("best"), F.sum("cells").alias("all"))
    return tiles.select("level", "sample_id", "tx", "ty", (-F.col("best.n")).alias("niche"), F.col("best.cells").alias("cells"), (F.col("best.cells") / F.col("all")).alias("share"))
