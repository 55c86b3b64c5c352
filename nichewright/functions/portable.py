"""Column functions whose results other SQL engines reproduce: keyed uniform numbers, array sums and distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = 2147483647


def _long(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("long")


def uniform(seed: int, i: Column, j: Column | int = 0) -> Column:
    """A number in (0, 1) for (seed, i, j) from BIGINT arithmetic only; ``i`` and ``j`` are non-negative and below 2**31."""
    h = F.pmod(_long(i) * F.lit(48271).cast("long") + _long(j) * F.lit(69621).cast("long") + F.lit(seed).cast("long"), F.lit(PRIME).cast("long"))
    for _ in range(2):
        h = F.pmod(h * h + F.lit(16807).cast("long") * h + F.lit(1).cast("long"), F.lit(PRIME).cast("long"))
    return (h.cast("double") + F.lit(0.5).cast("double")) / F.lit(float(PRIME))


def uniform_array(seed: int, i: np.ndarray, j: np.ndarray | int = 0) -> np.ndarray:
    """The same numbers for arrays of ids."""
    h = (i.astype(np.int64) * 48271 + np.int64(69621) * j + seed) % PRIME
    for _ in range(2):
        h = (h * h + 16807 * h + 1) % PRIME
    return (h + 0.5) / PRIME


def hashed_below(share: float) -> list[int]:
    """All values of i * 48271 + j * 69621 + seed modulo ``PRIME`` whose ``uniform`` number is less than ``share``.

    A round of the hash is a square, which has two roots or none: those of all small numbers are found round by round.
    """
    values, half = [h for h in range(int(share * PRIME) + 1) if (h + 0.5) / PRIME < share], pow(2, -1, PRIME)
    for _ in range(2):
        before = set()
        for h in values:
            square = (16807 * 16807 - 4 * (1 - h)) % PRIME
            root = pow(square, (PRIME + 1) // 4, PRIME)
            if root * root % PRIME == square:
                before |= {(-16807 + root) * half % PRIME, (-16807 - root) * half % PRIME}
        values = sorted(before)
    return values


def uniform_sql(seed: int, i: str, j: str = "0") -> str:
    h = f"((CAST({i} AS BIGINT) * 48271 + CAST({j} AS BIGINT) * 69621 + {seed}) % {PRIME})"
    for _ in range(2):
        h = f"(({h} * {h} + 16807 * {h} + 1) % {PRIME})"
    return f"((CAST({h} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / {PRIME}.0::DOUBLE)"


def least_drawn(rows: DataFrame, draw: str, ties: list[str], size: int, n: int | None = None) -> DataFrame:
    """The ``size`` rows with the least ``draw``, a column of numbers spread over (0, 1), in order; ties go by the further columns.

    The rows are counted first (unless ``n`` is given), so that only those below a threshold are sorted, little more than ``size`` of
    them from all partitions together; if a threshold leaves too few, all rows are.
    """
    n = rows.count() if n is None else n
    share = (size + 6 * size**0.5 + 50) / max(n, 1)
    below = rows.where(F.col(draw) < share) if share < 1 else rows
    if share < 1 and below.limit(size).count() < size:
        below = rows
    return below.orderBy(draw, *ties).limit(size)


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))


def squared_distance_sql(a: str, b: str, dimension: int) -> str:
    return "(" + " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(1, dimension + 1)) + ")"
