"""Sums over the squared distances of all pairs of vectors from the moments of niches: one pass over rows in place of one over pairs.

The sum of |x - y|^2 over the pairs of two sets, and that of its square, are polynomials of both sets' counts, sums and sums of products, so
they are the same numbers without a pair being made.  Rows are taken relative to one row of their niche, which is exact for equal rows and
keeps the digits of tight niches that lie far from 0.

Cases: as ``tiles``; what the driver holds is bounded by ``MOST_NUMBERS``, and ``gathered`` gives None beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that the driver may hold and send to every task.
MOST_NUMBERS = 4_000_000


class Moments:
    """Of niches, in the order of their numbers: how many rows ``n``, a row ``origin`` of each, and sums over rows u relative to it, with
    s = |u|^2: ``u``, ``s``, ``ss`` (s^2), ``su`` (s u) and ``uu`` (u u^T)."""

    def __init__(self, names: np.ndarray, origin: np.ndarray):
        k, d = origin.shape
        self.names, self.origin = names, origin
        self.n, self.s, self.ss = np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
        self.u, self.su, self.uu = np.zeros((k, d)), np.zeros((k, d)), np.zeros((k, d, d))

    def flat(self, c: int) -> np.ndarray:
        return np.concatenate([[self.n[c], self.s[c], self.ss[c]], self.u[c], self.su[c], self.uu[c].ravel()])

    def add(self, c: int, flat: np.ndarray) -> None:
        d = self.origin.shape[1]
        n, s, ss, u, su, uu = np.split(flat, [1, 2, 3, 3 + d, 3 + 2 * d])
        self.n[c] += int(n[0])
        self.s[c] += s[0]
        self.ss[c] += ss[0]
        self.u[c] += u
        self.su[c] += su
        self.uu[c] += uu.reshape(d, d)

    def costs(self) -> np.ndarray:
        """The sums over ordered pairs of each niche's rows."""
        return np.maximum(2 * self.n * self.s - 2 * (self.u**2).sum(1), 0)

    def squares(self) -> np.ndarray:
        """The sums of squares over ordered pairs of each niche's rows."""
        return np.maximum(2 * self.n * self.ss + 2 * self.s**2 + 4 * (self.uu**2).sum((1, 2)) - 8 * (self.su * self.u).sum(1), 0)

    def spread(self) -> tuple[np.ndarray, np.ndarray]:
        """Each niche's mean relative to its origin, and its rows' mean squared distance to it."""
        mean = self.u / self.n[:, None]
        return mean, self.costs() / (2.0 * self.n * self.n)

    def united(self) -> Moments:
        """All niches as one."""
        shift = self.origin - self.origin[:1]
        shift = shift - ((self.n[:, None] * shift + self.u).sum(0) / max(self.n.sum(), 1))
        out = Moments(np.zeros(1, np.int64), np.zeros_like(self.origin[:1]))
        far, along = (shift**2).sum(1), (shift * self.u).sum(1)
        turned = np.einsum("kij,kj->ki", self.uu, shift)
        out.n[0] = self.n.sum()
        out.s[0] = (self.s + 2 * along + self.n * far).sum()
        out.ss[0] = (self.ss + 4 * (shift * turned).sum(1) + self.n * far**2 + 4 * (shift * self.su).sum(1) + 2 * far * self.s + 4 * far * along).sum()
        out.u[0] = (self.u + self.n[:, None] * shift).sum(0)
        out.su[0] = (self.su + 2 * turned + far[:, None] * self.u + shift * (self.s + 2 * along + self.n * far)[:, None]).sum(0)
        outer = shift[:, :, None] * self.u[:, None, :]
        out.uu[0] = (self.uu + outer + outer.swapaxes(1, 2) + self.n[:, None, None] * shift[:, :, None] * shift[:, None, :]).sum(0)
        return out


def rows_of(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(row_idx, z, niche) of the rows that have both."""
    named = labels.where(F.col("niche").isNotNull()).select("row_idx", F.col("niche").cast("long").alias("niche"))
    return vectors.where(F.col("z").isNotNull()).select("row_idx", "z").join(named, "row_idx")


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def gathered(rows: DataFrame) -> Moments | None:
    """The moments of (row_idx, z, niche); None if they hold more than ``MOST_NUMBERS`` numbers, or there are no rows."""
    first = rows.groupBy("niche").agg(F.min_by("z", "row_idx").alias("z"))
    width = first.agg(F.max(F.size("z")).alias("d")).first()["d"] or 0
    most = MOST_NUMBERS // (width * width + 4 * width + 4)
    held = first.limit(most + 1).toArrow().combine_chunks()
    if not 0 < held.num_rows <= most:
        return None
    order = np.argsort(held["niche"].to_numpy())
    names, origin = held["niche"].to_numpy()[order], _matrix(held["z"].combine_chunks(), held.num_rows)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(names, origin)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.searchsorted(names, batch.column("niche").to_numpy())
            z = _matrix(batch.column("z"), batch.num_rows)
            order = np.argsort(at, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                c = at[part[0]]
                u = z[part] - origin[c]
                s = (u * u).sum(1)
                own.add(c, np.concatenate([[len(part), s.sum(), (s * s).sum()], u.sum(0), (s[:, None] * u).sum(0), (u.T @ u).ravel()]))
        some = np.flatnonzero(own.n)
        yield pa.RecordBatch.from_pydict({"c": pa.array(some, pa.int64()), "flat": pa.array([own.flat(c) for c in some], pa.list_(pa.float64()))})

    out = Moments(names, origin)
    made = rows.select("z", "niche").mapInArrow(run, "c long, flat array<double>").select("c", F.posexplode("flat").alias("at", "value"))
    found = made.groupBy("c", "at").agg(F.sum("value").alias("value")).toArrow()  # ``MOST_NUMBERS`` numbers at most
    flat = np.zeros((len(names), 3 + width * (width + 2)))
    flat[found["c"].to_numpy(), found["at"].to_numpy()] = found["value"].to_numpy()
    for c, own in enumerate(flat):
        out.add(c, own)
    return out


def calinski_harabasz(m: Moments) -> float | None:
    """``metrics.calinski_harabasz`` of squared distances."""
    n, k = int(m.n.sum()), len(m.n)
    if not 1 < k < n:
        return None
    within = float((m.squares() / (2 * m.n)).sum())
    between = max(float(m.united().squares()[0]) / (2 * n) - within, 0.0)
    return (between / (k - 1)) / max(within / (n - k), 1e-12)


def within_between(rows: DataFrame, m: Moments) -> float | None:
    """``metrics.within_between`` of squared distances: a distance is 0 between equal vectors only, which are counted."""
    n = int(m.n.sum())
    equal = rows.groupBy("z", "niche").agg(F.count("*").alias("n")).groupBy("z").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    same = equal.agg(F.sum((F.col("n") * F.col("n") - F.col("own")).cast("decimal(38,0)")).alias("same")).first()["same"] or 0
    inner, outer = int((m.n * (m.n - 1)).sum()), n * n - int((m.n * m.n).sum()) - int(same)
    if not inner or not outer:
        return None
    within = float(m.costs().sum())
    between = max(float(m.united().costs()[0]) - within, 0.0) / outer
    return within / inner / max(between, 1e-12)


def niche_sums(rows: DataFrame, m: Moments) -> DataFrame:
    """(i, li, lj, total, n): ``tiles.niche_sums`` of (row_idx, z, niche), by each niche's mean and spread."""
    names, origin, size, (mean, spread) = m.names, m.origin, m.n, m.spread()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, niche, z = batch.column("row_idx").to_numpy(), batch.column("niche").to_numpy(), _matrix(batch.column("z"), batch.num_rows)
            for c in range(len(names)):
                away = (z - origin[c]) - mean[c]
                n = size[c] - (niche == names[c])
                some = n > 0
                total = ((away * away).sum(1) + spread[c]) * size[c]
                yield pa.RecordBatch.from_pydict({"i": ids[some], "li": niche[some], "lj": np.full(some.sum(), names[c]), "total": total[some], "n": n[some]})

    return rows.mapInArrow(run, "i long, li long, lj long, total double, n long")
