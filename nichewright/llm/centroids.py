"""Centroid clustering in exact integers, by Exponion search.

Every vector keeps, besides its centroid, an upper bound on the distance to it and a lower bound on the distance to any other.
Where the upper bound is below the lower one, or below half the way to the centroid's nearest neighbour, nothing is computed.
Otherwise the distance to the own centroid is taken anew, and if it still doesn't decide, only the centroids in a ball around the own
one are scanned: with ``u`` the distance to it and ``s`` that to its nearest neighbour, the nearest and the second nearest lie no
farther from it than ``2 u + s``.  The radius is inclusive, so that ties are seen and go to the smaller number.  Each centroid has
the others in a list sorted by distance; a scan takes its first 1, 2, 4, ... entries, the fewest that cover the ball.  When centroids
move, the bounds move by as much.

Components are integers, ``floor(factor * x)``, and distances are squared integers, so that results depend neither on partitions nor
on the order of sums.  Bounds are doubles with a margin that only makes more scans.

Scale: a round is one pass over the table of vectors and bounds, which is written to the shared folder, and sums over the rows that
changed their centroid only, combined before the shuffle.  The driver holds the centroids and their sums, k times the dimension.

Cases: vectors that are null, of another length than ``dimension``, or hold a null or non-finite component get no row; scaled
components are clamped to +-2^27, so that any squared distance of up to 128 dimensions fits a long; equal ids and equal vectors are
rows of their own; a row with a null id starts no centroid unless too few others do; fewer vectors than ``k`` make fewer centroids;
an inertia beyond a long is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichewright.llm.shared import materialise

#: Scaled components stay within this, and below the second one squared distances are exact in doubles.
MOST, EXACT = 1 << 27, 1 << 21
MARGIN = 1e-9
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``y``, both integers."""
    if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) * max(1, x.shape[1]) ** 0.5 < 8 * EXACT:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in y], 1)


class Exponion:
    """The centroids of a round, their sorted neighbour lists, and how far each moved since the round before."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids, k = centroids, len(centroids)
        apart = np.sqrt(squared(centroids, centroids).astype(np.float64))
        np.fill_diagonal(apart, -1.0)  # a centroid leads its own list, equal ones follow by number
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)
        self.nearest = self.apart[:, 1] if k > 1 else np.full(k, np.inf)
        self.sizes = np.unique([*(1 << p for p in range(k.bit_length()) if 1 << p < k), k])
        self.moved = np.zeros(k) if before is None else np.sqrt(((centroids - before).astype(np.float64) ** 2).sum(1))
        self.scanned = 0

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, upper, lower) after this round, from those of the one before."""
        own, upper = own.copy(), upper + self.moved[own]
        first = int(self.moved.argmax())
        others = np.partition(np.delete(self.moved, first), -1)[-1] if len(self.moved) > 1 else 0.0
        lower = lower - np.where(own == first, others, self.moved[first])
        at = np.flatnonzero(~self._sure(own, upper, lower))
        upper[at] = np.sqrt(((x[at] - self.centroids[own[at]]) ** 2).sum(1).astype(np.float64))
        at = at[~self._sure(own[at], upper[at], lower[at])]
        radius = (2 * upper[at] + self.nearest[own[at]]) * (1 + MARGIN) + MARGIN
        for c in np.unique(own[at]):
            rows, inside = at[own[at] == c], np.searchsorted(self.apart[c], radius[own[at] == c], side="right")
            ball = self.sizes[np.searchsorted(self.sizes, inside)]
            for size in np.unique(ball):
                some, near = rows[ball == size], np.sort(self.order[c][:size])
                d = squared(x[some], self.centroids[near])
                self.scanned += d.size
                best = d.argmin(1)  # the first of equal ones, which has the smallest number
                own[some], upper[some] = near[best], np.sqrt(d.min(1).astype(np.float64))
                lower[some] = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) if size > 1 else np.inf
        return own, upper, lower

    def _sure(self, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        return upper * (1 + MARGIN) + MARGIN < np.maximum(lower, self.nearest[own] / 2)


def scaled(vectors: DataFrame, vector: Column, dimension: int, factor: float) -> DataFrame:
    """(vec_id, v) of the rows that take part, ``v`` as integers."""
    rows = vectors.select("vec_id", vector.cast("array<double>").alias("v")).where(F.size("v") == dimension)
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.floor(F.greatest(F.least(c * F.lit(float(factor)), F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int")
    return rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("v", whole).alias("v"))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.int64)


def _assigned(state: DataFrame, search: Exponion, dimension: int, last: bool) -> DataFrame:
    """The state after a round: ``was`` has the centroid before; the last round leaves (vec_id, cluster, distance) only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                rows = batch.slice(start, 8192)
                x = _matrix(rows.column("v"), dimension)
                was = rows.column("cluster").to_numpy()
                upper, lower = (rows.column(c).to_numpy() for c in ("upper", "lower"))
                own, upper, lower = search.assign(x, np.maximum(was, 0), upper, lower)
                ids, cluster = rows.column("vec_id"), pa.array(own.astype(np.int32))
                if last:
                    yield pa.RecordBatch.from_arrays([ids, cluster, pa.array(((x - search.centroids[own]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, rows.column("v"), cluster, pa.array(was), pa.array(own != was), pa.array(upper), pa.array(lower)], ["vec_id", "v", "cluster", "was", "moved", "upper", "lower"])

    kept = "vec_id long, cluster int, distance long" if last else "vec_id long, v array<int>, cluster int, was int, moved boolean, upper double, lower double"
    return state.mapInArrow(run, kept)


def _changes(state: DataFrame, dimension: int) -> list:
    """(cluster, n, s): by how much the number of rows and their sums changed, at most k rows."""
    side = lambda cluster, sign: F.struct(F.col(cluster).alias("cluster"), F.lit(sign).cast("long").alias("sign"))
    moved = state.where("moved").select("v", F.explode(F.array(side("cluster", 1), side("was", -1))).alias("side")).where("side.cluster >= 0")
    sums = F.array(*(F.sum(F.col("side.sign") * F.col("v")[i]) for i in range(dimension)))
    return moved.groupBy("side.cluster").agg(F.sum("side.sign").alias("n"), sums.alias("s")).collect()


def exponion_clusters(vectors: DataFrame, vector: Column, k: int = 40, rounds: int = 5, dimension: int = 64, factor: float = 256.0, salt: str = "2:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that takes part.

    Centroids start as the vectors with the ``k`` smallest SHA-256 of ``salt`` and id; each round assigns every vector to the nearest
    centroid and puts every non-empty one at the floor of its vectors' mean; then vectors are assigned once more.
    """
    spark = vectors.sparkSession
    kept = materialise(scaled(vectors, vector, dimension, factor), "cluster-vectors")
    draw = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    start = kept.select(draw.alias("draw"), "v").orderBy(F.asc_nulls_last("draw"), "v").limit(k).collect()  # k rows
    if not start:
        return spark.createDataFrame([], RESULT)
    centroids = np.array([r.v for r in start], np.int64)
    total, size = np.zeros(centroids.shape, object), np.zeros(len(start), object)
    state = kept.withColumns({"cluster": F.lit(-1), "upper": F.lit(float("inf")), "lower": F.lit(0.0)})
    before = None
    for _ in range(rounds):
        state = materialise(_assigned(state, Exponion(centroids, before), dimension, last=False), "cluster-round")
        for r in _changes(state, dimension):
            size[r.cluster] += r.n
            total[r.cluster] += np.array(r.s, object)
        before, centroids = centroids, np.array([[int(t) // int(n) for t in row] if n else old for row, n, old in zip(total, size, centroids.tolist(), strict=True)], np.int64)
        if (before == centroids).all():
            break
    final = materialise(_assigned(state, Exponion(centroids, before), dimension, last=True), "clusters")
    inertia = {r.cluster: int(r.inertia) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("inertia")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    rows = [(c, fits(inertia[c]), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(inertia)]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 40, rounds: int = 5, dimension: int = 64) -> str:
    """The rounds unrolled, every vector against every centroid."""
    out = [
        f"kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: CAST(floor(256 * e::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dimension} AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e))))",
        "x AS MATERIALIZED (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS v FROM kept)",
        f"start AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, r FROM kept QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, v FROM start JOIN x USING (r))",
    ]
    for n in range(rounds + 1):
        out.append(f"d{n} AS (SELECT r, c, CAST(SUM((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d FROM x JOIN c{n} c USING (i) GROUP BY r, c)")
        out.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY r)")
        if n < rounds:
            out.append(f"s{n} AS (SELECT a.c, i, CAST(SUM(v) AS BIGINT) AS s, COUNT(*) AS n FROM x JOIN a{n} a USING (r) GROUP BY 1, 2)")
            out.append(f"c{n + 1} AS MATERIALIZED (SELECT c.c, c.i, COALESCE((s - ((s % n) + n) % n) // n, c.v) AS v FROM c{n} c LEFT JOIN s{n} s USING (c, i))")
    own = f"h AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)"
    return f"WITH {', '.join([*out, own])} SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(SUM(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(SUM(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM kept JOIN a{rounds} USING (r) JOIN h USING (c)"
