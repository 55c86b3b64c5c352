"""What is asked of each row's neighborhood, made where its edges are made, without a table of edges.

The grid is that of ``radius_edges``: the anchors of a cell and the points of the nine cells around meet in one task, in slices of at
most ``MOST`` pairs.  A slice holds whole neighborhoods, so sums, nearest rows and draws end there.  Points are shuffled, at most ten
times each; edges, whose number grows with density, aren't.

Cases: as ``radius_edges``; ids are unique; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichewright.config import ISOLATED, KERNELS, canonical
from nichewright.functions.portable import PRIME, finite, hashed_below, uniform_array
from nichewright.plans.storage import materialise

#: Pairs of a slice; their distances take 8 MB.
MOST = 1 << 20


class Slice:
    """Anchors ``ids`` with the edges (at, neighbor, distance, state), in the order of anchors and neighbors.

    ``dx`` and ``dy`` lead from the anchor to the neighbor.
    """

    def __init__(self, ids: np.ndarray, at: np.ndarray, neighbor: np.ndarray, distance: np.ndarray, state: np.ndarray, dx: np.ndarray, dy: np.ndarray):
        self.ids, self.at, self.neighbor, self.distance, self.state, self.dx, self.dy = ids, at, neighbor, distance, state, dx, dy


def _ranks(*groups: np.ndarray) -> np.ndarray:
    """The place, from 0, of each entry in its run of equal groups."""
    new = np.ones(len(groups[0]), bool)
    new[1:] = np.any([g[1:] != g[:-1] for g in groups], axis=0)
    start = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(start, np.diff([*start, len(new)]))


def weights(distance: np.ndarray, radius: float, kernel: str) -> np.ndarray:
    """``measures.kernel_weight`` of an array."""
    name = canonical(kernel, KERNELS, "kernel")
    if name == "uniform":
        return np.ones_like(distance)
    return 1.0 / np.maximum(distance, 1e-6) if name == "inverse" else np.exp(-0.5 * (distance / (radius / 2)) * (distance / (radius / 2)))


def _met(cells: DataFrame, radius: float, made: Callable[[Slice], dict], schema: str) -> DataFrame:
    """What ``made`` makes of every slice of the points (row_idx, sample_id, x, y[, state][, anchor]); with ``anchor`` only of those where it's true."""
    if not radius > 0:
        raise ValueError("radius must be positive")
    names = [f.split()[0] for f in schema.split(", ")]
    state = F.coalesce(F.col("state"), F.lit(0)).cast("long") if "state" in cells.columns else F.lit(0).cast("long")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    usable = finite(F.col("x")) & finite(F.col("y"))
    wanted = F.col("anchor") if "anchor" in cells.columns else F.lit(True)
    placed = cells.where(usable).select("row_idx", "sample_id", x.alias("x"), y.alias("y"), state.alias("state"), wanted.alias("wanted"), F.floor(x / radius).alias("gx"), F.floor(y / radius).alias("gy"))
    # Points without a place are anchors without neighbors.
    lost = cells.where(~usable).select("row_idx", "sample_id", F.lit(float("nan")).alias("x"), F.lit(float("nan")).alias("y"), F.lit(0).cast("long").alias("state"), wanted.alias("wanted"), F.xxhash64("row_idx").alias("gx"), F.lit(None).cast("long").alias("gy"))
    around = [F.struct((F.col("gx") + dx).alias("gx"), (F.col("gy") + dy).alias("gy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    anchors = placed.unionByName(lost).where("wanted").drop("wanted").withColumn("kind", F.lit(0))
    others = placed.withColumn("cell", F.explode(F.array(*around))).select("row_idx", "sample_id", "x", "y", "state", F.col("cell.gx").alias("gx"), F.col("cell.gy").alias("gy"), F.lit(1).alias("kind"))
    # Equal cells lie together: only a change of sample or cell is asked for, which the sort shows.
    by = ["sample_id", "gx", "gy"]
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = anchors.unionByName(others).repartition(tasks, *by).sortWithinPartitions(*by, "kind", "row_idx")
    kept = dealt.select(F.to_json(F.struct("sample_id")).alias("sample"), F.coalesce("gx", F.lit(0)).alias("gx"), F.coalesce("gy", F.lit(-(1 << 62))).alias("gy"), "kind", "row_idx", "x", "y", "state")

    def cell(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, ids, px, py, of = (rows[c].to_numpy() for c in ("kind", "row_idx", "x", "y", "state"))
        a = int(np.searchsorted(kind, 1))
        near, nx, ny, state = ids[a:], px[a:], py[a:], of[a:]
        step = max(1, MOST // max(len(near), 1))
        for s in range(0, a, step):
            own = slice(s, min(s + step, a))
            distance = np.sqrt((nx - px[own, None]) * (nx - px[own, None]) + (ny - py[own, None]) * (ny - py[own, None]))
            at, j = np.nonzero((distance <= radius) & (near != ids[own, None]))
            found = made(Slice(ids[own], at, near[j], distance[at, j], state[j], nx[j] - px[own][at], ny[j] - py[own][at]))
            yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            sample = batch.column("sample").dictionary_encode()
            key = np.stack([sample.indices.to_numpy(), batch.column("gx").to_numpy(), batch.column("gy").to_numpy()], 1)
            for a, b in itertools.pairwise([0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1).tolist(), batch.num_rows]):
                now = (batch.column("sample")[a].as_py(), *key[a, 1:].tolist())
                if parts and now != last:
                    yield from cell(pa.Table.from_batches(parts))
                    parts = []
                parts.append(batch.slice(a, b - a))
                last = now
        if parts:
            yield from cell(pa.Table.from_batches(parts))

    return kept.mapInArrow(run, schema)


def nearest_within(cells: DataFrame, radius: float, most: int) -> DataFrame:
    """(row_idx, neighbor, distance, rank): the ``most`` nearest neighbors of each row; ties go by id."""

    def made(s: Slice) -> dict:
        order = np.lexsort((s.neighbor, s.distance, s.at))
        rank = _ranks(s.at[order])
        keep = order[rank < most]
        return {"row_idx": s.ids[s.at[keep]], "neighbor": s.neighbor[keep], "distance": s.distance[keep], "rank": (rank[rank < most] + 1).astype(np.int32)}

    return _met(cells, radius, made, "row_idx long, neighbor long, distance double, rank int")


def supports(cells: DataFrame, radius: float, kernel: str, include_anchor: bool = True, isolated: str = "anchor_fallback") -> DataFrame:
    """``measures.assemble`` of all edges within ``radius``, weighted by ``kernel``."""
    if isolated not in ISOLATED:
        raise ValueError(f"unknown isolated policy {isolated!r}")

    def made(s: Slice) -> dict:
        weight = weights(s.distance, radius, kernel)
        own = np.arange(len(s.ids))
        if not include_anchor:
            own = np.flatnonzero(np.bincount(s.at, minlength=len(s.ids)) == 0)
            if len(own) and isolated == "error":
                raise ValueError("a cell has no neighbor and no anchor")
        stand_in = np.full(len(own), -1) if not include_anchor and isolated == "zero_dummy" else s.ids[own]
        at, weight = np.concatenate([own, s.at]), np.concatenate([np.ones(len(own)), weight])
        total = np.bincount(at, weight, len(s.ids))
        return {"row_idx": s.ids[at], "neighbor": np.concatenate([stand_in, s.neighbor]), "distance": np.concatenate([np.zeros(len(own)), s.distance]), "weight": weight, "mass": weight / np.maximum(total, 1e-12)[at]}

    return _met(cells, radius, made, "row_idx long, neighbor long, distance double, weight double, mass double")


def capped(cells: DataFrame, radius: float, most: int, kernel: str = "gaussian", shells: int = 4, seed: int = 1337) -> DataFrame:
    """(row_idx, neighbor, distance, weight): ``measures.cap_neighbors`` of all edges within ``radius``, by ``state`` where the cells have it."""
    if most < 1 or shells < 1:
        raise ValueError("most and shells must be positive")

    def made(s: Slice) -> dict:
        weight = weights(s.distance, radius, kernel)
        race = lambda u, w: -np.log(u) / np.maximum(w, 1e-300)
        key = race(uniform_array(seed, s.ids[s.at], s.neighbor), weight)
        shell = np.floor(np.clip(s.distance / radius, 0, 0.999999) * shells).astype(np.int64)
        stratum = shell * 100_000 + s.state
        # The strata's masses and best draws.
        order = np.lexsort((s.neighbor, key, s.state, shell, s.at))
        best = order[_ranks(s.at[order], shell[order], s.state[order]) == 0]
        group = np.cumsum(_ranks(s.at[order], shell[order], s.state[order]) == 0) - 1
        mass = np.bincount(group, weight[order], len(best)) if len(best) else np.zeros(0)
        drawn = np.lexsort((s.state[best], shell[best], race(uniform_array(seed + 1, s.ids[s.at[best]], stratum[best]), mass), s.at[best]))
        taken = best[drawn[_ranks(s.at[best][drawn]) < most]] if len(best) else best
        turn = np.ones(len(key), np.int8)
        turn[taken] = 0
        picked = np.lexsort((s.neighbor, key, turn, s.at))
        keep = picked[_ranks(s.at[picked]) < most]
        return {"row_idx": s.ids[s.at[keep]], "neighbor": s.neighbor[keep], "distance": s.distance[keep], "weight": weight[keep]}

    return _met(cells, radius, made, "row_idx long, neighbor long, distance double, weight double")


def around(cells: DataFrame, few: DataFrame, radius: float) -> DataFrame:
    """The rows of ``cells`` that the neighborhoods of the bounded table ``few`` (row_idx) may hold, with ``anchor``: whether a row is one of it."""
    few = F.broadcast(few.select("row_idx").distinct())
    marked = cells.join(few.withColumn("anchor", F.lit(True)), "row_idx", "left").withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    ends = cells.join(few, "row_idx", "left_semi").select(F.col("row_idx").alias("q"), F.col("sample_id").alias("qs"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    # A little more than the radius, since places less other places are rounded.
    near = lambda c: F.abs(F.col(c).cast("double") - F.col(f"q{c}").cast("double")) <= radius * (1 + 1e-9)
    return marked.join(F.broadcast(ends), F.col("sample_id").eqNullSafe(F.col("qs")) & ((F.col("row_idx") == F.col("q")) | (near("x") & near("y"))), "left_semi")


def _ordered(s: Slice, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(members, and all places of members relative to their anchors): each anchor's with itself, in the order of ids."""
    own = np.arange(len(s.ids))
    at, zero = np.concatenate([own, s.at]), np.zeros(len(own))
    order = np.lexsort((np.concatenate([s.ids, s.neighbor]), at))
    return np.bincount(at, minlength=len(own)), np.concatenate([zero, s.dx])[order] / radius, np.concatenate([zero, s.dy])[order] / radius


def solved(few: np.ndarray, row: int, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i < j < m, for which row * 48271 + (i * 4096 + j) * 69621 + seed modulo ``PRIME`` is one of ``few``; m * 4097 is below it."""
    v = (few - seed - row % PRIME * 48271) % PRIME * pow(69621, -1, PRIME) % PRIME
    more = np.arange(1 + (m - 1) // 4096)
    i, j = (v // 4096 - more[:, None]).ravel(), (v % 4096 + 4096 * more[:, None]).ravel()
    some = (i >= 0) & (i < j) & (j < m)
    return i[some], j[some]


def drawn_pairs(cells: DataFrame, radius: float, size: int, seed: int = 1337) -> DataFrame:
    """(row_idx, i, j, value, u): of the distances between members i < j of all neighborhoods, relative to the radius, the ``size`` or somewhat
    more with the least hash ``u`` of (row_idx, i * 4096 + j), or all if they are fewer.

    Members are numbered by their ids.  Where few hashes are small enough, the numbers that have them are solved for, and no other pair is
    touched; else all pairs are hashed, in slices.
    """
    counted = _met(cells, radius, lambda s: {"n": [int((m * (m - 1) // 2).sum()) for m in [_ordered(s, radius)[0]]]}, "n long")
    n = int(counted.agg(F.sum(F.col("n").cast("decimal(38,0)"))).first()[0] or 0)
    share = (size + 6 * size**0.5 + 50) / max(n, 1)

    def chosen(share: float) -> DataFrame:
        few = np.array(hashed_below(share), np.int64) if share * PRIME <= 50_000 else None

        def found(row: int, m: int) -> tuple[np.ndarray, np.ndarray]:
            if few is not None and len(few) * (1 + m // 4096) < m * m and m * 4097 < PRIME:
                return solved(few, row, m, seed)
            parts, step = [np.zeros((2, 0), np.int64)], max(1, MOST // m)
            for a in range(0, m, step):
                i, j = np.arange(a, min(a + step, m))[:, None], np.arange(m)
                parts.append(np.stack(np.nonzero((uniform_array(seed, np.array(row), i * 4096 + j) < share) & (i < j))) + [[a], [0]])
            return tuple(np.concatenate(parts, 1))

        def made(s: Slice) -> dict:
            m, x, y = _ordered(s, radius)
            start = np.cumsum(m) - m
            each = [found(int(r), int(k)) for r, k in zip(s.ids, m, strict=True)]
            at = np.repeat(np.arange(len(m)), [len(i) for i, _ in each])
            i, j = (np.concatenate([np.zeros(0, np.int64), *(e[c] for e in each)]) for c in (0, 1))
            p, q = start[at] + i, start[at] + j
            dx, dy = x[p] - x[q], y[p] - y[q]
            return {"row_idx": s.ids[at], "i": i, "j": j, "value": np.sqrt(dx * dx + dy * dy), "u": uniform_array(seed, s.ids[at], i * 4096 + j)}

        return materialise(_met(cells, radius, made, "row_idx long, i long, j long, value double, u double"), "drawn-pairs")

    out = chosen(min(share, 1.0))
    while share < 1 and out.count() < size:
        share *= 8
        out = chosen(min(share, 1.0))
    return out


def _apart(rel: np.ndarray, most: float) -> bool:
    """Whether some of the places ``rel`` aren't reached from the first by steps of a positive length up to ``most``."""
    left, frontier = rel[1:], rel[:1]
    while len(left) and len(frontier):
        reached = np.zeros(len(left), bool)
        for s in range(0, len(frontier), 256):
            diff = left[:, None, :] - frontier[None, s : s + 256]
            d = np.sqrt((diff * diff).sum(-1))
            reached |= ((d > 0) & (d <= most)).any(1)
        left, frontier = left[~reached], left[reached]
    return len(left) > 0


def disconnected(cells: DataFrame, radius: float, fraction: float) -> DataFrame:
    """(row_idx, disconnected): whether the graph of a neighborhood with its anchor, whose edges are at most ``fraction`` of the radius long
    but not of length 0, falls apart; as ``structures.packed_structures`` finds it, without distances among all members.

    Members are put on a grid so fine that those of two squares side by side are joined by an edge.  Where the squares that hold any are
    reached side by side from the anchor's, nothing is apart; other neighborhoods are searched member by member.
    """
    most = max(fraction, 1e-8)
    side = most / 5**0.5 * (1 - 1e-9)
    reach = int(1 / side) + 1
    width = 2 * reach + 3  # with an empty margin

    def made(s: Slice) -> dict:
        x, y = s.dx / radius, s.dy / radius
        count = np.bincount(s.at, minlength=len(s.ids))
        ends = np.cumsum(count)
        apart = (count > 0) & (np.bincount(s.at, s.distance, len(s.ids)) == 0)
        open_ = np.flatnonzero((count > 0) & ~apart)
        # Grids of a few anchors at once, so that they stay small.
        step = max(1, MOST // (width * width))
        for n in range(0, len(open_), step):
            few = open_[n : n + step]
            if width * width > MOST:
                sure = np.zeros(len(few), bool)
            else:
                own = np.concatenate([np.arange(ends[a] - count[a], ends[a]) for a in few])
                held = np.zeros((len(few), width, width), bool)
                held[np.repeat(np.arange(len(few)), count[few]), np.floor(x[own] / side).astype(np.int64) + reach + 1, np.floor(y[own] / side).astype(np.int64) + reach + 1] = True
                held[:, reach + 1, reach + 1] = True
                met = np.zeros_like(held)
                met[:, reach + 1, reach + 1] = True
                size = 0
                while size != (size := int(met.sum())):
                    wider = met.copy()
                    wider[:, 1:] |= met[:, :-1]
                    wider[:, :-1] |= met[:, 1:]
                    wider[:, :, 1:] |= met[:, :, :-1]
                    wider[:, :, :-1] |= met[:, :, 1:]
                    met = wider & held
                sure = (met == held).all((1, 2))
            for a in few[~sure]:
                own = slice(ends[a] - count[a], ends[a])
                rel = np.stack([np.concatenate([[0.0], x[own]]), np.concatenate([[0.0], y[own]])], 1)
                apart[a] = _apart(rel, most)
        return {"row_idx": s.ids, "disconnected": apart}

    return _met(cells, radius, made, "row_idx long, disconnected boolean")


def touching(cells: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """((row_idx, niche, square), (a, b)): each row's square, named by its least row, and the squares of one sample and niche of which two
    points lie within ``radius``.

    A square's sides are two thirds of the radius, so that any two of its points are neighbors, and those of other squares lie at most two
    squares away.  Points are shuffled once for each of up to 24 squares around; a task holds the points of one square and meets
    another's in slices, until a pair is found.  Rows without a place or a niche have a square of their own.
    """
    if not radius > 0:
        raise ValueError("radius must be positive")
    side = radius / 1.5
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    key = ["sample_id", "niche", "gx", "gy"]
    usable = finite(F.col("x")) & finite(F.col("y")) & F.col("niche").isNotNull()
    own = cells.where(usable).select("row_idx", "sample_id", "niche", x.alias("x"), y.alias("y"), F.floor(x / side).alias("gx"), F.floor(y / side).alias("gy"))
    placed = materialise(own.withColumn("square", F.min("row_idx").over(Window.partitionBy(*key))), "squares")
    lost = cells.where(~F.coalesce(usable, F.lit(False))).select("row_idx", "niche", F.col("row_idx").alias("square"))
    squares = materialise(placed.select("square", *key).distinct(), "squares")
    around = [F.struct((F.col("gx") + dx).alias("gx"), (F.col("gy") + dy).alias("gy")) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]
    there = squares.select("sample_id", "niche", F.col("square").alias("a"), F.explode(F.array(*around)).alias("g")).select("a", "sample_id", "niche", "g.gx", "g.gy").alias("l")
    on = F.col("l.sample_id").eqNullSafe(F.col("r.sample_id"))
    for c in key[1:]:
        on &= F.col(f"l.{c}") == F.col(f"r.{c}")
    near = materialise(there.join(squares.alias("r"), on).select("a", F.col("square").alias("b")), "squares")
    points = placed.select("square", "x", "y").distinct()
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = [near.join(points.withColumnRenamed("square", c), c).select("a", "b", F.lit(n).alias("kind"), "x", "y") for n, c in enumerate("ab")]
    dealt = ends[0].unionByName(ends[1]).repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "kind")

    def met(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> bool:
        step = max(1, 4096 // max(len(px), 1))
        for s in range(0, len(qx), step):
            dx, dy = px - qx[s : s + step, None], py - qy[s : s + step, None]
            if (np.sqrt(dx * dx + dy * dy) <= radius).any():
                return True
        return False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, done = None, [], False
        for batch in batches:
            a, b, kind, x, y = (batch.column(c).to_numpy() for c in ("a", "b", "kind", "x", "y"))
            out = []
            cuts = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in itertools.pairwise([0, *cuts.tolist(), len(a)] if len(a) else []):
                if (a[s], b[s]) != last:
                    last, held, done = (a[s], b[s]), [], False
                if not kind[s]:
                    held.append((x[s:e], y[s:e]))
                elif held and not done:
                    held = [tuple(np.concatenate(v) for v in zip(*held, strict=True))]
                    if met(*held[0], x[s:e], y[s:e]):
                        done = True
                        out.append(last)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([int(p[n]) for p in out], pa.int64()) for n in (0, 1)], ["a", "b"])

    return placed.select("row_idx", "niche", "square").unionByName(lost), dealt.mapInArrow(run, "a long, b long")
