"""Exact order statistics over the squared distances of all pairs of vectors, of which few are computed in double precision.

Rows are packed into blocks that are shuffled once a side; a task meets the blocks of two partitions.  Distances are first made in single
precision by one matrix product, with a bound on their error.  That tells for nearly all pairs on which side of what is looked for they lie;
the others are computed as ``tiles`` does.  Each pair of rows is met once.  Neither pairs nor distances are written.

Cases: as ``tiles``; vectors hold finite numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichewright.functions.portable import least_drawn, uniform
from nichewright.operators import tiles, transport
from nichewright.plans.storage import materialise

#: Rows of a block, and blocks at least where they have rows enough.
BLOCK, LEAST_BLOCKS = 4096, 16
#: Distances that are made at once, which a core's cache holds.
PART = 1 << 18
#: Rows whose distances give the first guess of a percentile, and how far from it in rank the percentile is looked for at first.
SAMPLE, NEAR = 4096, 0.005
#: Bins of a pass over all pairs, and distances that the driver may get of one percentile.
BINS, FEW = 1 << 14, 1 << 18


class Side:
    """A block: ``ids`` in ascending order, vectors ``z``, and ``extra`` numbers of each row."""

    def __init__(self, struct: pa.StructScalar, centre: np.ndarray):
        get = lambda name: struct[name].values.to_numpy(zero_copy_only=False)
        self.ids = get("ids")
        self.z = get("z").reshape(len(self.ids), -1)
        self.extra = get("extra").reshape(len(self.ids), -1)
        self.centred = self.z - centre
        self.square = (self.centred**2).sum(1)
        with np.errstate(over="ignore"):
            self.length = float(np.sqrt(self.square.max()))


def paired(rows: DataFrame, n: int) -> DataFrame:
    """(left, right) for each pair of blocks of the ``n`` rows (row_idx, z, extra), each block with itself too."""
    blocks = max(-(-n // BLOCK), min(LEAST_BLOCKS, -(-n // 256)), 1)
    held = rows.select(F.pmod(F.xxhash64("row_idx"), F.lit(blocks)).alias("block"), F.struct("row_idx", "z", "extra").alias("s")).groupBy("block").agg(F.array_sort(F.collect_list("s"), lambda a, b: F.when(a["row_idx"] < b["row_idx"], -1).otherwise(1)).alias("s"))
    held = held.select("block", F.col("s.row_idx").alias("ids"), F.flatten("s.z").alias("z"), F.flatten("s.extra").alias("extra"))
    # Few blocks are done sooner than many tasks are started.
    return transport._pairs(held, held, blocks, blocks, True, tasks=1 if blocks <= LEAST_BLOCKS else 10)


def centre_of(rows: DataFrame) -> np.ndarray:
    """A vector near the others."""
    found = rows.select(F.posexplode("z").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("v")).orderBy("at").collect()  # a row for each dimension
    return np.array([r.v for r in found])


def _met(x: Side, y: Side, more: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[slice, np.ndarray, float]]:
    """(some rows of ``x``, their distances to those of ``y`` in single precision, a bound on the error); ``more`` is added to them."""
    a, b = more or (np.zeros(len(x.ids)), np.zeros(len(y.ids)))
    with np.errstate(over="ignore", invalid="ignore"):
        left = np.concatenate([-2 * x.centred, (x.square + a)[:, None], np.ones((len(a), 1))], 1).astype(np.float32)
        right = np.concatenate([y.centred, np.ones((len(b), 1)), (y.square + b)[:, None]], 1).astype(np.float32).T.copy()
        bound = (x.z.shape[1] + 8) * 2.0**-22 * ((x.length + y.length) ** 2 + a.max() + b.max())
        step = max(1, PART // len(b))
        for s in range(0, len(a), step):
            yield slice(s, s + step), left[s : s + step] @ right, bound


def _exact(x: Side, y: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of some pairs, summed from the first component to the last."""
    out = np.zeros(len(i))
    for k in range(x.z.shape[1]):
        diff = x.z[i, k] - y.z[j, k]
        out += np.multiply(diff, diff, out=diff)
    return out


class Target:
    """Distances of labelling ``of`` within niches (side 1) or between them (0) whose bits are in [low, high]."""

    def __init__(self, of: int, side: int, low: int, high: int, collect: bool):
        self.of, self.side, self.low, self.high, self.collect = of, side, low, high, collect
        self.shift = max(0, (high - low).bit_length() - BINS.bit_length() + 1)


def _value(bits: int) -> float:
    return float(np.array([bits], np.int64).view(np.float64)[0])


def _bits(value: float) -> int:
    return int((np.array([value]) + 0.0).view(np.int64)[0])


def _counted(rows: DataFrame, count: int, centre: np.ndarray, targets: list[Target]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each target how many distances lie below it, and its bins and their counts, or distances and how often each was met."""

    def found(x: Side, y: Side, below: list[int], counts: list[np.ndarray], values: list[list[np.ndarray]]) -> None:
        codes = []
        for c in range(x.extra.shape[1]):
            _, code = np.unique(np.concatenate([x.extra[:, c], y.extra[:, c]]), return_inverse=True)
            code = code.astype(np.int16 if code.max() < 1 << 15 else np.int32)
            codes.append((code[: len(x.ids)], code[len(x.ids) :]))
        alone = x.ids[0] == y.ids[0]
        for at, near, bound in _met(x, y):
            upper = x.ids[at, None] < y.ids[None, :] if alone else None
            same: dict[int, np.ndarray] = {}
            for n, t in enumerate(targets):
                if t.of not in same:
                    same[t.of] = codes[t.of][0][at, None] == codes[t.of][1][None, :]
                mask = same[t.of] if t.side else ~same[t.of]
                mask = mask if upper is None else mask & upper
                low = np.float32(np.nextafter(np.float32(_value(t.low) - bound), np.float32(-np.inf)))
                high = np.float32(np.nextafter(np.float32(_value(t.high) + bound), np.float32(np.inf)))
                sure = near < low
                sure &= mask
                below[n] += int(np.count_nonzero(sure))
                # What isn't told to be above, whatever single precision made of it.
                maybe = near > high
                np.logical_not(maybe, out=maybe)
                maybe &= mask
                maybe ^= sure
                i, j = np.divmod(np.flatnonzero(maybe), near.shape[1])
                for s in range(0, len(i), 1 << 20):
                    part = slice(s, s + (1 << 20))
                    bits = (_exact(x, y, i[part] + at.start, j[part]) + 0.0).view(np.int64)
                    below[n] += int(np.count_nonzero(bits < t.low))
                    bits = bits[(bits >= t.low) & (bits <= t.high)]
                    if t.collect:
                        values[n].append(bits)
                    else:
                        counts[n] += np.bincount((bits - t.low) >> t.shift, minlength=len(counts[n]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, values = [0] * len(targets), [[] for _ in targets]
        counts = [np.zeros(0 if t.collect else ((t.high - t.low) >> t.shift) + 1, np.int64) for t in targets]
        for batch in batches:
            for a, b in zip(batch.column("left"), batch.column("right"), strict=True):
                found(Side(a, centre), Side(b, centre), below, counts, values)
        for n, t in enumerate(targets):
            if t.collect:
                at, many = np.unique(np.concatenate([np.zeros(0, np.int64), *values[n]]), return_counts=True)
            else:
                at = np.flatnonzero(counts[n])
                many = counts[n][at]
            at, many = np.concatenate([[-1], at]), np.concatenate([[below[n]], many])
            yield pa.RecordBatch.from_pydict({"target": pa.array(np.full(len(at), n), pa.int32()), "at": pa.array(at, pa.int64()), "n": pa.array(many, pa.int64())})

    made = paired(rows, count).mapInArrow(run, "target int, at long, n long").groupBy("target", "at").agg(F.sum("n").alias("n")).toArrow()
    target, at, many = (made[c].to_numpy() for c in ("target", "at", "n"))
    out = {}
    for n in range(len(targets)):
        own = np.flatnonzero(target == n)
        own = own[np.argsort(at[own])]
        out[n] = (int(many[own[0]]) if len(own) else 0, at[own[1:]], many[own[1:]])
    return out


def percentiles(vectors: DataFrame, labels: DataFrame, wanted: dict[int, float], names: tuple[str, ...] = ("niche",)) -> list[dict[int, float | None]]:
    """For each labelling ``names`` of ``labels`` (row_idx, names) the exact percentiles, interpolated between ranks, of the distances between
    (0) and within its niches (1); None without any.

    A sample of rows tells where a percentile should lie.  A pass over all pairs counts those below, and those there by bins of their bits;
    a rank that proves to lie elsewhere is looked for there.  Once few distances are left they are fetched.  Rows with a number that isn't
    finite go by ``tiles.percentiles``.
    """
    columns = [F.col(n).cast("long") for n in names]
    known = labels.where(F.col(names[0]).isNotNull()).select("row_idx", F.array(*columns).alias("extra"))
    rows = materialise(vectors.where(F.col("z").isNotNull()).select("row_idx", "z").join(known, "row_idx"), "rank-rows")
    odd = F.exists("z", lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    if not rows.where(odd).isEmpty():
        return [tiles.percentiles(vectors, labels.select("row_idx", F.col(n).alias("niche")), wanted) for n in names]
    n, inner = rows.count(), []
    if n < 2:
        return [dict.fromkeys(wanted) for _ in names]
    for c in range(len(names)):
        sizes = rows.groupBy(F.col("extra")[c].alias("c")).count()
        inner.append(int(sizes.agg(F.sum((F.col("count") * (F.col("count") - 1) / 2).cast("decimal(38,0)"))).first()[0] or 0))
    size = {(c, s): inner[c] if s else n * (n - 1) // 2 - inner[c] for c in range(len(names)) for s in wanted}
    # Each rank that is looked for, with the bits it lies between, if that has been proven, and its place among them.
    ranks = {}
    for (c, s), many in size.items():
        if many:
            place = wanted[s] * (many - 1)
            ranks |= {(c, s, int(np.floor(place))): None, (c, s, int(np.ceil(place))): None}
    centre = centre_of(rows)
    drawn = least_drawn(rows.withColumn("u", uniform(1337, F.abs("row_idx"))), "u", ["row_idx"], SAMPLE, n).select("z", "extra").toArrow()
    z, extra = (drawn[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(drawn.num_rows, -1) for c in ("z", "extra"))
    i, j = np.triu_indices(len(z), 1)
    guess = np.zeros(len(i))
    for k in range(z.shape[1]):
        guess += (z[i, k] - z[j, k]) ** 2
    seen = {(c, s): np.sort(guess[(extra[i, c] == extra[j, c]) == bool(s)]) for c, s in size}
    top, away = _bits(math.inf), NEAR
    value: dict[tuple[int, int, int], float] = {}
    span: dict[tuple[int, int, int], tuple[int, int]] = {}
    for c, s, r in ranks:
        some = seen[c, s]
        low, high = (wanted[s] - away) * len(some), (wanted[s] + away) * len(some)
        sure = len(some) < 1000
        span[c, s, r] = (0 if sure or low < 1 else _bits(some[int(low)]), top if sure or high >= len(some) - 1 else _bits(some[int(high)]))
    held = {key: size[key[:2]] for key in ranks}  # how many distances there may be between the bounds
    while span:
        spots = sorted({(c, s, *span[c, s, r], held[c, s, r] <= FEW) for c, s, r in span})
        targets = [Target(*spot) for spot in spots]
        found = _counted(rows, n, centre, targets)
        for key in list(span):
            c, s, r = key
            at = spots.index((c, s, *span[key], held[key] <= FEW))
            t, (below, bins, many) = targets[at], found[at]
            upto = below + np.cumsum(many)
            if r < below:
                span[key], held[key] = (0, t.low - 1), below
            elif not len(upto) or r >= upto[-1]:
                span[key], held[key] = (t.high + 1, top), size[c, s] - (int(upto[-1]) if len(upto) else below)
            else:
                place = int(np.searchsorted(upto, r, side="right"))
                if t.collect or not t.shift:
                    value[key] = _value(int(bins[place]) + (0 if t.collect else t.low))
                    del span[key]
                else:
                    low = t.low + (int(bins[place]) << t.shift)
                    span[key], held[key] = (low, min(low + (1 << t.shift) - 1, t.high)), int(many[place])
    out = []
    for c in range(len(names)):
        got: dict[int, float | None] = {}
        for s, share in wanted.items():
            if not size[c, s]:
                got[s] = None
                continue
            place = share * (size[c, s] - 1)
            low, part = int(np.floor(place)), place - np.floor(place)
            got[s] = value[c, s, low] if low == place else (1 - part) * value[c, s, low] + part * value[c, s, low + 1]
        out.append(got)
    return out


def nearest_clusters(clusters: DataFrame, n: int, centre: np.ndarray) -> DataFrame:
    """(i, j, cost): each one's nearest of the ``n`` clusters (row_idx, z, spread), by the squared distance of their centres plus both spreads.

    ``centre`` is a vector near theirs, as ``centre_of`` finds it.  Ties go by id.
    """
    split = clusters.select("row_idx", "z", F.array("spread").alias("extra"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # of each block its rows, their nearest and its distance
        for batch in batches:
            for a, b in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = Side(a, centre), Side(b, centre)
                alone = x.ids[0] == y.ids[0]
                for side in (x, y):
                    if int(side.ids[0]) not in best:
                        best[int(side.ids[0])] = (side.ids, np.full(len(side.ids), np.iinfo(np.int64).max), np.full(len(side.ids), np.inf))
                p, q = x.extra[:, 0], y.extra[:, 0]
                _, of_x, d_x = best[int(x.ids[0])]
                _, of_y, d_y = best[int(y.ids[0])]
                for at, near, bound in _met(x, y, (p, q)):
                    if alone:
                        near[np.arange(near.shape[0]), np.arange(at.start, at.start + near.shape[0])] = np.inf
                    # What is farther than another by more than both errors, or than the nearest so far, is no one's nearest.
                    row = np.minimum(near.min(1).astype(float) + 2 * bound, d_x[at] + bound)
                    wider = lambda v: np.nextafter(v.astype(np.float32), np.float32(np.inf))
                    maybe = near > wider(row)[:, None]
                    if not alone:
                        maybe &= near > wider(np.minimum(near.min(0).astype(float) + 2 * bound, d_y + bound))[None, :]
                    np.logical_not(maybe, out=maybe)
                    i, j = np.divmod(np.flatnonzero(maybe), near.shape[1])
                    i += at.start
                    if alone:
                        i, j = i[i != j], j[i != j]
                    for s in range(0, len(i), 1 << 20):
                        m, k = i[s : s + (1 << 20)], j[s : s + (1 << 20)]
                        cost = _exact(x, y, m, k) + (p[m] + q[k])
                        _keep(d_x, of_x, m, cost, y.ids[k])
                        if not alone:
                            _keep(d_y, of_y, k, cost, x.ids[m])
        for ids, of, cost in best.values():
            some = cost < np.inf
            yield pa.RecordBatch.from_pydict({"i": ids[some], "j": of[some], "cost": cost[some]})

    made = paired(split, n).mapInArrow(run, "i long, j long, cost double")
    return made.groupBy("i").agg(F.min(F.struct("cost", "j")).alias("b")).select("i", F.col("b.j").alias("j"), F.col("b.cost").alias("cost"))


def _keep(cost: np.ndarray, of: np.ndarray, at: np.ndarray, new: np.ndarray, ids: np.ndarray) -> None:
    """Takes in distances ``new`` of the rows ``at`` to ``ids`` where they are less, by (distance, id)."""
    order = np.lexsort((ids, new, at))
    at, new, ids = at[order], new[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 0])) if len(at) else np.zeros(0, np.int64)
    at, new, ids = at[first], new[first], ids[first]
    less = (new < cost[at]) | ((new == cost[at]) & (ids < of[at]))
    cost[at[less]], of[at[less]] = new[less], ids[less]
