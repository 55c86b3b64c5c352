"""All-pairs and query-to-reference transport distances over packed measures, and the guards that run before them.

Rows are grouped into blocks by a hash of their id.  Blocks are dealt to partitions and shuffled once; a task fetches two partitions, and
computes the pairs of their blocks in NumPy.  A pair is computed once, from the smaller id to the larger, since a fixed number of sweeps
isn't symmetric; results so don't depend on blocks or partitions.

Cases: a measure has one token at least, and its masses and tokens hold no nulls; equal measures have the costs that their plans
have; ids are taken to be unique; fewer than two rows give no pairs, an empty table none; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichewright.config import DISTANCES, canonical
from nichewright.functions import kernels
from nichewright.functions.portable import least_drawn, squared_distance, uniform

#: Elements of the largest array a task makes at once: half a megabyte, which a core's cache holds.
BATCH = 1 << 16
#: Blocks of a partition, on average at most: a task gets the pairs of two partitions.
MOST_BLOCKS = 8
#: Widths of supports are rounded up to a multiple of this for grouping pairs.
STEP = 4
#: The weight of the squared distance of two cells' own vectors, and the vectors (row_idx, z) of both sides; None: the first ones again.
Anchors = tuple[float, DataFrame, DataFrame | None]


def pairwise_work(n: int, support: int, sweeps: int, rounds: int = 0) -> dict[str, int]:
    """Pairs, elements of all costs and units of work; with ``rounds`` also those of the structures."""
    pairs = n * (n + 1) // 2
    return _work(pairs, support, support, sweeps, rounds)


def cross_work(n_query: int, n_reference: int, support_query: int, support_reference: int, sweeps: int, rounds: int = 0) -> dict[str, int]:
    return _work(n_query * n_reference, support_query, support_reference, sweeps, rounds)


def _work(pairs: int, la: int, lb: int, sweeps: int, rounds: int) -> dict[str, int]:
    work = pairs * la * lb * sweeps
    if not rounds:
        return {"pairs": pairs, "elements": pairs * la * lb, "work": work}
    structure = pairs * rounds * la * lb * max(la, lb)
    return {"pairs": pairs, "elements": pairs * la * lb, "structure_work": structure, "sinkhorn_work": work * rounds, "work": structure + work * rounds}


def block_size(support: int, requested: int, memory_gib: float | None = None, fgw: bool = False) -> int:
    """Rows a block may have: as requested, but no more than its live arrays leave room for in ``memory_gib``."""
    if memory_gib is None:
        return max(requested, 1)
    most = max(1, int(math.sqrt(memory_gib * 1024**3 / ((12 if fgw else 4) * support * support * 4))))
    return most if requested <= 0 else max(1, min(requested, most))


def planned(sizes: DataFrame, sweeps: int, rounds: int = 0, block: int = 0, memory_gib: float = 1.0) -> DataFrame:
    """The rows (sample_id, n, support) with what all pairs of each sample would take: pairs, work (as ``pairwise_work``) and block size."""
    n, m = F.col("n").cast("long"), F.col("support").cast("long")
    pairs = F.floor(n * (n + 1) / 2)
    sinkhorn = pairs * m * m * (sweeps * max(rounds, 1))
    structure = pairs * m * m * m * rounds
    most = F.greatest(F.lit(1), F.floor(F.sqrt(F.lit(memory_gib * 1024**3) / ((12 if rounds else 4) * m * m * 4))))
    held = most if block <= 0 else F.least(F.lit(block).cast("long"), most)
    return sizes.select("sample_id", n.alias("n"), m.alias("support"), pairs.alias("pairs"), structure.alias("structure_work"), sinkhorn.alias("sinkhorn_work"), (structure + sinkhorn).alias("work"), held.alias("block"))


def feasibility(n: int, support: int, sweeps: int, rounds: int, pairs_per_second: float) -> dict[str, float]:
    """What an exact run would take: work, size of the dense result and days at a given rate."""
    work = pairwise_work(n, support, sweeps, rounds)
    return work | {"dense_tib": n * n * 4 / 1024**4, "days": work["pairs"] / pairs_per_second / 86400}


def admit(work: dict[str, int], most_work: float, rows: int | None = None, most_rows: int | None = None, force: bool = False) -> None:
    """Raises ValueError before any job if a run is larger than allowed and not forced."""
    if force:
        return
    if rows is not None and most_rows is not None and rows > most_rows:
        raise ValueError(f"{rows} cells are more than the {most_rows} of an exact run; use landmarks, or force it")
    if work["work"] > most_work:
        raise ValueError(f"{work['work']:.3g} units of work are more than the {most_work:.3g} allowed; use landmarks, or force it")


def _blocks(packed: DataFrame, blocks: int, structure: bool, anchored: bool = False) -> DataFrame:
    columns = ["row_idx", "m", "masses", "tokens"] + ["structure"] * structure
    vectors = ["z"] * anchored
    grouped = packed.select(F.pmod(F.xxhash64("row_idx"), F.lit(blocks)).alias("block"), F.struct(*columns, *vectors).alias("s")).groupBy("block").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return grouped.select("block", F.col("s.row_idx").alias("ids"), F.col("s.m").alias("ms"), *(F.flatten(f"s.{c}").alias(c) for c in columns[2:]), *(F.col(f"s.{c}").alias(c) for c in vectors))


def fingerprint(packed: DataFrame) -> str:
    """What tells one table of measures from another, whatever the order of its rows."""
    columns = [F.col(c) for c in ("row_idx", "m", "masses", "tokens", "structure") if c in packed.columns]
    row = packed.agg(F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)")).alias(f"h{salt}") for salt in (1, 2))).first()
    return f"{row.n}:{row.h1 or 0}:{row.h2 or 0}"


def _parts(n_left: int, n_right: int, least: int) -> tuple[int, int]:
    """Partitions of both sides: ``MOST_BLOCKS`` blocks in each at most, and ``least`` pairs of partitions where there are as many blocks."""
    side = math.ceil(math.sqrt(least))
    few = lambda n, at: min(n, max(-(-n // MOST_BLOCKS), at))
    p, q = few(n_left, side), few(n_right, side)
    return few(n_left, -(-least // q)) if q < side else p, few(n_right, -(-least // p)) if p < side else q


def _pairs(left: DataFrame, right: DataFrame, n_left: int, n_right: int, triangle: bool, share: tuple[int, int] | None = None, tasks: int = 10) -> DataFrame:
    # A pair takes long and its rows are few, so tasks go by the number of pairs; by size they would be too few to share out evenly.
    p_left, p_right = _parts(n_left, n_right, tasks * left.sparkSession.sparkContext.defaultParallelism)
    # Every pair of partitions is a task that fetches both, so that no block is written more than once a side, however many it meets.
    lefts = left.repartition(p_left).select(F.col("block").alias("a"), F.struct(*left.columns[1:]).alias("left"))
    rights = right.repartition(p_right).select(F.col("block").alias("b"), F.struct(*right.columns[1:]).alias("right"))
    met = F.lit(True)
    if triangle:
        met &= F.col("a") >= F.col("b")
    if share:
        met &= F.pmod(F.col("a") + F.col("b"), F.lit(share[1])) == share[0]
    return lefts.hint("shuffle_replicate_nl").crossJoin(rights).where(met).select("left", "right")


class _Side:
    """A block's measures, padded."""

    def __init__(self, struct: pa.StructScalar):
        get = lambda name: struct[name].values.to_numpy(zero_copy_only=False)
        self.ids, m = get("ids"), get("ms").astype(np.int64)
        n, width, self.size = len(m), int(m.max()), m
        flat = get("tokens").reshape(int(m.sum()), -1)
        row, place = np.repeat(np.arange(n), m), np.concatenate([np.arange(k) for k in m])
        self.mass, self.token = np.zeros((n, width)), np.zeros((n, width, flat.shape[1]))
        self.mass[row, place], self.token[row, place] = get("masses"), flat
        self.structure = None
        if "structure" in struct:
            self.structure, values, at = np.zeros((n, width, width)), get("structure"), 0
            for i, k in enumerate(m):
                self.structure[i, :k, :k] = values[at : at + k * k].reshape(k, k)
                at += k * k
        self.z = self.lost = None
        if "z" in struct:
            vectors = struct["z"].as_py()
            self.lost = np.array([z is None or None in z for z in vectors])
            known = [z for z, lost in zip(vectors, self.lost, strict=True) if not lost]
            self.z = np.full((n, len(known[0]) if known else 0), np.nan)
            self.z[~self.lost] = np.array(known).reshape(len(known), -1)


def _compute(left: _Side, right: _Side, i: np.ndarray, j: np.ndarray, measure: str, epsilon: float, sweeps: int, alpha: float, rounds: int) -> np.ndarray:
    """The costs of the pairs (i, j); pairs of similar widths go together, so that little is spent on padding."""
    out = np.zeros(len(i))
    wide_i, wide_j = (-(-side.size[at] // STEP) * STEP for side, at in ((left, i), (right, j)))
    order = np.lexsort((wide_j, wide_i))
    edges = np.flatnonzero((np.diff(wide_i[order]) != 0) | (np.diff(wide_j[order]) != 0)) + 1
    for group in np.split(order, edges):
        if not len(group):
            continue
        wa, wb = min(wide_i[group[0]], left.mass.shape[1]), min(wide_j[group[0]], right.mass.shape[1])
        step = max(1, BATCH // (wa * wb))
        for s in range(0, len(group), step):
            at = group[s : s + step]
            a, b = i[at], j[at]
            ma, mb = left.mass[a, :wa], right.mass[b, :wb]
            cost = kernels.cost_matrix(left.token[a, :wa], right.token[b, :wb])
            if measure == "fgw":
                out[at] = kernels.fgw_cost(cost, left.structure[a, :wa, :wa], right.structure[b, :wb, :wb], ma, mb, alpha, epsilon, sweeps, rounds)
            elif measure == "error":
                out[at] = kernels.marginal_error(cost, ma, mb, epsilon, sweeps)
            else:
                out[at] = kernels.sinkhorn_cost(cost, ma, mb, epsilon, sweeps)
    return out


def pair_costs(packed: DataFrame, other: DataFrame | None = None, measure: str = "sinkhorn", epsilon: float = 0.05, sweeps: int = 50, alpha: float = 0.5, rounds: int = 5, block: int = 128, share: tuple[int, int] | None = None, anchors: Anchors | None = None) -> DataFrame:
    """(i, j, cost): for i < j within ``packed``, or for every i of it and j of ``other``.

    ``measure`` is sinkhorn, debiased (less half of both self costs, at least 0), fgw (the rows then have ``structure``) or error (the
    largest marginal error of the plan).  ``share`` (number, of how many) gives the pairs of a share of the pairs of blocks.  With
    ``anchors`` (weight, vectors, vectors of ``other`` or None) the costs are those that ``anchor_penalty`` makes of them.
    """
    pairs, costs = _planned(packed, other, measure, epsilon, sweeps, alpha, rounds, block, share, anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("left"), batch.column("right"), strict=True):
                for p, q, k, m, cost in costs(_Side(a), _Side(b)):
                    lost = None if p.lost is None else p.lost[k] | q.lost[m]
                    yield pa.RecordBatch.from_pydict({"i": p.ids[k], "j": q.ids[m], "cost": pa.array(cost, mask=lost)})

    return pairs.mapInArrow(run, "i long, j long, cost double")


def _planned(packed: DataFrame, other: DataFrame | None, measure: str, epsilon: float, sweeps: int, alpha: float, rounds: int, block: int, share: tuple[int, int] | None = None, anchors: Anchors | None = None) -> tuple[DataFrame, Callable]:
    """(left, right) for each pair of blocks, and a function that makes of two sides (side, side, places, places, costs)."""
    triangle = other is None
    n_left = max(1, math.ceil(packed.count() / block))
    n_right = n_left if triangle else max(1, math.ceil(other.count() / block))
    weight, vectors, other_vectors = anchors or (0.0, None, None)
    of = lambda df, z: df.drop("z").join(z.select("row_idx", "z"), "row_idx") if weight else df
    left = _blocks(of(packed, vectors), n_left, measure == "fgw", bool(weight))
    right = left if triangle else _blocks(of(other, vectors if other_vectors is None else other_vectors), n_right, measure == "fgw", bool(weight))
    pairs = _pairs(left, right, n_left, n_right, triangle, share)

    debiased = measure == "debiased"
    made = lambda p, q, k, m: _compute(p, q, k, m, "sinkhorn" if debiased else measure, epsilon, sweeps, alpha, rounds)

    def costs(x: _Side, y: _Side) -> Iterator[tuple]:
        i, j = (v.ravel() for v in np.meshgrid(np.arange(len(x.ids)), np.arange(len(y.ids)), indexing="ij"))
        if triangle:
            # Both blocks' ids are mixed: each pair goes from its smaller id, whichever block has it.
            up = x.ids[i] < y.ids[j]
            down = (x.ids[i] > y.ids[j]) & (x.ids[0] != y.ids[0])
            todo = [(x, y, i[up], j[up]), (y, x, j[down], i[down])]
        else:
            todo = [(x, y, i, j)]
        # A block's self costs are few beside its pairs: made anew for each pair of blocks, they need no join with every pair.
        # They are made row by row, as ``self_costs`` does, so that not even their last bits differ.
        own = {id(s): np.array([_self_cost(s.mass[n, :k], s.token[n, :k], epsilon, sweeps) for n, k in enumerate(s.size)]) for s in ((x, y) if debiased else ())}
        for p, q, k, m in todo:
            if len(k):
                cost = made(p, q, k, m)
                if debiased:
                    cost = np.maximum(cost - 0.5 * own[id(p)][k] - 0.5 * own[id(q)][m], 0.0)
                yield p, q, k, m, cost + weight * ((p.z[k] - q.z[m]) ** 2).sum(-1) if weight else cost

    return pairs, costs


def round_half_up(x: np.ndarray, decimals: int) -> np.ndarray:
    """Spark's ``round`` of non-negative doubles: half up by their shortest decimal form, which is asked for near a half only."""
    scale = 10.0**decimals
    at = x * scale
    whole = np.floor(at)
    out = (whole + (at - whole >= 0.5)) / scale
    for n in np.flatnonzero(np.abs(at - whole - 0.5) < 1e-3):
        out.flat[n] = float(Decimal(repr(float(x.flat[n]))).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP))
    return out


def nearest(packed: DataFrame, k: int, decimals: int, mode: str = "debiased", epsilon: float = 0.05, sweeps: int = 50, alpha: float = 0.5, rounds: int = 5, block: int = 128) -> DataFrame:
    """(i, j, cost, rank): the ``k`` nearest of each row by (cost rounded to ``decimals``, j).

    A pair of blocks sends back the ``k`` nearest of each row among the other block's rows, so that pairs are neither written nor
    shuffled: what travels is ``k`` rows for each row and block.
    """
    name = canonical(mode, DISTANCES, "distance")
    pairs, costs = _planned(packed, None, name if name in ("debiased", "fgw") else "sinkhorn", epsilon, sweeps, alpha, rounds, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = _Side(a), _Side(b)
                table, same = np.full((len(x.ids), len(y.ids)), np.inf), x.ids[0] == y.ids[0]
                for p, _, i, j, cost in costs(x, y):
                    cost = round_half_up(cost, decimals)
                    if p is x:
                        table[i, j] = cost
                    if p is not x or same:
                        table[j, i] = cost
                for rows, columns, t in ((x.ids, y.ids, table), (y.ids, x.ids, table.T))[: 1 if same else 2]:
                    # A block's rows are in the order of their ids, so a stable sort has ties by id.
                    at = np.argsort(t, axis=1, kind="stable")[:, :k]
                    i = np.repeat(np.arange(len(rows)), at.shape[1])
                    found = t[i, at.ravel()]
                    some = found < np.inf
                    yield pa.RecordBatch.from_pydict({"i": rows[i[some]], "j": columns[at.ravel()[some]], "cost": found[some]})

    order = Window.partitionBy("i").orderBy("cost", "j")
    return pairs.mapInArrow(run, "i long, j long, cost double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _self_cost(mass: np.ndarray, token: np.ndarray, epsilon: float, sweeps: int) -> float:
    return float(kernels.sinkhorn_cost(kernels.cost_matrix(token, token), mass, mass, epsilon, sweeps))


def self_costs(packed: DataFrame, epsilon: float, sweeps: int) -> DataFrame:
    """(row_idx, self_cost): the cost of a measure to itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = []
            for mass, token in zip(batch.column("masses"), batch.column("tokens"), strict=True):
                w = mass.values.to_numpy(zero_copy_only=False)
                t = token.values.to_numpy(zero_copy_only=False).reshape(len(w), -1)
                costs.append(_self_cost(w, t, epsilon, sweeps))
            yield pa.RecordBatch.from_pydict({"row_idx": batch.column("row_idx"), "self_cost": pa.array(costs, pa.float64())})

    return packed.select("row_idx", "masses", "tokens").mapInArrow(run, "row_idx long, self_cost double")


def check_self_costs(own: DataFrame, packed: DataFrame) -> DataFrame:
    """Stored self costs for reuse; ValueError if they aren't one finite, non-negative value for each row."""
    bad = own.where(F.col("self_cost").isNull() | F.isnan("self_cost") | (F.col("self_cost") < 0) | (F.col("self_cost") == float("inf")))
    if not bad.isEmpty() or own.count() != packed.count() or not packed.join(own, "row_idx", "left_anti").isEmpty():
        raise ValueError("stored self costs don't fit the measures")
    return own


def debias(costs: DataFrame, own_i: DataFrame, own_j: DataFrame | None = None) -> DataFrame:
    """cost - half of both self costs, at least 0."""
    of = lambda df, c: df.select(F.col("row_idx").alias(c), F.col("self_cost").alias(f"s{c}"))
    joined = costs.join(of(own_i, "i"), "i").join(of(own_i if own_j is None else own_j, "j"), "j")
    return joined.select("i", "j", F.greatest(F.col("cost") - 0.5 * F.col("si") - 0.5 * F.col("sj"), F.lit(0.0)).alias("cost"))


def anchor_penalty(costs: DataFrame, vectors_i: DataFrame, weight: float, vectors_j: DataFrame | None = None) -> DataFrame:
    """cost + weight times the squared distance of the two cells' own vectors (row_idx, z)."""
    if not weight:
        return costs
    of = lambda df, c: df.select(F.col("row_idx").alias(c), F.col("z").alias(f"z{c}"))
    joined = costs.join(of(vectors_i, "i"), "i").join(of(vectors_i if vectors_j is None else vectors_j, "j"), "j")
    return joined.select("i", "j", (F.col("cost") + weight * squared_distance(F.col("zi"), F.col("zj"))).alias("cost"))


def distances(packed: DataFrame, other: DataFrame | None = None, mode: str = "debiased", own: DataFrame | None = None, other_own: DataFrame | None = None, costs: DataFrame | None = None, anchors: Anchors | None = None, **kernel) -> DataFrame:
    """(i, j, cost) of a distance mode; ``debiased`` uses stored self costs where they are given.

    ``costs`` are those of ``pair_costs``, where they have been made already.  ``anchors`` are as in ``pair_costs``.
    """
    name = canonical(mode, DISTANCES, "distance")
    if name == "debiased" and costs is None and own is None and other_own is None:
        return pair_costs(packed, other, "debiased", anchors=anchors, **kernel)
    if anchors:
        weight, *vectors = anchors
        return anchor_penalty(distances(packed, other, mode, own, other_own, costs, **kernel), vectors[0], weight, vectors[1])
    costs = pair_costs(packed, other, "fgw" if name == "fgw" else "sinkhorn", **kernel) if costs is None else costs
    if name != "debiased":
        return costs
    at = {k: kernel.get(k, v) for k, v in (("epsilon", 0.05), ("sweeps", 50))}
    own_i = self_costs(packed, **at) if own is None else check_self_costs(own, packed)
    if other is None:
        return debias(costs, own_i)
    return debias(costs, own_i, self_costs(other, **at) if other_own is None else check_self_costs(other_own, other))


def mirrored(costs: DataFrame) -> DataFrame:
    """Both directions of an upper triangle, without the diagonal."""
    return costs.unionByName(costs.select(F.col("j").alias("i"), F.col("i").alias("j"), "cost"))


def squared_euclidean(vectors: DataFrame, block: int = 512) -> DataFrame:
    """(i, j, cost) for i < j: squared distances of (row_idx, z), on the same block plan with supports of one token.

    Rows without a vector take no part; fewer than two rows give none.
    """
    single = vectors.where(F.col("z").isNotNull()).select("row_idx", F.lit(1).alias("m"), F.array(F.lit(1.0)).alias("masses"), F.col("z").alias("tokens"))
    n = max(1, math.ceil(single.count() / block))
    rows = _blocks(single, n, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = _Side(a), _Side(b)
                diff = np.zeros((len(x.ids), len(y.ids)))
                for k in range(x.token.shape[2]):
                    diff += (x.token[:, 0, k, None] - y.token[None, :, 0, k]) ** 2
                keep = x.ids[:, None] < y.ids[None, :] if x.ids[0] == y.ids[0] else x.ids[:, None] != y.ids[None, :]
                i, j = np.nonzero(keep)
                p, q = x.ids[i], y.ids[j]
                yield pa.RecordBatch.from_pydict({"i": np.minimum(p, q), "j": np.maximum(p, q), "cost": diff[i, j]})

    return _pairs(rows, rows, n, n, True).mapInArrow(run, "i long, j long, cost double")


def drawn(table: DataFrame, rows: int = 32, seed: int = 1337) -> DataFrame:
    """The ``rows`` rows of a table with the least hash of their ``row_idx``."""
    return least_drawn(table.withColumn("u", uniform(seed, F.col("row_idx"))), "u", ["row_idx"], rows).drop("u")


def convergence_sample(packed: DataFrame, epsilon: float = 0.05, sweeps: int = 50, rows: int = 32, seed: int = 1337) -> DataFrame:
    """One row (pairs, mean_error, max_error): marginal errors among the ``rows`` measures with the least hash of their id."""
    # Their measures may be wide, so the pairs are dealt to many tasks.
    errors = pair_costs(drawn(packed, rows, seed), measure="error", epsilon=epsilon, sweeps=sweeps, block=max(1, rows // 8))
    return errors.agg(F.count("*").alias("pairs"), F.avg("cost").alias("mean_error"), F.max("cost").alias("max_error"))
