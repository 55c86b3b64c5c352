"""Clustering of a precomputed distance relation: average linkage, k-medoids, graph communities, and model selection.

All run as rounds of joins and aggregates whose tables are written to the shared folder, whatever the size: nothing holds the relation in one
place.  What is left when a few dozen clusters or a few hundred communities remain is finished on the driver.

Cases: a relation holds no nulls; equal distances go by the smaller ids; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nichewright.functions.portable import squared_distance
from nichewright.operators import metrics, moments, orders, tiles
from nichewright.operators.components import connected_components
from nichewright.operators.graphs import knn_affinity
from nichewright.plans.storage import materialise


#: The columns of a dendrogram.
MERGES = "turn int, a long, b long, height double"
#: Names of clusters or nodes that are broadcast; for more of them joins shuffle.
MOST_NAMES = 500_000


def candidate_counts(values, n: int) -> tuple[int, ...]:
    """Distinct numbers of niches k with 1 < k < n, ascending; none raises ValueError."""
    found = tuple(sorted({int(v) for v in values if 1 < int(v) < n}))
    if not found:
        raise ValueError(f"no candidate number of niches lies between 1 and {n}")
    return found


def average_merges(distance: DataFrame, ids: DataFrame, tail: int = 64) -> DataFrame:
    """(turn, a, b, height): the merges of average linkage over (i, j, cost), i < j; clusters are named by their first member.

    Rounds of reciprocal neighbors: every cluster finds its nearest by (cost, ids), all pairs that are each other's nearest merge at once,
    and sums of distances are added up by the merged names, which gives the average distance exactly.  Average linkage is reducible: no
    merge brings a third cluster nearer than the nearer of the two, so that the pairs of a round are merges of the one dendrogram,
    in whatever order they are found.  The closest pair of all is always among them.  Once ``tail`` clusters are left, their table is
    finished on the driver.  A pair that is missing from the relation raises ValueError.
    """
    spark = distance.sparkSession
    one, zero = F.lit(1.0), F.lit(0.0)
    made = distance.where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("cost").alias("total"), *(one.alias(c) for c in ("sa", "sb")), *(zero.alias(c) for c in ("ha", "hb")))
    sums, left, merges, turn = materialise(made, "linkage"), ids.count(), [], 0
    if sums.count() != left * (left - 1) // 2:
        raise ValueError(f"the relation hasn't one distance for each pair of {left} rows")
    while left > tail:
        pair = F.struct((F.col("total") / (F.col("sa") * F.col("sb"))).alias("cost"), "a", "b", "sa", "sb", "ha", "hb")
        nearest = sums.select(pair.alias("pair"), F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.min("pair").alias("pair"))
        both = nearest.groupBy("pair").count().where("count = 2").select("pair.a", "pair.b", (F.col("pair.sa") + F.col("pair.sb")).alias("size"), F.greatest("pair.cost", "pair.ha", "pair.hb").alias("height"))
        both = materialise(both, "linkage")
        merges.append(both.select(F.lit(turn).alias("turn"), "a", "b", "height"))
        # Each end of a pair gets the name, size and height of the cluster that it is now in; a broadcast has a row for each merged cluster.
        found = both.select(F.explode(F.array("a", "b")).alias("c"), F.struct(F.col("a").alias("name"), "size", "height").alias("now"))
        found = F.broadcast(found) if left <= MOST_NAMES else found
        at = lambda c, found=found: found.select(F.col("c").alias(c), F.col("now").alias(f"n{c}"))
        end = lambda c: F.coalesce(F.col(f"n{c}"), F.struct(F.col(c).alias("name"), F.col(f"s{c}").alias("size"), F.col(f"h{c}").alias("height")))
        moved = sums.join(at("a"), "a", "left").join(at("b"), "b", "left").select(end("a").alias("x"), end("b").alias("y"), "total").where("x.name <> y.name")
        moved = moved.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.sum("total").alias("total"))
        sums = materialise(moved.select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), "total", F.col("x.size").alias("sa"), F.col("y.size").alias("sb"), F.col("x.height").alias("ha"), F.col("y.height").alias("hb")), "linkage")
        left, turn = left - both.count(), turn + 1
    last = sums.collect()  # at most ``tail`` clusters
    size = {r.a: r.sa for r in last} | {r.b: r.sb for r in last}
    height = {r.a: r.ha for r in last} | {r.b: r.hb for r in last}
    names = sorted(size)
    place = {c: n for n, c in enumerate(names)}
    matrix = np.zeros((len(names), len(names)))
    for r in last:
        matrix[place[r.a], place[r.b]] = matrix[place[r.b], place[r.a]] = r.total / (r.sa * r.sb)
    return reduce(DataFrame.unionByName, merges, spark.createDataFrame(_finish(names, size, height, matrix, turn), MERGES))


def average_merges_of_vectors(vectors: DataFrame, ids: DataFrame, tail: int = 2048) -> DataFrame:
    """``average_merges`` of the squared distances of (row_idx, z), of which none are stored.

    The mean squared distance between the members of two clusters is that of their centres plus both clusters' mean squared distances
    to their own, so a cluster is a row: its centre, spread, size and height.  A round finds each one's nearest by pairs of blocks.  Equal vectors
    are united beforehand, at height 0.  A row without a vector, or with one that isn't finite, raises ValueError.
    """
    spark = vectors.sparkSession
    own = materialise(ids.select("row_idx").join(vectors.where(F.col("z").isNotNull() & ~F.exists("z", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))), "row_idx").select("row_idx", "z"), "linkage")
    if own.count() != ids.count():
        raise ValueError("a row has no finite vector")
    copies = own.groupBy("z").agg(F.min("row_idx").alias("a"), F.count("*").cast("double").alias("size"))
    zero = F.lit(0.0)
    state = materialise(copies.select(F.col("a").alias("row_idx"), "z", zero.alias("spread"), "size", zero.alias("height")), "linkage")
    again = own.join(copies.where("size > 1"), "z").where("row_idx <> a")
    equal = materialise(again.select((F.row_number().over(Window.partitionBy("a").orderBy("row_idx")) - 1).alias("turn"), "a", F.col("row_idx").alias("b"), zero.alias("height")), "linkage")
    left, merges, turn = state.count(), [equal], equal.agg(F.max("turn")).first()[0]
    turn = 0 if turn is None else turn + 1
    middle = orders.centre_of(state) if left > tail else None
    while left > tail:
        nearest = orders.nearest_clusters(state, left, middle)
        both = nearest.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max("cost").alias("cost"), F.count("*").alias("n")).where("n = 2")
        end = lambda c, state=state: state.select(F.col("row_idx").alias(c), *(F.col(v).alias(v + c) for v in ("z", "spread", "size", "height")))
        n, share = F.col("sizea") + F.col("sizeb"), F.col("sizea") * F.col("sizeb")
        centre = F.zip_with("za", "zb", lambda x, y: (x * F.col("sizea") + y * F.col("sizeb")) / (F.col("sizea") + F.col("sizeb")))
        spread = (F.col("spreada") * F.col("sizea") + F.col("spreadb") * F.col("sizeb")) / n + share / (n * n) * squared_distance(F.col("za"), F.col("zb"))
        joined = both.join(end("a"), "a").join(end("b"), "b")
        made = materialise(joined.select("a", "b", centre.alias("z"), spread.alias("spread"), n.alias("size"), F.greatest("cost", "heighta", "heightb").alias("height")), "linkage")
        found = made.count()
        if not found:
            raise ValueError("distances beyond double precision")
        merges.append(made.select(F.lit(turn).alias("turn"), "a", "b", "height"))
        alone = state.join(made.select(F.explode(F.array("a", "b")).alias("row_idx")), "row_idx", "left_anti")
        state = materialise(alone.unionByName(made.select(F.col("a").alias("row_idx"), "z", "spread", "size", "height")), "linkage")
        left, turn = left - found, turn + 1
    last = state.orderBy("row_idx").collect()  # at most ``tail`` clusters
    z, spread = np.array([r.z for r in last]).reshape(len(last), len(last[0].z) if last else 0), np.array([r.spread for r in last])
    matrix = spread[:, None] + spread[None]
    for c in z.T:
        matrix += (c[:, None] - c[None]) ** 2
    names = [r.row_idx for r in last]
    done = _finish(names, {r.row_idx: r.size for r in last}, {r.row_idx: r.height for r in last}, matrix, turn)
    return reduce(DataFrame.unionByName, merges, spark.createDataFrame(done, MERGES))


def _finish(names: list, size: dict, height: dict, matrix: np.ndarray, turn: int) -> list[tuple[int, int, int, float]]:
    """The merges of a few clusters with the ``matrix`` of their mean distances, their sizes and heights."""
    out = []
    for i, j, h in linkage(matrix, np.array([size[c] for c in names])):
        a, b = names[i], names[j]
        height[a] = max(h, height[a], height[b])
        out.append((turn + len(out), a, b, height[a]))
    return out


def linkage(matrix: np.ndarray, sizes: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Average-linkage merges (a, b, height) of a small matrix, by chains of nearest neighbors; clusters are named by their first member."""
    n = len(matrix)
    d, size, live = matrix.astype(float).copy(), np.ones(n) if sizes is None else np.array(sizes, float), np.ones(n, bool)
    np.fill_diagonal(d, np.inf)
    merges, chain = [], []
    while live.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            a = chain[-1]
            row = np.where(live, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        merges.append((a, b, float(d[a, b])))
        mixed = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = mixed, mixed
        d[a, a] = np.inf
        size[a] += size[b]
        live[b] = False
    return merges


def _find(root: dict, x):
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def cut(merges: DataFrame, ids: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, row_idx, niche) of a dendrogram (turn, a, b, height) for every k, numbered from 0 by each cluster's first member.

    The lowest merges, down to the largest k, are united as a graph; the ones above them, fewer than the largest k, on the driver.
    """
    spark, most = ids.sparkSession, max(ks)
    merges = materialise(merges, "merges")
    high = merges.orderBy(F.desc("height"), F.desc("turn"), F.desc("a")).limit(most - 1)
    high = sorted(high.collect(), key=lambda r: (r.height, r.turn, r.a))  # fewer than the largest k
    low = merges.join(F.broadcast(spark.createDataFrame([(r.b,) for r in high], "b long")), "b", "left_anti")  # a cluster is merged away once
    placed = materialise(ids.select("row_idx").join(_tops(low), F.col("row_idx") == F.col("b"), "left").select("row_idx", F.coalesce("top", "row_idx").alias("c")), "cut")
    names = [r.c for r in placed.select("c").distinct().collect()]  # as many as the largest k
    table = []
    for k in ks:
        root = {c: c for c in names}
        for r in high[: max(0, len(names) - k)]:
            a, b = _find(root, r.a), _find(root, r.b)
            root[max(a, b)] = min(a, b)
        number = {c: n for n, c in enumerate(sorted({_find(root, c) for c in names}))}
        table += [(int(k), c, number[_find(root, c)]) for c in names]
    return placed.join(F.broadcast(spark.createDataFrame(table, "k int, c long, niche int")), "c").select("k", "row_idx", "niche")


def _tops(merges: DataFrame) -> DataFrame:
    """(b, top): where each cluster that was merged away ends up.  Every round follows twice as many merges as the one before."""
    up = materialise(merges.select("b", F.col("a").alias("top")), "tops")
    while True:
        further = up.select(F.col("b").alias("top"), F.col("top").alias("next"))
        found = materialise(up.join(further, "top", "left").select("b", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("went")), "tops")
        up = found.select("b", "top")
        if found.where("went").isEmpty():
            return up


def agglomerate(distance: DataFrame, ids: DataFrame, ks: tuple[int, ...], tail: int = 64) -> DataFrame:
    """(k, row_idx, niche) for every k, from one dendrogram of average linkage."""
    return cut(average_merges(distance, ids, tail), ids, ks)


def agglomerate_vectors(vectors: DataFrame, ids: DataFrame, ks: tuple[int, ...], tail: int = 2048) -> DataFrame:
    """``agglomerate`` of the squared distances of (row_idx, z)."""
    return cut(average_merges_of_vectors(vectors, ids, tail), ids, ks)


def by_column(distance: DataFrame) -> DataFrame:
    """The relation, written in the order of ``j``, so that the distances to one row are read without the others."""
    return materialise(distance.select("i", "j", "cost").repartitionByRange("j", "i").sortWithinPartitions("j", "i"), "columns")


def farthest_first(distance: DataFrame, ids: DataFrame, k: int, ordered: DataFrame | None = None) -> list[int]:
    """The row with the least mean distance, then always the row farthest from those chosen; ties go by id.

    ``distance`` holds both directions.  A state table keeps each row's distance to the nearest chosen one, and a step reads the
    distances to the new one only, from ``ordered`` (``by_column``, which is made if it isn't given).  An empty table gives none.
    """
    total = ids.join(distance.groupBy("i").agg(F.sum("cost").alias("total")), ids.row_idx == F.col("i"), "left")
    first = total.agg(F.min(F.struct(F.coalesce("total", F.lit(0.0)).alias("t"), "row_idx"))["row_idx"].alias("m")).first()["m"]
    if first is None or k < 1:
        return []
    chosen, state = [first], None
    ordered = by_column(distance) if ordered is None and k > 1 else ordered
    while len(chosen) < k:
        new = ordered.where(F.col("j") == chosen[-1]).select("i", "cost")
        if state is not None:
            new = state.where(F.col("i") != chosen[-1]).join(new.withColumnRenamed("cost", "new"), "i", "left").select("i", F.least("cost", "new").alias("cost"))
        state = materialise(new, "nearest-chosen")
        found = state.agg(F.max(F.struct("cost", (-F.col("i")).alias("i")))["i"].alias("i")).first()["i"]
        if found is None:
            break
        chosen.append(-found)
    return chosen


def nearest_medoid(distance: DataFrame, ids: DataFrame, medoids: list[int]) -> DataFrame:
    """(row_idx, niche): the place in ``medoids`` of each row's nearest; ties go to the earlier place, a medoid keeps its own."""
    place = distance.sparkSession.createDataFrame([(m, n) for n, m in enumerate(medoids)], "j long, niche int")
    # Equalities rather than a list of values, of which Parquet's readers skip pages for the first ten only.
    wanted = reduce(lambda a, b: a | b, (F.col("j") == m for m in medoids), F.lit(False))
    to = distance.where(wanted).join(F.broadcast(place), "j").select("i", "cost", "niche")
    own = place.select(F.col("j").alias("i"), F.lit(0.0).alias("cost"), "niche")
    best = to.unionByName(own).groupBy("i").agg(F.min(F.struct("cost", "niche"))["niche"].alias("niche"))
    return ids.select("row_idx").join(best.withColumnRenamed("i", "row_idx"), "row_idx").select("row_idx", "niche")


def kmedoids(distance: DataFrame, ids: DataFrame, k: int, most_rounds: int = 50) -> tuple[DataFrame, list[int]]:
    """((row_idx, niche), medoids): assignment and re-centring in turn until both stay; an emptied niche keeps its medoid.

    A round reads the distances to the medoids, and those within the niches that gained or lost a row.
    """
    ordered = by_column(distance)
    chosen, labels = farthest_first(distance, ids, k, ordered), None
    for _ in range(most_rounds):
        before, labels = labels, materialise(nearest_medoid(ordered, ids, chosen), "kmedoids")
        moved_rows = labels
        if before is not None:
            other = labels.join(before.withColumnRenamed("niche", "was"), "row_idx").where("niche <> was")
            touched = [r.n for r in other.select(F.explode(F.array("niche", "was")).alias("n")).distinct().collect()]  # k at most
            moved_rows = labels.where(F.col("niche").isin(touched))
        found = {r.niche: r.medoid for r in metrics.medoids(distance, moved_rows).collect()}  # k rows
        moved = [found.get(n, m) for n, m in enumerate(chosen)]
        if moved == chosen:
            break
        chosen = moved
    return labels, chosen


def farthest_vectors(vectors: DataFrame, ids: DataFrame, k: int) -> list[int]:
    """``farthest_first`` of the squared distances of (row_idx, z): sums by tiles, then the distances to the rows chosen."""
    total = ids.join(tiles.totals(vectors), ids.row_idx == F.col("i"), "left")
    first = total.agg(F.min(F.struct(F.coalesce("total", F.lit(0.0)).alias("t"), "row_idx"))["row_idx"].alias("m")).first()["m"]
    chosen = [first] if first is not None and k >= 1 else []
    while chosen and len(chosen) < k:
        few = vectors.sparkSession.createDataFrame([(c,) for c in chosen], "row_idx long")
        near = tiles.to_few(vectors, few).where(~F.col("i").isin(chosen)).groupBy("i").agg(F.min("cost").alias("cost"))
        found = near.agg(F.max(F.struct("cost", (-F.col("i")).alias("i")))["i"].alias("i")).first()["i"]
        if found is None:
            break
        chosen.append(-found)
    return chosen


def kmedoids_of_vectors(vectors: DataFrame, ids: DataFrame, k: int, most_rounds: int = 50) -> tuple[DataFrame, list[int]]:
    """``kmedoids`` of the squared distances of (row_idx, z), of which none are stored: a round makes those to the medoids, and by tiles
    the sums within the niches that gained or lost a row."""
    chosen, labels = farthest_vectors(vectors, ids, k), None
    for _ in range(most_rounds):
        few = vectors.sparkSession.createDataFrame([(m,) for m in chosen], "row_idx long")
        before, labels = labels, materialise(nearest_medoid(tiles.to_few(vectors, few), ids, chosen), "kmedoids")
        moved_rows = labels
        if before is not None:
            other = labels.join(before.withColumnRenamed("niche", "was"), "row_idx").where("niche <> was")
            touched = [r.n for r in other.select(F.explode(F.array("niche", "was")).alias("n")).distinct().collect()]  # k at most
            moved_rows = labels.where(F.col("niche").isin(touched))
        found = {r.niche: r.medoid for r in metrics.medoids(None, moved_rows, sums=tiles.niche_sums(vectors, moved_rows, within=True)).collect()}  # k rows
        moved = [found.get(n, m) for n, m in enumerate(chosen)]
        if moved == chosen:
            break
        chosen = moved
    return labels, chosen


def communities(affinity: np.ndarray, resolution: float = 1.0, seed: int = 1337, most_passes: int = 50, loops: bool = False) -> np.ndarray:
    """Labels of a small weighted graph by local moving, refinement into connected parts, and aggregation, for the modularity.

    Labels are numbered by first member, and each community is connected.  The diagonal counts only with ``loops``.
    """
    rng = np.random.default_rng(seed)
    n = len(affinity)
    graph, member = affinity.astype(float).copy(), np.arange(n)
    if not loops:
        np.fill_diagonal(graph, 0)
    total = graph.sum()
    if total <= 0:
        return np.arange(n)
    for _ in range(most_passes):
        m = len(graph)
        of, degree = np.arange(m), graph.sum(1)
        weight = degree.copy()
        for _ in range(most_passes):
            moved = False
            for v in rng.permutation(m):
                weight[of[v]] -= degree[v]
                links = np.bincount(of, graph[v] * (np.arange(m) != v), minlength=m)
                gain = links - resolution * degree[v] * weight / total
                best = int(gain.argmax())
                if gain[best] > gain[of[v]] + 1e-12:
                    of[v], moved = best, True
                weight[of[v]] += degree[v]
            if not moved:
                break
        of = _connected(graph, of)
        k = of.max() + 1
        if k == m:
            break
        member = of[member]
        side = np.zeros((m, k))
        side[np.arange(m), of] = 1
        graph = side.T @ graph @ side
    first = {c: i for i, c in reversed(list(enumerate(member)))}
    rank = {c: r for r, c in enumerate(sorted(first, key=first.get))}
    return np.array([rank[c] for c in member])


def _connected(graph: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The communities split into their connected parts, numbered from 0."""
    out, at = np.full(len(of), -1), 0
    for v in range(len(of)):
        if out[v] >= 0:
            continue
        stack, out[v] = [v], at
        while stack:
            u = stack.pop()
            for w in np.flatnonzero((graph[u] > 0) & (of == of[v]) & (out < 0)):
                out[w] = at
                stack.append(w)
        at += 1
    return out


def _moved(graph: DataFrame, labels: DataFrame, nodes: int, total: float, resolution: float, seed: int, turns: int, patience: int = 3, least: float = 1e-3) -> DataFrame:
    """(v, c): the labelling of best modularity on the way from ``labels`` (v, c, degree), by moves of nodes to neighbors' communities.

    In each turn a half of the nodes, drawn anew by a keyed hash, moves at once to where each gains most, so that two neighbors seldom
    swap places for ever.  ``graph`` is (a, b, w) in both directions without loops.  The turns end when no node wants to move, or when
    the modularity hasn't risen by ``least`` for ``patience`` turns.
    """
    small = F.broadcast if nodes <= MOST_NAMES else lambda df: df
    best, most, mark, mark_at = labels.select("v", "c"), -float("inf"), -float("inf"), 0
    for turn in range(turns):
        volume = labels.groupBy("c").agg(F.sum("degree").alias("volume"))
        own = labels.join(small(volume.withColumnRenamed("volume", "own_volume")), "c")
        there = graph.join(small(labels.select(F.col("v").alias("b"), F.col("c").alias("to"))), "b").select("a", "to", "w")
        # All edges of a node in one partition, so that its sums and its choice need no other shuffle.
        there = there.repartition("a").groupBy("a", "to").agg(F.sum("w").alias("links")).join(small(volume.withColumnRenamed("c", "to")), "to").join(small(own), F.col("a") == F.col("v"))
        loss = F.lit(resolution) * F.col("degree") / F.lit(total)
        stays = F.col("to") == F.col("c")
        gain = F.col("links") - loss * (F.col("volume") - F.when(stays, F.col("degree")).otherwise(F.lit(0.0)))
        seen = there.groupBy("a").agg(F.max(F.struct(gain.alias("gain"), (-F.col("to")).alias("to"))).alias("best"), F.max(F.when(stays, gain)).alias("here"), F.max(F.when(stays, F.col("links"))).alias("inner"))
        alone = -loss * (F.col("own_volume") - F.col("degree"))
        wants = F.coalesce(F.col("best.gain") > F.coalesce("here", alone) + 1e-12, F.lit(False))
        free = F.pmod(F.xxhash64("v", F.lit(seed), F.lit(turn)), F.lit(2)) == 0
        chosen = own.join(seen, own.v == seen.a, "left").select("v", "c", "degree", "own_volume", F.coalesce("inner", F.lit(0.0)).alias("inner"), wants.alias("wants"), F.when(wants & free, -F.col("best.to")).otherwise(F.col("c")).alias("next"))
        chosen = materialise(chosen, "moves")
        # The modularity of the labels before this turn's moves: a node's share of its community's volume times that volume.
        row = chosen.agg((F.sum("inner") / total - resolution * F.sum(F.col("degree") * F.col("own_volume")) / (total * total)).alias("q"), F.count_if("wants").alias("n")).first()
        if row.q > most:
            best, most = chosen.select("v", "c"), row.q
        if row.q >= mark + least:
            mark, mark_at = row.q, turn
        if not row.n or turn - mark_at >= patience:
            break
        labels = chosen.select("v", F.col("next").alias("c"), "degree")
    return best


def _parts(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """(v, part): the communities (v, c) split into their connected parts, named by their least node."""
    of = lambda n, c: labels.select(F.col("v").alias(n), F.col("c").alias(c))
    inner = graph.where("a < b").join(of("a", "ca"), "a").join(of("b", "cb"), "b").where("ca = cb").select("a", "b")
    found = connected_components(inner)
    return materialise(labels.join(found, labels.v == found.node, "left").select("v", F.coalesce("component", "v").alias("part")), "parts")


def community_edges(edges: DataFrame, ids: DataFrame, resolution: float = 1.0, seed: int = 1337, turns: int = 40, tail: int = 256) -> DataFrame:
    """(row_idx, niche) of a weighted graph (i, j, affinity), both directions, for the modularity; each community is connected.

    Levels of local moving (``_moved``), refinement into connected parts, and aggregation of parts to nodes, until nothing merges.
    A graph of at most ``tail`` nodes is finished on the driver.  Then rows move once more from where their community left them.
    Niches are numbered by first member; rows without an edge stand alone.
    """
    spark = edges.sparkSession
    base = materialise(edges.where("i <> j").select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("affinity").alias("w")), "graph")
    degree = base.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("degree"))
    rows = ids.select(F.col("row_idx").alias("v"))
    nodes = start = materialise(rows.join(degree, "v", "left").select("v", F.coalesce("degree", F.lit(0.0)).alias("degree")), "nodes")
    total = nodes.agg(F.sum("degree").alias("t")).first()["t"] or 0.0
    if total <= 0:
        return _numbered(rows.select("v", F.col("v").alias("part")))
    graph, member, left, levels = base, rows.select("v", F.col("v").alias("at")), nodes.count(), 0
    n = left
    while left > tail:
        parts = _parts(graph, _moved(graph, nodes.withColumn("c", F.col("v")), left, total, resolution, seed + levels, turns))
        fewer = parts.select("part").distinct().count()
        if fewer == left:
            break
        member = materialise(member.join(parts.withColumnRenamed("v", "at"), "at").select("v", F.col("part").alias("at")), "members")
        to = lambda n, p, parts=parts: parts.select(F.col("v").alias(n), F.col("part").alias(p))
        graph = materialise(graph.join(to("a", "x"), "a").join(to("b", "y"), "b").where("x <> y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")), "graph")
        nodes = materialise(nodes.join(parts, "v").groupBy(F.col("part").alias("v")).agg(F.sum("degree").alias("degree")), "nodes")
        left, levels = fewer, levels + 1
    if left <= tail:
        held = nodes.orderBy("v").collect()  # at most ``tail`` nodes
        place = {r.v: n for n, r in enumerate(held)}
        matrix = np.zeros((left, left))
        for r in graph.collect():
            matrix[place[r.a], place[r.b]] = r.w
        np.fill_diagonal(matrix, [r.degree for r in held] - matrix.sum(1))
        ends = spark.createDataFrame([(r.v, int(c)) for r, c in zip(held, communities(matrix, resolution, seed, loops=True), strict=True)], "at long, c long")
        member = member.join(F.broadcast(ends), "at").select("v", F.col("c").alias("at"))
    if levels:
        first = materialise(member.join(start, "v").select("v", F.col("at").alias("c"), "degree"), "members")
        member = _moved(base, first, n, total, resolution, seed + levels, turns).select("v", F.col("c").alias("at"))
    return _numbered(_parts(base, member.select("v", F.col("at").alias("c"))))


def _numbered(parts: DataFrame) -> DataFrame:
    """(row_idx, niche) of (v, part): numbers from 0 by the parts' names; a row for each part, not each node, is numbered in one task."""
    numbers = parts.select("part").distinct().select("part", (F.row_number().over(Window.orderBy("part")) - 1).alias("niche"))
    return parts.join(numbers, "part").select(F.col("v").alias("row_idx"), "niche")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of (row_idx, niche) on a weighted graph (i, j, affinity) in both directions."""
    of = lambda c: labels.select(F.col("row_idx").alias(c), F.col("niche").alias(f"l{c}"))
    by_niche = edges.where("i <> j").join(of("i"), "i").join(of("j"), "j").groupBy("li").agg(F.sum(F.when(F.col("li") == F.col("lj"), F.col("affinity")).otherwise(F.lit(0.0))).alias("inner"), F.sum("affinity").alias("volume"))
    total = F.sum("volume")
    return by_niche.agg((F.sum("inner") / total - resolution * F.sum(F.col("volume") * F.col("volume")) / (total * total)).alias("modularity"))


def community_labels(distance: DataFrame, ids: DataFrame, k: int = 15, scaling: str = "local", resolution: float = 1.0, seed: int = 1337, near: DataFrame | None = None) -> DataFrame:
    """(row_idx, niche) from the kNN affinity graph; ``distance`` holds both directions, or what the scale needs if ``near`` is given."""
    return communities_by_resolution(distance, ids, (resolution,), k, scaling, seed, near).drop("resolution")


def communities_by_resolution(distance: DataFrame, ids: DataFrame, resolutions: tuple[float, ...], k: int = 30, scaling: str = "local", seed: int = 1337, near: DataFrame | None = None) -> DataFrame:
    """(resolution, row_idx, niche) for every resolution, from one graph; an empty table gives an empty result."""
    edges = materialise(knn_affinity(distance, k, scaling, ids.count(), near), "affinity")
    made = [community_edges(edges, ids, float(r), seed).select(F.lit(float(r)).alias("resolution"), "row_idx", "niche") for r in resolutions]
    return reduce(DataFrame.unionByName, made)


def select_resolution(distance: DataFrame, ids: DataFrame, resolutions: tuple[float, ...], k: int = 30, scaling: str = "local", names: tuple[str, ...] = metrics.METRICS[:4], seed: int = 1337) -> tuple[DataFrame, DataFrame]:
    """((resolution, metrics, ranks, best), (row_idx, niche) of the best) over the positive, distinct resolutions, ties to the smaller."""
    tried = tuple(sorted({float(r) for r in resolutions if r > 0}))
    if not tried:
        raise ValueError("no candidate resolution is positive")
    return _best(distance, communities_by_resolution(distance, ids, tried, k, scaling, seed), metrics.metric_names(names), "resolution")


def _best(distance: DataFrame, fits: DataFrame, names: tuple[str, ...], tie: str) -> tuple[DataFrame, DataFrame]:
    """The ranked scores of the labellings ``fits`` (tie, row_idx, niche), and the labels of the best."""
    fits = materialise(fits, "fits")
    table = materialise(metrics.rank_ensemble(metrics.scores(distance, fits, names, (tie,)), names, tie), "selection")
    best = table.where("best").first()[tie]
    return table, fits.where(F.col(tie) == best).select("row_idx", "niche")


def select_model(distance: DataFrame, ids: DataFrame, candidates: tuple[int, ...], method: str = "agglomerative", names: tuple[str, ...] = metrics.METRICS[:4]) -> tuple[DataFrame, DataFrame]:
    """((k, metrics, ranks, best), (row_idx, niche) of the best): all candidates are scored in one job."""
    ks, names = candidate_counts(candidates, ids.count()), metrics.metric_names(names)
    if method == "agglomerative":
        fits = agglomerate(distance, ids, ks)
    elif method == "kmedoids":
        parts = [kmedoids(distance, ids, k)[0].select(F.lit(k).alias("k"), "row_idx", "niche") for k in ks]
        fits = parts[0]
        for part in parts[1:]:
            fits = fits.unionByName(part)
    else:
        raise ValueError(f"unknown method {method!r}")
    return _best(distance, fits, names, "k")


def select_model_of_vectors(vectors: DataFrame, ids: DataFrame, candidates: tuple[int, ...], names: tuple[str, ...] = metrics.METRICS[:4]) -> tuple[DataFrame, DataFrame]:
    """``select_model`` by average linkage of the squared distances of (row_idx, z), of which none are stored: candidates are
    scored by the moments of their niches, and the percentiles of all candidates by the same passes over pairs of blocks."""
    ks, names = candidate_counts(candidates, ids.count()), metrics.metric_names(names)
    fits = materialise(agglomerate_vectors(vectors, ids, ks), "fits")
    found: list[dict[int, float | None]] = [{}] * len(ks)
    if "percentile_dunn" in names:
        wide = fits.groupBy("row_idx").agg(*(F.max(F.when(F.col("k") == k, F.col("niche"))).alias(f"k{k}") for k in ks))
        found = orders.percentiles(vectors, wide, {0: 0.05, 1: 0.95}, tuple(f"k{k}" for k in ks))
    rows = [(k, *_scores_of_vectors(vectors, fits.where(F.col("k") == k).select("row_idx", "niche"), names, own)) for k, own in zip(ks, found, strict=True)]
    scored = vectors.sparkSession.createDataFrame(rows, ", ".join(["k int", *(f"{n} double" for n in names)]))
    table = materialise(metrics.rank_ensemble(scored, names, "k"), "selection")
    return table, fits.where(F.col("k") == table.where("best").first()["k"]).select("row_idx", "niche")


def _scores_of_vectors(vectors: DataFrame, labels: DataFrame, names: tuple[str, ...], percentiles: dict[int, float | None]) -> list[float | None]:
    """The scores ``names`` of one labelling (row_idx, niche) over the squared distances of (row_idx, z), of which ``percentiles`` are known."""
    summed = {"silhouette", "calinski_harabasz", "davies_bouldin"} & set(names)
    held = moments.rows_of(vectors, labels)
    known = moments.gathered(held) if summed else None
    sums = None
    if summed and (known is None or summed != {"calinski_harabasz"}):
        sums = materialise(tiles.niche_sums(vectors, labels, squares=True) if known is None else moments.niche_sums(held, known), "niche-sums")

    def calinski_harabasz() -> float | None:
        return metrics.calinski_harabasz(sums, labels).first()[0] if known is None else moments.calinski_harabasz(known)

    def davies_bouldin() -> DataFrame:
        centre = materialise(metrics.medoids(None, labels, sums=sums), "medoids")
        return metrics.davies_bouldin(tiles.to_few(vectors, centre.select(F.col("medoid").alias("row_idx"))), labels, centre=centre)

    def percentile_dunn() -> float | None:
        return None if percentiles[0] is None else float(percentiles[0] / max(percentiles[1] or 0.0, 1e-12))

    def minimum_dunn() -> float | None:
        row = tiles.extremes(vectors, labels).agg(F.min("between").alias("b"), F.max("within").alias("w")).first()
        return None if row.b is None or row.b == float("inf") else row.b / max(row.w, 1e-12)

    make = {
        "silhouette": lambda: metrics.silhouette(sums).first()[0],
        "calinski_harabasz": calinski_harabasz,
        "davies_bouldin": lambda: davies_bouldin().first()[0],
        "percentile_dunn": percentile_dunn,
        "minimum_dunn": minimum_dunn,
    }
    return [make[n]() for n in names]
