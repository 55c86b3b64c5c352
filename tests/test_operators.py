import random

import numpy as np
import pytest
from nichewright.config import NicheConfig, parse_int_list
from nichewright.functions import kernels
from nichewright.operators import assignment, clustering, features, graphs, measures, metrics, neighbors, pooling, structures, transport
from nichewright.sources import bundle
from nichewright.streaming.assign import assign_stream
from pyspark.sql import functions as F


def cells_of(spark, rows):
    return spark.createDataFrame([(i, s, float(x), float(y)) for i, s, x, y in rows], "row_idx long, sample_id string, x double, y double")


def relation(spark, matrix):
    n = len(matrix)
    return spark.createDataFrame([(i, j, float(matrix[i][j])) for i in range(n) for j in range(n) if i != j], "i long, j long, cost double")


def ids(spark, n):
    return spark.range(n).select(F.col("id").alias("row_idx"))


def apart(points):
    """Euclidean distances of points, given as rows."""
    x = np.array(points, float).reshape(len(points), -1)
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


#: Distances of the points 0, 1, 7 and 9 on a line.
LINE = apart([0, 1, 7, 9])


def test_radius_join_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab") if i % 7 else None, rng.choice([rng.uniform(-30, 30), 5.0]), rng.uniform(-30, 30)) for i in range(200)] + [(300, "a", float("nan"), 0), (301, "a", 5, 5), (302, "a", 5, 5)]
    got = {(r.row_idx, r.neighbor): r.distance for r in neighbors.radius_edges(cells_of(spark, rows), 6.5).collect()}
    want = {(a[0], b[0]): np.hypot(a[2] - b[2], a[3] - b[3]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and np.hypot(a[2] - b[2], a[3] - b[3]) <= 6.5}
    assert got == pytest.approx(want) and (301, 302) in got
    with pytest.raises(ValueError, match="positive"):
        neighbors.radius_edges(cells_of(spark, rows), 0)


def test_plan_has_no_nested_loop(spark):
    plan = neighbors.radius_edges(cells_of(spark, [(0, "a", 0, 0)]), 1.0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cap_keeps_heavy_strata_and_never_more_than_allowed(spark):
    rows = [(0, j, 0.5 + 4 * j, 1000.0 if j == 11 else 1.0, j) for j in range(12)] + [(1, 5, 1.0, 1.0, 0)]
    edges = spark.createDataFrame(rows, "row_idx long, neighbor long, distance double, weight double, state int")
    for seed in range(5):
        got = measures.cap_neighbors(edges, 50.0, 3, shells=1, seed=seed).collect()
        assert len([r for r in got if r.row_idx == 0]) == 3 and 11 in {r.neighbor for r in got} and (1, 5) in {(r.row_idx, r.neighbor) for r in got}


def test_cap_draws_by_weight(spark):
    rows = [(i, j, 1.0, 3.0 if j == 0 else 1.0) for i in range(2000) for j in range(4)]
    edges = spark.createDataFrame(rows, "row_idx long, neighbor long, distance double, weight double")
    share = measures.cap_neighbors(edges, 50.0, 1, shells=1).where("neighbor = 0").count() / 2000
    assert abs(share - 0.5) < 0.04


def brute_cap(rows, radius, most, shells, seed=1337):
    """The edges (row, neighbor) that stay of (row, neighbor, distance, weight, state), by the definition."""

    def uniform(salt, i, j):
        h = (i * 48271 + j * 69621 + salt) % 2147483647
        for _ in range(2):
            h = (h * h + 16807 * h + 1) % 2147483647
        return (h + 0.5) / 2147483647

    race = lambda u, w: -np.log(u) / max(w, 1e-300)
    out = set()
    for row in {r[0] for r in rows}:
        own = [(race(uniform(seed, row, j), w), j, (int(min(max(d / radius, 0), 0.999999) * shells), s or 0), w) for i, j, d, w, s in rows if i == row]
        mass = {st: sum(w for *_, t, w in own if t == st) for *_, st, _ in own}
        order = sorted(mass, key=lambda st: (race(uniform(seed + 1, row, st[0] * 100_000 + st[1]), mass[st]), st))[:most]
        best = sorted(min((k, j) for k, j, t, _ in own if t == st) for st in order)
        rest = sorted((k, j) for k, j, _, _ in own if (k, j) not in best)
        out |= {(row, j) for _, j in (best + rest)[:most]}
    return out


@pytest.mark.parametrize(("most", "shells"), [(1, 1), (3, 4), (7, 2), (50, 3)])
def test_cap_equals_brute_force(spark, most, shells):
    rng = random.Random(most)
    rows = [(i, j, rng.uniform(0, 11), rng.choice([0.1, 1.0, 5.0]), rng.choice([0, 1, 2, None])) for i in range(12) for j in rng.sample(range(200), rng.randrange(1, 60))]
    edges = spark.createDataFrame(rows, "row_idx long, neighbor long, distance double, weight double, state int").withColumn("notes", F.create_map(F.lit("j"), "neighbor"))
    found = measures.cap_neighbors(edges.repartition(5), 10.0, most, shells).collect()
    assert {(r.row_idx, r.neighbor) for r in found} == brute_cap(rows, 10.0, most, shells) and all(r.notes == {"j": r.neighbor} for r in found)
    assert len(found) == len({(r.row_idx, r.neighbor) for r in found})


def test_a_dense_neighborhood_does_not_travel_whole(spark):
    """Of 40,000 edges of two rows in eight partitions, each task sends a row's best draws and one row a stratum."""
    edges = spark.range(40_000, numPartitions=8).select((F.col("id") % 2).alias("row_idx"), F.col("id").alias("neighbor"), (F.col("id") % 97 / 10).alias("distance"), F.lit(1.0).alias("weight"))
    capped = measures.cap_neighbors(edges, 10.0, 5, shells=3)
    assert len(capped.collect()) == 10
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    written = sum(int(x) for x in shuffled_rows(capped))
    assert 0 < written <= 2 * 8 * (3 + 5) + 100


def shuffled_rows(df):
    """The rows that each shuffle of an executed plan wrote."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "ShuffleExchangeExec":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_medians_draw_by_a_threshold(spark):
    """The rows with the least draws are the same however many lie below the threshold."""
    from nichewright.functions.portable import least_drawn, uniform

    rows = spark.range(20_000, numPartitions=7).withColumn("u", uniform(5, F.col("id")))
    want = [r.id for r in sorted(rows.collect(), key=lambda r: (r.u, r.id))[:40]]
    assert [r.id for r in least_drawn(rows, "u", ["id"], 40).collect()] == want
    few = rows.withColumn("u", F.col("u") / 2 + 0.5)  # nothing lies below
    assert [r.id for r in least_drawn(few, "u", ["id"], 40).collect()] == want
    assert least_drawn(rows.limit(3), "u", ["id"], 40).count() == 3 and least_drawn(rows.limit(0), "u", ["id"], 40).count() == 0


def test_isolated_policies(spark):
    cells = cells_of(spark, [(0, "a", 0, 0), (1, "a", 100, 0)])
    edges = neighbors.radius_edges(cells, 1.0).withColumn("weight", F.lit(1.0))
    of = lambda policy: {r.row_idx: (r.neighbor, r.mass) for r in measures.assemble(cells, edges, False, policy).collect()}
    assert of("anchor_fallback") == {0: (0, 1.0), 1: (1, 1.0)} and of("zero_dummy") == {0: (-1, 1.0), 1: (-1, 1.0)}
    with pytest.raises(ValueError, match="policy"):
        measures.assemble(cells, edges, False, "other")


def packed_of(spark, seed=42, n=9, structure=None):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        m = int(rng.integers(1, 5))
        mass = rng.random(m)
        rows.append((i, m, (mass / mass.sum()).tolist(), rng.normal(size=m * 3).tolist(), rng.normal(size=m * 2).tolist()))
    df = spark.createDataFrame(rows, "row_idx long, m int, masses array<double>, tokens array<double>, rel array<double>")
    return rows, structures.packed_structures(df, structure) if structure else df


def cost_of(rows, i, j):
    (ma, ta), (mb, tb) = ((np.array(rows[k][2]), np.reshape(rows[k][3], (-1, 3))) for k in (i, j))
    return kernels.cost_matrix(ta, tb), ma, mb


@pytest.mark.parametrize("block", [1, 3, 64])
def test_pairs_equal_single_kernels_whatever_the_blocks(spark, block):
    rows, packed = packed_of(spark)
    got = {(r.i, r.j): r.cost for r in transport.pair_costs(packed, epsilon=0.3, sweeps=4, block=block).collect()}
    assert got == pytest.approx({(i, j): float(kernels.sinkhorn_cost(*cost_of(rows, i, j), 0.3, 4)) for i in range(9) for j in range(i + 1, 9)})


def test_cross_is_part_of_all_pairs_and_reuses_self_costs(spark):
    _, packed = packed_of(spark)
    both = {(r.i, r.j): r.cost for r in transport.distances(packed, epsilon=0.3, sweeps=5, block=4).collect()}
    reference = packed.where("row_idx >= 6")
    own = transport.self_costs(packed, 0.3, 5).persist()
    cross = transport.distances(packed, reference, own=own, other_own=own.where("row_idx >= 6"), epsilon=0.3, sweeps=5).collect()
    assert len(cross) == 27 and all(r.cost == pytest.approx(both[r.i, r.j]) for r in cross if r.i < r.j)
    assert all(r.cost == pytest.approx(0, abs=1e-12) for r in cross if r.i == r.j)
    for bad in (own.where("row_idx > 0"), own.withColumn("self_cost", F.lit(-1.0)), own.withColumn("self_cost", F.lit(float("nan")))):
        with pytest.raises(ValueError, match="self costs"):
            transport.check_self_costs(bad, packed)


def test_fgw_pairs(spark):
    rows, packed = packed_of(spark, structure="complete_euclidean")
    got = {(r.i, r.j): r.cost for r in transport.pair_costs(packed, measure="fgw", epsilon=0.4, sweeps=3, rounds=2, alpha=0.5, block=4).collect()}
    made = [kernels.structure(np.reshape(r[4], (-1, 2)), "complete")[0] for r in rows]
    for i, j in ((0, 1), (2, 7), (5, 8)):
        cost, ma, mb = cost_of(rows, i, j)
        assert got[i, j] == pytest.approx(float(kernels.fgw_cost(cost, made[i], made[j], ma, mb, 0.5, 0.4, 3, 2)))
    assert len(got) == 36 and np.isfinite(list(got.values())).all()


def test_packed_structures_equal_the_kernel(spark):
    rows, packed = packed_of(spark, structure="knn_shortest_path")
    for r in packed.collect():
        assert np.allclose(r.structure, kernels.structure(np.reshape(rows[r.row_idx][4], (-1, 2)), "knn")[0].ravel())


def test_guards_and_estimates():
    # 8 rows make 36 pairs with themselves; each has 4 x 4 elements, 7 sweeps, and 3 rounds of 4 x 4 x 4 for the structures.
    assert transport.pairwise_work(8, 4, 7) == {"pairs": 36, "elements": 36 * 16, "work": 36 * 16 * 7}
    fgw = transport.pairwise_work(8, 4, 7, 3)
    assert (fgw["structure_work"], fgw["sinkhorn_work"]) == (36 * 3 * 64, 36 * 16 * 7 * 3)
    assert transport.cross_work(9, 11, 2, 3, 13)["work"] == 9 * 11 * 2 * 3 * 13
    with pytest.raises(ValueError, match="units of work"):
        transport.admit({"work": 11}, 10)
    with pytest.raises(ValueError, match="exact run"):
        transport.admit({"work": 1}, 10, 6000, 5000)
    transport.admit({"work": 11}, 10, 6000, 5000, force=True)
    assert transport.block_size(33, 64) == 64 and transport.block_size(33, 10**6, 1.0) < 10**6 and transport.block_size(33, 0, 1.0) > 64
    with pytest.raises(ValueError, match="kernel"):
        NicheConfig(kernel="other")
    with pytest.raises(ValueError, match="radius"):
        NicheConfig(radius=0)


def test_work_by_sample_equals_the_estimates(spark):
    sizes = spark.createDataFrame([("a", 7, 3), ("b", 1, 1), (None, 40, 9)], "sample_id string, n long, support long")
    for rounds in (0, 4):
        for r in transport.planned(sizes, 6, rounds, block=500, memory_gib=0.001).collect():
            want = transport.pairwise_work(r.n, r.support, 6, rounds)
            assert (r.pairs, r.work) == (want["pairs"], want["work"]) and r.block == transport.block_size(r.support, 500, 0.001, rounds > 0)


def test_integer_lists():
    assert parse_int_list("2:4") == (2, 3, 4) and parse_int_list("12-9") == (12, 11, 10, 9) and parse_int_list("3,11:12") == (3, 11, 12) and parse_int_list("7") == (7,)


def test_clusters_of_points_on_a_line(spark):
    distance = relation(spark, LINE)
    for labels in (clustering.agglomerate(distance, ids(spark, 4), (2,)), clustering.kmedoids(distance, ids(spark, 4), 2)[0]):
        of = {r.row_idx: r.niche for r in labels.collect()}
        assert of[0] == of[1] != of[2] == of[3]


def naive_linkage(matrix, k):
    groups = [[i] for i in range(len(matrix))]
    while len(groups) > k:
        _, a, b = min((np.mean([matrix[i][j] for i in groups[a] for j in groups[b]]), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("tail", [2, 12, 64])
def test_linkage_equals_the_naive_one(spark, tail):
    """Whether merges are found in rounds or on the driver; ids needn't be dense."""
    x = np.random.default_rng(2).normal(size=(30, 3))
    d = apart(x)
    name = lambda c: (F.col(c) * 7 + 3).alias(c)
    distance, rows = relation(spark, d).select(name("i"), name("j"), "cost"), ids(spark, 30).select(name("row_idx"))
    found = clustering.agglomerate(distance, rows, (2, 5, 11, 29), tail).collect()
    for k in (2, 5, 11, 29):
        of = {(r.row_idx - 3) // 7: r.niche for r in found if r.k == k}
        assert {frozenset(i for i in of if of[i] == c) for c in range(k)} == naive_linkage(d, k)
        assert list(dict.fromkeys(of[i] for i in range(30))) == list(range(k))


def test_linkage_of_ties_and_of_lacking_pairs(spark):
    """On a grid all nearest distances are equal; rounds must still end, with as many niches as asked for."""
    d = apart([(i // 6, i % 6) for i in range(36)])
    found = clustering.agglomerate(relation(spark, d), ids(spark, 36), (3, 9), tail=4).collect()
    assert [len({r.niche for r in found if r.k == k}) for k in (3, 9)] == [3, 9] and len(found) == 72
    of = {k: {r.row_idx: r.niche for r in found if r.k == k} for k in (3, 9)}
    assert len({(of[3][i], of[9][i]) for i in range(36)}) == 9  # one dendrogram: the nine lie within the three
    with pytest.raises(ValueError, match="one distance"):
        clustering.agglomerate(relation(spark, d).where("i > 0"), ids(spark, 36), (3,))


def ring_of_groups(rng, groups, size):
    """A graph of dense groups that are joined in a ring by weak edges, and the groups."""
    n = groups * size
    a = np.zeros((n, n))
    for g in range(groups):
        own = slice(g * size, g * size + size)
        a[own, own] = rng.random((size, size)) < 0.6
    a = np.maximum(a, a.T) * 1.0
    for g in range(groups):
        i, j = g * size, (g * size + size + 1) % n
        a[i, j] = a[j, i] = 0.2
    np.fill_diagonal(a, 0)
    return a


def modularity_of(a, labels):
    same = labels[:, None] == labels[None]
    volume = a.sum(1)
    return float((a * same).sum() / a.sum() - sum(volume[labels == c].sum() ** 2 for c in set(labels.tolist())) / a.sum() ** 2)


def connected(a, members):
    seen, stack = {members[0]}, [members[0]]
    while stack:
        for j in np.flatnonzero(a[stack.pop()]):
            if j in set(members) - seen:
                seen.add(int(j))
                stack.append(int(j))
    return len(seen) == len(members)


@pytest.mark.parametrize("tail", [0, 10, 256])
def test_communities_on_edges_are_as_good_as_on_a_matrix(spark, tail):
    rng = np.random.default_rng(9)
    a = ring_of_groups(rng, 8, 9)
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, affinity double")
    rows = clustering.community_edges(edges, ids(spark, 74), tail=tail)
    of = np.array([r.niche for r in rows.orderBy("row_idx").collect()])
    assert len(of) == 74 and of[72] != of[73] and (of == of[72]).sum() == 1  # rows without an edge stand alone
    labels = of[:72]
    assert modularity_of(a, labels) >= 0.99 * modularity_of(a, clustering.communities(a))
    assert all(connected(a, np.flatnonzero(labels == c).tolist()) for c in set(labels.tolist()))
    assert clustering.modularity(edges, rows).first()["modularity"] == pytest.approx(modularity_of(a, labels))
    assert list(dict.fromkeys(of.tolist())) == list(range(of.max() + 1))


def test_selection_finds_the_three_groups(spark):
    """Twelve points in three tight groups far from each other; four candidates."""
    rng = np.random.default_rng(11)
    points = np.concatenate([centre + rng.normal(size=(4, 2)) for centre in ([0, 0], [90, 0], [30, 70])])
    table, labels = clustering.select_model(relation(spark, apart(points)), ids(spark, 12), (2, 3, 4, 6))
    of = [r.niche for r in labels.orderBy("row_idx").collect()]
    assert table.where("best").first()["k"] == 3 and of == [0] * 4 + [1] * 4 + [2] * 4
    with pytest.raises(ValueError, match="candidate"):
        clustering.candidate_counts((1, 9), 6)


def test_kmedoids_and_farthest_first_by_brute_force(spark):
    x = np.random.default_rng(5).normal(size=(25, 2))
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    chosen = [int(d.mean(1).argmin())]
    while len(chosen) < 4:
        chosen.append(int(d[:, chosen].min(1).argmax()))
    assert clustering.farthest_first(relation(spark, d), ids(spark, 25), 4) == chosen
    medoids = list(chosen)
    for _ in range(50):
        near = d[:, medoids].argmin(1)
        moved = [int(min(np.flatnonzero(near == c), key=lambda i: (d[i, near == c].sum(), i))) for c in range(4)]
        if moved == medoids:
            break
        medoids = moved
    labels, found = clustering.kmedoids(relation(spark, d), ids(spark, 25), 4)
    assert found == medoids and [r.niche for r in labels.orderBy("row_idx").collect()] == near.tolist()


def test_singletons_score_nothing(spark):
    """On a line: rows 0 and 1 are 2 apart, rows 2 and 3 follow at 13 and 15, and row 4 stands alone at 40."""
    distance = relation(spark, apart([0, 2, 13, 15, 40]))
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)], "row_idx long, niche int")
    score = {r.row_idx: r.score for r in metrics.assignment_score(distance, labels).collect()}
    assert score == pytest.approx({0: (14 - 2) / 14, 1: (12 - 2) / 12, 2: (12 - 2) / 12, 3: (14 - 2) / 14, 4: 0.0})
    one = labels.withColumn("niche", F.lit(0))
    assert {r.score for r in metrics.assignment_score(distance, one).collect()} == {1.0}
    with pytest.raises(ValueError, match="metric"):
        metrics.metric_names(("other",))
    assert metrics.metric_names(("Medoid-Davies-Bouldin", "db", "silhouette")) == ("davies_bouldin", "silhouette")


def test_knn_graph_is_sparse_and_symmetric(spark):
    """The nearest of (0, 0) and (3, 0) are each other, that of (3, 4) is (3, 0), and the last two are a pair of their own."""
    distance = relation(spark, apart([(0, 0), (3, 0), (3, 4), (10, 4), (10, 5)]))
    graph = {(r.i, r.j): r.cost for r in graphs.knn_distance_graph(distance, 1).collect()}
    half = {(0, 1): 3, (1, 2): 4, (3, 4): 1}
    assert graph == half | {(j, i): d for (i, j), d in half.items()}


def test_communities_of_two_cliques():
    a = np.zeros((10, 10))
    a[:5, :5] = a[5:, 5:] = 1
    a[4, 5] = a[5, 4] = 0.1
    assert clustering.communities(a).tolist() == [0] * 5 + [1] * 5
    assert clustering.communities(np.zeros((3, 3))).tolist() == [0, 1, 2]


def test_medoid_assignment(spark):
    """Five cells and three medoids on a line; the margin is worked out cell by cell."""
    cells, medoid = [0.0, 2.0, 5.0, 11.0, 6.9], {0: 1.0, 1: 6.0, 2: 8.0}
    cross = spark.createDataFrame([(i, j, abs(x - y)) for i, x in enumerate(cells) for j, y in medoid.items()], "i long, j long, cost double")
    names = spark.createDataFrame([(0, 7), (1, 8), (2, 9)], "medoid long, niche int")
    got = {r.row_idx: (r.nearest, r.niche, r.score) for r in assignment.assign_by_medoids(cross, names, 0.3).collect()}
    for i, x in enumerate(cells):
        (d1, j), (d2, _) = sorted((abs(x - y), j) for j, y in medoid.items())[:2]
        margin = (d2 - d1) / (d2 + 1e-8)
        assert got[i] == (j, 7 + j if margin >= 0.3 else -1, pytest.approx(margin))
    assert got[4][:2] == (1, -1) and got[3][:2] == (2, 9)
    single = assignment.assign_by_medoids(cross, names.where("medoid = 1")).collect()
    assert {r.score for r in single} == {1.0}


def test_colours():
    colours = assignment.label_colors([f"ON{i}" for i in range(15)])
    assert len(set(colours.values())) == 15 and colours["ON12"] == "#ff7f00" and colours == assignment.label_colors(list(reversed(colours)))


def test_embedding_states(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=(80, 5)) @ np.diag([5, 3, 1, 1, 0]) + 2
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_idx long, z array<double>")
    state = features.fit_embedding(rows, method="pca", dimensions=3)
    got = np.array([r.e for r in rows.select("row_idx", state.transform(F.col("z")).alias("e")).orderBy("row_idx").collect()])
    scale = x.std(0)
    z = (x - x.mean(0)) / np.where(scale > 1e-8, scale, 1)
    want = z @ np.linalg.svd(z - z.mean(0), full_matrices=False)[2][:3].T
    want = (want - want.mean(0)) / want.std(0)
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    state.save(spark, str(tmp_path / "state"))
    assert features.EmbeddingState.load(spark, str(tmp_path / "state")) == state
    identity = features.fit_embedding(rows, method="precomputed", standardise=False)
    assert rows.select(identity.transform(F.col("z")).alias("e")).first()["e"] == pytest.approx(x[0].tolist())
    with pytest.raises(NotImplementedError):
        features.fit_embedding(rows, method="scvi")
    with pytest.raises(Exception, match="dimensions"):
        spark.createDataFrame([([1.0],)], "z array<double>").select(state.transform(F.col("z"))).collect()
    with pytest.raises(ValueError, match="UMAP"):
        features.resolve_feature("X_umap_3d")
    assert features.resolve_feature("X_umap_3d", allow_umap=True) and not features.resolve_feature("X_pca")
    assert features.svd_request({"NICHE_X_SVD_COMPONENTS": "1", "NICHE_X_TARGET_SUM": "x"}) == {"target_sum": 1e4, "use_svd": True, "components": 2, "n_iter": 7, "random_state": 1337}


def test_notes_and_kinds():
    assert features.provenance("pca", 2, "batch")["warning"] and not features.provenance("pca", 1)["warning"]
    assert features.feature_kind("X", True, True) == "full_gene_runtime_svd" and features.feature_kind("X_pca", False) == "obsm" and features.feature_kind("X_umap", False) == "umap_embedding"


def test_node_features(spark):
    rows = spark.createDataFrame([(0, 0, 1.0, [1.0, 2.0], 3.0, 4.0, 5.0)], "row_idx long, neighbor long, mass double, z array<double>, rx double, ry double, rr double")
    of = lambda mode: measures.scaled_tokens(rows, (1.0, 1.0, 1.0), (1.0, 1.0, 1.0), mode).first()["token"]
    assert (of("full_token"), of("expression_only"), of("expression_plus_radial")) == ([1, 2, 3, 4, 5], [1, 2], [1, 2, 5])
    with pytest.raises(ValueError, match="node features"):
        of("other")


def test_external_vectors_must_fit(spark):
    cells = spark.createDataFrame([("f", "a"), ("f", "b")], "source_file string, cell_id string")
    outer = spark.createDataFrame([("f", "b", [1.0, 2.0, 3.0]), ("f", "a", [4.0, 5.0, 6.0])], "source_file string, cell_id string, z array<double>")
    assert {r.cell_id: r.z[0] for r in bundle.align_external(cells, outer).collect()} == {"a": 4.0, "b": 1.0}
    for bad, message in ((outer.limit(1), "one to one"), (outer.unionByName(outer), "one to one"), (outer.withColumn("z", F.slice("z", 1, 2)), "dimensions")):
        with pytest.raises(ValueError, match=message):
            bundle.align_external(cells, bad)


def test_tiles_keep_samples_apart(spark):
    cells = cells_of(spark, [(i, s, i * 10, i) for i, s in enumerate("aabbccd")])
    moved = pooling.translate(cells, pooling.tile_layout(pooling.sample_summary(cells), gap=5)).collect()
    at = {r.sample_id: (r.layout_col, r.layout_row) for r in moved}
    assert at == {"a": (0, 0), "b": (1, 0), "c": (0, 1), "d": (1, 1)}
    assert {r.pooled_x for r in moved if r.sample_id == "b"} == {15.0, 25.0}


def test_pooling_rejects_what_does_not_fit(spark):
    cells = cells_of(spark, [(0, "a", 0, 0)]).withColumn("cell_id", F.lit("c"))
    with pytest.raises(KeyError):
        pooling.pool([("a", cells.drop("x"))])
    with pytest.raises(ValueError, match="nothing"):
        pooling.pool([])
    twice = spark.createDataFrame([("f", "c"), ("f", "c")], "source_file string, cell_id string")
    with pytest.raises(ValueError, match="one to one"):
        pooling.distribute(twice, twice.limit(1))


def test_instances_stay_within_labels(spark):
    labels = spark.createDataFrame([(i, int(i >= 3)) for i in range(6)], "row_idx long, niche int")
    edges = spark.createDataFrame([(0, 1), (1, 3), (3, 4), (4, 3)], "row_idx long, neighbor long")
    got = {r.row_idx: (r.instance, r.name) for r in graphs.instances(labels, edges).collect()}
    assert got == {0: (0, "ON0_0"), 1: (0, "ON0_0"), 2: (1, "ON0_1"), 3: (2, "ON1_0"), 4: (2, "ON1_0"), 5: (3, "ON1_1")}


def test_stream_assigns_like_a_table(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "row_idx long, z array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    reference = rows.where("row_idx in (2, 15)")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assign_stream(stream, reference, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = {r.row_idx: r.landmark for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: 2 if i <= 8 else 15 for i in range(20)}


def test_sparse_svd_equals_the_dense_one(spark):
    rng = np.random.default_rng(6)
    x = (rng.poisson(0.4, size=(90, 40)) * rng.integers(0, 2, size=(90, 1)) * np.linspace(3, 0.2, 40)).astype(float)
    x[:, :3] += rng.normal(size=(90, 1)) * [9, 5, 2]
    genes = [f"g{k:02d}" for k in range(40)]
    long = [(i, genes[k], float(v)) for i, own in enumerate(x) for k, v in enumerate(own) if v] + [(90, None, 1.0), (91, "g01", None), (92, "g01", 2.0), (92, "g01", 3.0)]
    x = np.vstack([x, np.zeros((3, 40))])
    x[92, 1] = 5
    rows = features.sparse_rows(spark.createDataFrame(long, "row_idx long, gene string, normalised double").repartition(3), genes)
    of = lambda df: np.array([r.z for r in df.orderBy("row_idx").collect()])
    kept = [i for i in range(93) if x[i].any() or i >= 90]
    assert np.allclose(of(features.dense_rows(rows, 40)), x[kept])
    axes = features.sparse_svd(rows, 40, 4)
    want = np.linalg.svd(x)[2][:4].T
    assert np.allclose(np.abs((axes * want).sum(0)), 1, atol=1e-5)
    assert np.allclose(of(features.sparse_project(rows, axes)), x[kept] @ axes)
    variance, share = features.sparse_variance(rows, axes)
    assert np.allclose(variance, (x[kept] @ axes).var(0)) and np.allclose(share, (x[kept] @ axes).var(0) / x[kept].var(0).sum())
    assert features.sparse_svd(rows.limit(0), 40, 2).shape == (40, 2) and features.sparse_variance(rows.limit(0), axes)[1].tolist() == [0.0] * 4
    with pytest.raises(ValueError, match="numbers"):
        features.sparse_svd(rows, features.MOST_NUMBERS, 4)


@pytest.mark.parametrize("gathered", [1, 37, 10**6])
def test_sparse_products_equal_dense_ones(monkeypatch, gathered):
    """However few numbers are gathered at once; empty rows, places that repeat in a row, and rows longer than a step."""
    monkeypatch.setattr(features, "GATHERED", gathered)
    rng = np.random.default_rng(4)
    lengths = np.array([0, 3, 0, 0, 11, 1, 25, 0])
    start = np.concatenate([[0], np.cumsum(lengths)])
    at, w, q = rng.integers(0, 9, start[-1]), rng.normal(size=start[-1]), rng.normal(size=(9, 3))
    x = np.zeros((8, 9))
    np.add.at(x, (np.repeat(np.arange(8), lengths), at), w)
    assert np.allclose(features._product(q, at, w, start), x @ q)
    y = rng.normal(size=(8, 3))
    assert np.allclose(features._back(y, at, w, start, np.zeros((9, 3))), x.T @ y)
    assert np.isclose((features._merged(at, w, start) ** 2).sum(), (x**2).sum())


def test_embedding_of_nothing_and_of_nulls(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [3.0, 1.0]), (3, [0.0, 5.0])], "row_idx long, z array<double>")
    state = features.fit_embedding(rows, method="pca", dimensions=2)
    assert state == features.fit_embedding(rows.dropna(), method="pca", dimensions=2)
    with pytest.raises(ValueError, match="no vectors"):
        features.fit_embedding(rows.limit(0))
