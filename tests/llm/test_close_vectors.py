import duckdb
import numpy as np
import pytest
from nichewright.llm import close_vectors as C
from nichewright.llm import queries
from pyspark.sql import functions as F


def brute(rows, t):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, label, vector)."""
    ok = [lab is not None and v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, lab, v in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, la, a) in enumerate(rows):
        for j, (_, lb, b) in enumerate(rows[:i]):
            if not (ok[i] and ok[j] and la == lb and len(a) == len(b)):
                continue
            p, q = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
            if p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= t:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    tops = [find(i) for i in range(len(rows))]
    least = {t_: min((r[0] for r, o in zip(rows, tops, strict=True) if o == t_ and r[0] is not None), default=None) for t_ in tops}
    return sorted(((r[0], n[i], least[tops[i]], r[0] is not None and r[0] == least[tops[i]]) for i, r in enumerate(rows)), key=str)


def found(spark, rows, t=0.98, kind="label int, embedding array<double>", **options):
    df = spark.createDataFrame(rows, f"vec_id long, {kind}")
    return sorted((tuple(r) for r in C.close_vectors(df, F.col("label"), F.col("embedding"), t, **options).collect()), key=str)


def near_copies(rng, sizes, d=16, noise=0.03):
    rows, i = [], 0
    for g, size in enumerate(sizes):
        centre = rng.normal(size=d)
        for _ in range(size):
            rows.append((int(i * 7 % 1009), g % 3, (centre / np.linalg.norm(centre) + noise * rng.normal(size=d)).tolist()))
            i += 1
    return rows


def test_groups_of_all_sizes(spark):
    rows = near_copies(np.random.default_rng(1), [1] * 60 + [2] * 30 + [7, 40, 90])
    assert found(spark, rows) == brute(rows, 0.98)


def test_groups_denser_than_the_window_lose_no_link(spark):
    """Windows of four and blocks of sixteen: components of 150 members are united over passes and counted in pairs of blocks."""
    rows = near_copies(np.random.default_rng(2), [150, 60, 3, 2, 1, 1])
    assert found(spark, rows, window=4, block=16, passes=25) == brute(rows, 0.98)


def test_copies_are_one_member_with_a_weight(spark):
    v, w = [1.0, 0.0, 0.0], [1.0, 0.05, 0.0]
    rows = [(i, 1, v) for i in range(50, 1450)] + [(3, 1, w), (4, 1, w), (9, 2, v), (10, 2, [2.0, 0.0, 0.0]), (11, 2, [-1.0, 0.0, 0.0]), (9, 2, v)]
    got = {r[0]: r[1:] for r in found(spark, rows)}
    assert got[77] == (1401, 3, False) and got[3] == (1401, 3, True) and got[4] == (1401, 3, False)
    assert got[9] == (2, 9, True) and got[10] == (2, 9, False) and got[11] == (0, 11, True)


def test_what_links_with_nothing(spark):
    nan = float("nan")
    v = [1.0, 1.0]
    rows = [(1, 1, v), (2, 1, v), (3, None, v), (4, None, v), (5, 1, None), (6, 1, []), (7, 1, [0.0, 0.0]), (8, 1, [nan, 1.0]), (9, 1, [None, 1.0]), (10, 1, [1.0]), (None, 1, v), (None, 5, v), (None, None, v), (2, 1, [1e200, 1e200]), (12, 1, [1e-200, 1e-200])]
    assert found(spark, rows) == brute(rows, 0.98)
    assert found(spark, [r for r in rows if r[1] is None or r[2] is None]) == brute([r for r in rows if r[1] is None or r[2] is None], 0.98)
    assert found(spark, []) == []


@pytest.mark.parametrize("label", ["string", "double"])
def test_labels_of_other_types_and_clashing_columns(spark, label):
    rows = [(1, "1", [1.0, 0.0], 0, 0), (2, "1", [1.0, 0.01], 0, 0), (3, "2", [1.0, 0.0], 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>, cid int, n_links int").withColumn("label", F.col("label").cast(label))
    assert {(r.vec_id, r.n_links, r.component_id) for r in C.close_vectors(df, F.col("label"), F.col("embedding")).collect()} == {(1, 1, 1), (2, 1, 1), (3, 0, 3)}


def test_none_below_and_all_at_the_threshold(spark):
    """At 0.6 the cosine of (1, 0) and (3, 4) / 5 is exactly the threshold."""
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [3.0, 4.0]), (3, 1, [3.0, 4.0000001])]
    assert [(r[0], r[1]) for r in found(spark, rows[:2], 0.6)] == [(1, 1), (2, 1)]
    assert [(r[0], r[2]) for r in found(spark, [rows[0], rows[2]], 0.6)] == [(1, 1), (3, 3)]


def test_forest_and_passes():
    a, b = np.array([5, 4, 3, 8, 9]), np.array([4, 3, 2, 9, 7])
    assert C.forest(a, b, 10).tolist() == [0, 1, 2, 2, 2, 2, 6, 7, 7, 7]
    counts = [C.passes_for(n, 128, 0.98) for n in (0, 100, 10_000, 10**6, 10**9)]
    assert counts == sorted(counts) and counts[0] == 4 and counts[-1] < 60


def test_query_equals_its_sql(spark, tmp_path):
    path = f"{tmp_path}/embeddings.parquet"
    rows = near_copies(np.random.default_rng(4), [1] * 20 + [2, 3, 9])
    spark.createDataFrame([(i, v, lab) for i, lab, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op12_close_vectors"]).fetchall())
    got = queries.op12_close_vectors(spark, str(tmp_path)).select(*(c[0] for c in con.description))
    assert sorted(tuple(r) for r in got.collect()) == want and sum(r[1] for r in want) > 70
