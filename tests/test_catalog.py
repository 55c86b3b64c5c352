"""Every registered query of the library on the smallest tables, against its SQL where it has one."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from nichewright import catalog, views
from nichewright.functions import kernels
from nichewright.operators import assignment, clustering

TABLES = "region nation customer supplier part orders lineitem events embeddings"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(row):
    return tuple(None if v is None else v if not isinstance(v, float) else round(v, 5) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, sql, name):
    want = sql.execute(catalog.ORACLE_SQL[name]).fetchall()
    columns = [c[0] for c in sql.description]
    got = catalog.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    a, b = (sorted(map(plain, rows), key=str) for rows in (got.select(*columns).collect(), want))
    assert len(a) == len(b) and all(x == y or all(p == q or (isinstance(p, float) and math.isclose(p, q, abs_tol=2e-5)) for p, q in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True))


def test_names():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.fixture(scope="module")
def matrix(spark):
    rows = views.vectors(spark, SMALL).orderBy("row_idx").collect()
    x = np.array([r.z for r in rows])
    return np.array([r.row_idx for r in rows]), ((x[:, None] - x[None]) ** 2).sum(-1)


def test_clusterings_on_the_whole_table(spark, matrix):
    ids, d = matrix
    chosen = [int(d.mean(1).argmin())]
    while len(chosen) < 6:
        chosen.append(int(d[:, chosen].min(1).argmax()))
    assert [r.row_idx for r in catalog.farthest_first(spark, SMALL).orderBy("place").collect()] == ids[chosen].tolist()
    labels = np.array([r.niche for r in catalog.kmedoids(spark, SMALL).orderBy("row_idx").collect()])
    medoids = [min(np.flatnonzero(labels == c), key=lambda i: (d[i, labels == c].sum(), i)) for c in range(6)]
    assert (labels == d[:, medoids].argmin(1)).all()
    got = catalog.agglomerative_labels(spark, SMALL).collect()
    merges = sorted(clustering.linkage(d), key=lambda m: m[2])
    for k in (6, 10):
        root = list(range(len(ids)))
        for a, b, _ in merges[: len(ids) - k]:
            root = [root[a] if r == root[b] else r for r in root]
        first = {r: n for n, r in enumerate(dict.fromkeys(root))}
        assert [r.niche for r in sorted(r for r in got if r.k == k)] == [first[r] for r in root]
    table = catalog.model_selection(spark, SMALL).collect()
    assert [r.k for r in table if r.best] == [min(table, key=lambda r: (r.mean_rank, r.k)).k]
    found = np.array([r.niche for r in catalog.leiden_labels(spark, SMALL).orderBy("row_idx").collect()])
    assert sorted(set(found.tolist())) == list(range(found.max() + 1)) and 1 < found.max() + 1 < len(ids)


@pytest.mark.parametrize(("name", "mode", "options"), [("structure_knn_shortest_path", "knn", {"knn": 2}), ("structure_radius_shortest_path", "radius", {"fraction": 0.5})])
def test_shortest_paths_on_the_whole_table(spark, name, mode, options):
    rel = {r.row_idx: np.reshape(r.rel, (-1, 2)) for r in catalog._packed(spark, SMALL).collect()}
    got = {}
    for r in catalog.QUERIES[name](spark, SMALL).collect():
        got.setdefault(r.row_idx, np.zeros((len(rel[r.row_idx]),) * 2))[r.i, r.j] = r.value
    assert got.keys() == rel.keys()
    for row, x in rel.items():
        assert np.allclose(got[row], kernels.structure(x, mode, **options)[0], atol=1e-6)


def test_landmarks_states_and_convergence(spark):
    cells = {r.row_idx: r.sample_id for r in views.cells(spark, SMALL).collect()}
    chosen = catalog.kmeans_landmarks(spark, SMALL).collect()
    hashed = assignment.sample_landmarks(views.cells(spark, SMALL), 30).collect()
    assert len({r.row_idx for r in chosen}) == len(chosen) == 30 and all(cells[r.row_idx] == r.sample_id for r in chosen)
    assert Counter(r.sample_id for r in chosen) == Counter(r.sample_id for r in hashed)
    states = catalog.state_labels(spark, SMALL).collect()
    assert {r.row_idx for r in states} == cells.keys() and {r.state for r in states} == set(range(6))
    found = catalog.convergence_sample(spark, SMALL).first()
    assert found.pairs == 32 * 31 // 2 and found.max_error < 1e-3


def test_rough_clusters_on_the_whole_table(spark):
    rows = catalog.rough_representatives(spark, SMALL).collect()
    assert len(rows) == views.cells(spark, SMALL).count()
    of = {r.row_idx: (r.sample_id, r.rough) for r in rows}
    assert all(of[r.representative] == (r.sample_id, r.rough) for r in rows)
    assert len(catalog.svd_embedding(spark, SMALL).collect()) == 4 * len(rows)
    d = catalog.structure_diagnostics(spark, SMALL).first()
    assert d.supports == len(rows) and 0 <= d.fraction <= 1
    assert {r.niche: r.color for r in catalog.niche_colors(spark, SMALL).collect()}["ON12"] == "#ff7f00"
