import numpy as np
import pytest
from nichewright.llm import ann
from pyspark.sql import functions as F

from tests.llm.test_ann import brute, check


def clusters(seed, groups, n, d, spread, offset=0.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d)) + offset
    return list(enumerate((centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, d))).astype(np.float32).tolist()))


@pytest.mark.parametrize("spread,offset", [(1e-3, 0.0), (0.1, 0.0), (1.0, 0.0), (1e-2, 50.0)])
def test_finds_all_of_the_nearest_where_words_fit_badly(spark, spread, offset):
    rows = clusters(1, 3, 1500, 24, spread, offset)
    got, want = check(spark, rows, rerank=10, chunk=400, books=2, size=8, train_rows=200), brute(rows)
    assert got == want


def test_copies_beyond_the_reranked_ones(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 2 else [float(i % 7), 1.0, 0.5]) for i in range(900)]
    got, want = check(spark, rows, rerank=5, chunk=100, books=2, size=4), brute(rows)
    assert got == want


def test_few_rows_reach_a_bound_where_words_fit_well(spark):
    rows = spark.createDataFrame(clusters(2, 40, 2000, 16, 0.05), "vec_id long, embedding array<float>")
    index, model = ann.build_index(ann.usable(rows, F.col("embedding")), books=8, size=64)
    parts = index.orderBy("vec_id").toArrow().to_batches()
    chunk = ann._ExactChunk(model, parts)
    table = np.einsum("qd,mkd->mqk", chunk.unit[:20], model.words.astype(np.float64))
    true = chunk.unit[:20] @ chunk.unit.T
    reach = chunk.reach(table, slice(0, 2000))
    assert (reach >= true).all() and (reach >= np.sort(true, 1)[:, -6, None]).mean() < 0.1
