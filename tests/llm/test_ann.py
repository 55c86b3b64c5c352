import math

import duckdb
import numpy as np
from nichewright.llm import ann
from nichewright.llm.shared import table
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, score int, v int, codes string"


def brute(rows, k=5, every=50):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    d = max({len(v) for _, v in good}, key=lambda n: (sum(len(v) == n for _, v in good), -n))
    good = [(i, v) for i, v in good if len(v) == d]
    out = {}
    for q, x in good:
        if q % every == 0 and q not in out:
            scored = sorted(((-ann.cosine(x, y), i) for i, y in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def check(spark, rows, parts=3, schema=SCHEMA, **options):
    df = spark.createDataFrame([(i, v, 0, 1, 2, "") for i, v in rows], schema).repartition(parts)
    got = {}
    for r in sorted(ann.nearest(df, F.col("vec_id") % 50 == 0, F.col("embedding"), **options).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def test_equals_brute_force_where_all_are_reranked(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(260, 6)).round(2)
    x[40:110] = x[7]  # a large group of copies, with ties by id
    rows = list(zip(range(-30, 230), x.tolist())) + [(400, None), (401, []), (450, [0.0] * 6), (403, [float("nan")] + [1.0] * 5), (404, [None] + [1.0] * 5), (405, [float("inf")] + [1.0] * 5), (406, [1.0] * 4), (None, [1.0] * 6)]
    got, want = check(spark, rows, rerank=400, chunk=50), brute(rows)
    assert got == {q: w for q, w in want.items()} and set(want) == {0, 50, 100, 150, 200}


def test_ties_go_to_smaller_ids_when_few_are_reranked(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100)]
    assert {q: [i for i, _ in v] for q, v in check(spark, rows, rerank=7).items()} == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4]}


def test_few_candidates_and_none(spark):
    assert check(spark, [(0, [1.0, 0.0]), (3, [1.0, 1.0])]) == {0: [(3, ann.cosine(np.array([1.0, 0.0]), np.array([1.0, 1.0])))]}
    assert check(spark, [(0, [1.0, 0.0])]) == {} and check(spark, []) == {} and check(spark, [(1, [1.0])] * 3) == {}


def test_rows_that_share_an_id_are_candidates_but_for_the_own_row(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [0.1, 1.0]), (2, [1.0, 1.0])]
    got = sorted((i, round(s, 6)) for i, s in check(spark, rows, rerank=1, k=1)[50])
    assert got == [(1, round(1 / 1.01**0.5, 6)), (50, 1.0), (50, 1.0)]


def test_later_chunks_send_back_what_reaches_the_bound_only(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(3200, 8)).tolist())], "vec_id long, embedding array<double>")
    index, model = ann.build_index(ann.usable(rows, F.col("embedding")), train_rows=500, books=4, size=16)
    queries = index.where("vec_id % 100 = 0").select("row", "vec_id", "v")
    whole, cut = (ann.candidates(index, queries, model, 20, chunk) for chunk in (1 << 20, 50))
    assert sorted(whole.collect()) == sorted(cut.collect()) and whole.count() == 20 * 32
    sent = {n: ann._searched(index, queries.withColumn("bound", F.lit(n)), model, 20, 64, range(8, 64)).count() for n in (float("-inf"), 2.0)}
    assert sent == {float("-inf"): 20 * 32 * 56, 2.0: 0}
    ahead = ann._searched(index, queries.withColumn("bound", F.lit(float("-inf"))), model, 20, 64, range(8))
    bound = ahead.groupBy("asked").agg(F.sort_array(F.collect_list("approx"), False)[19].alias("bound"))
    bounded = queries.join(bound.withColumnRenamed("asked", "row"), "row")
    assert ann._searched(index, bounded, model, 20, 64, range(8, 64)).count() < 2 * 20 * 32 * 8


def test_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = con.execute(ann.oracle_sql()).fetchall()
    got = ann.nearest(table(spark, "/root/testdata/sf0.01", "embeddings"), F.col("vec_id") % 50 == 0, F.col("embedding")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 50


def test_components_of_any_size(spark):
    for by in (1e-300, 1e300):
        got = check(spark, [(0, [by, 0.0]), (1, [by, by]), (2, [0.0, by])], schema=SCHEMA.replace("float", "double"))
        assert [(i, round(s, 12)) for i, s in got[0]] == [(1, round(0.5**0.5, 12)), (2, 0.0)]


def test_results_depend_on_neither_batches_nor_partitions_nor_chunks(spark):
    rng, key = np.random.default_rng(4), "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = list(enumerate(rng.normal(size=(3000, 8)).round(3).tolist()))
    before, found = spark.conf.get(key), []
    try:
        for size, parts, chunk in ((100, 1, 400), (1000, 8, 1 << 20), (20000, 32, 900)):
            spark.conf.set(key, size)
            found.append(check(spark, rows, parts, rerank=20, chunk=chunk, train_rows=500))
    finally:
        spark.conf.set(key, before)
    assert found[0] == found[1] == found[2] and len(found[0]) == 60


def test_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    got, want = check(spark, rows), brute(rows)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * 5 * len(want)


def test_beam_search_finds_better_sums():
    rng = np.random.default_rng(0)
    x = ann._unit(rng.normal(size=(600, 12)))
    model = ann.Codebooks.fit(x, books=4, size=16)
    loss = []
    for beam in (1, 8):
        codes, length = model.encode(x, beam)
        total = sum(model.words[m][codes[:, m]] for m in range(4))
        assert np.allclose(length, np.linalg.norm(total, axis=1), atol=1e-5)
        loss.append(((x - total) ** 2).sum())
    assert loss[1] < loss[0]
