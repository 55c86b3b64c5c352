import math
import random
import re
from collections import Counter

import duckdb
import pytest
from nichewright.llm.mixing import Schedule, mix_plan, mixed_documents, oracle_sql

SCHEMA = "doc_id long, text string, source string, size int, target string, __r int"


def rows_of(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "é", "Z", None, "tiny"] if i % 50 else ["tiny"])
        out.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 20, 300]))) + "\t \n", source, 1, "t", 2))
    return out + [(5000, None, "a", 0, "", 0), (5001, "", "empty", 0, "", 0), (None, "x y", None, 0, "", 0), (7, "same id", "a", 0, "", 0), (7, "same id", "a", 0, "", 0), (5002, "w " * 40000, "b", 0, "", 0)]


def water(sizes, share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, full = set(order), {}
    while True:
        rest = share * sum(sizes.values()) - sum(full.values())
        total = sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] / total > most * sizes[s] + 1e-9}
        if not over:
            return full | {s: rest * weight[s] / total for s in left}
        full |= {s: most * sizes[s] for s in over}
        left -= over


@pytest.mark.parametrize("bucket", [20000, 7])
def test_plan(spark, bucket):
    rows = rows_of(400)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    plan = mix_plan(docs, bucket=bucket).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {(r[0], size(r[1])): r[2] for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += size(r[1])
    want, taken, largest = water(sizes), Counter(), Counter()
    assert Counter((r.doc_id, r["size"]) for r in plan) == Counter((r[0], size(r[1])) for r in rows)
    for r in plan:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], abs_tol=1e-6)
        assert r.taken == r["size"] * r.copies and r.taken <= 2 * r["size"]
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    mixed = mixed_documents(docs, bucket=bucket)
    assert mixed.columns == docs.columns
    copies = Counter()
    for r in plan:
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +copies


def test_plan_equals_its_sql(spark):
    rows = [r for r in rows_of(300, 4) if r[0] != 7]
    documents = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "source").toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(oracle_sql()).fetchall()
    names = [c[0] for c in con.description]
    got = mix_plan(spark.createDataFrame(rows, SCHEMA)).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_training_order_follows_the_schedule(spark):
    rows = [(i, "w " * 10, "abc"[i % 3], 0, "", 0) for i in range(3000)]
    order = [r.source for r in mixed_documents(spark.createDataFrame(rows, SCHEMA)).collect()]
    half = len(order) // 2
    early, late = Counter(order[:half]), Counter(order[half:])
    assert early["a"] > 1.4 * late["a"] and late["c"] > 1.4 * early["c"] and 0.6 < early["b"] / late["b"] < 1.7


def test_positions_invert_the_integral(spark):
    schedule = Schedule(((0.0, 0.0), (0.25, 2.0), (0.5, 1.0), (1.0, 1.0)))
    area = lambda t: 4 * t * t if t <= 0.25 else 0.25 + (t - 0.25) * 2 - 2 * (t - 0.25) ** 2 if t <= 0.5 else 0.625 + (t - 0.5)
    shares = spark.createDataFrame([(i / 40,) for i in range(41)], "u double")
    for u, t in shares.select("u", schedule.position(shares.u)).collect():
        assert math.isclose(area(t), u * area(1.0), abs_tol=1e-9)


def test_empty_and_all_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mix_plan(none).count() == 0 and mixed_documents(none).count() == 0
    assert [r.taken for r in mix_plan(spark.createDataFrame([(1, "", "a", 0, "", 0)], SCHEMA)).collect()] == [0]
