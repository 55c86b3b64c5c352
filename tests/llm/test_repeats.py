"""Rows that repeat an id and a text, long texts, and the joins that tables too large for a broadcast take."""

import random

import pytest
from nichewright.llm import dedup, licenses, minhash, simhash, url_filter
from nichewright.llm.minhash import MinHasher, verified_links
from pyspark.sql import functions as F


def texts(rng, n, words=60):
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(words)) for _ in range(n)]
    return base + [t + " tail" for t in base[: n // 2]]


def clusters(spark, rows):
    """read and members of one cluster from (id, text, copies of the row)."""
    read = spark.createDataFrame([(0, i, t, n > 1) for i, t, n in rows for _ in range(n)], "cluster long, id long, text string, twice boolean")
    return read.repartition(6), spark.createDataFrame([(0, i, len(t)) for i, t, _ in rows], "cluster long, id long, size int")


def forest(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in edges.collect():
        root[max(find(r.a), find(r.b))] = min(find(r.a), find(r.b))
    return {x: find(x) for x in root}


def test_repeated_rows_are_sent_once_a_task(spark):
    """20,000 rows of one text: the shuffle to the blocks has one row of each id."""
    rng = random.Random(1)
    own = texts(rng, 6)
    rows = [(i, t, 20_000 if i == 0 else 1 + (i == 1)) for i, t in enumerate(own)]
    read, members = clusters(spark, rows)
    found = verified_links(read, members, 0.8, 64, 5, 512)
    assert forest(found) == {0: 0, 6: 0, 1: 1, 7: 1, 2: 2, 8: 2}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "partial_first" in plan and plan.index("MapInArrow") < plan.index("first(text")


@pytest.mark.parametrize(("block", "most_chars"), [(512, 700), (4, 1 << 20), (512, 1 << 20)])
def test_blocks_by_rows_and_by_length_find_the_same(spark, block, most_chars):
    rng = random.Random(2)
    own = texts(rng, 12)
    read, members = clusters(spark, [(i, t, 1) for i, t in enumerate(own)])
    found = forest(verified_links(read.drop("twice"), members, 0.8, 64, 5, block, most_chars))
    assert found == {k: i for i in range(6) for k in (i, 12 + i)}


def documents(spark):
    rng = random.Random(3)
    own = texts(rng, 10)
    rows = [(i % 14, t) for i, t in enumerate(own)] + [(None, own[0])] * 40 + [(3, own[3])] * 30 + [(900, None), (901, ""), (900, None)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, twice string").repartition(5)


def plain(df):
    return sorted(map(str, df.collect()))


def test_tables_too_large_for_a_broadcast_give_the_same(spark, monkeypatch):
    docs = documents(spark)
    urls = spark.createDataFrame([(i, f"https://{h}/{p}/{i % 7}") for i, (h, p) in enumerate([(h, p) for h in ("a.com", "b.net", "c.org", "example.com", "example.net", "x") for p in ("en", "de", "es", "en/7", "q")] * 4)], "page_id long, url string")
    makes = {
        "minhash": lambda: minhash.fingerprinted(docs),
        "dedup": lambda: dedup.drop_near_copies(docs),
        "licenses": lambda: licenses.scan_licenses(docs.withColumn("text", F.concat_ws(" ", "text", F.lit(licenses.TEMPLATES[0][1])))),
        "urls": lambda: url_filter.filter_urls(urls, url_filter.RULES),
    }
    before = {n: plain(make()) for n, make in makes.items()}
    assert before["dedup"] and before["minhash"]
    for module in (minhash, dedup, licenses, url_filter, simhash):
        if hasattr(module, "few"):
            monkeypatch.setattr(module, "few", lambda rows, *_: rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {n: plain(make()) for n, make in makes.items()} == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_kept_rows_of_repeats(spark):
    kept = dedup.drop_near_copies(documents(spark)).collect()
    sets = [frozenset(MinHasher().shingles((r.text or "").encode()).tolist()) for r in kept]
    assert all(len(a & b) < 0.8 * len(a | b) for n, a in enumerate(sets) for b in sets[:n])
    assert len(kept) == 11 and not any(r.doc_id is None for r in kept)
