"""The near-copy stage against brute-force Jaccard over five-word shingles."""

import random

import pytest
from nichewright.llm.dedup import drop_near_copies
from nichewright.llm.simhash import fingerprint


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_brute_force(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    least = {}
    for (d, _), g in zip(rows, root, strict=True):
        least[g] = min(least.get(g, 10**9), 10**9 if d is None else d)
    return sorted(least.values())


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [512, 7])
def test_keeps_what_brute_force_keeps(spark, block):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(900)}" for _ in range(150)] for _ in range(25)]
    texts = [" ".join(b) for b in base] + [edited(rng, b, n) for n, b in enumerate(base[:8])] + [edited(rng, base[10], rng.randrange(6)) for _ in range(40)]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, " \t"), (503, texts[0]), (None, texts[1]), (504, "a b"), (505, "A b"), (2, texts[1]), (2, texts[1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, home int").repartition(5)
    out = drop_near_copies(docs, block=block)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == kept_by_brute_force(rows)


def test_stage_drops_a_copy_at_jaccard_08_beyond_four_bits(spark):
    stage = pytest.importorskip("corpus_pipeline").near_copies
    rng = random.Random(4)
    for _ in range(100):
        words = [f"w{rng.randrange(900)}" for _ in range(150)]
        a, b = " ".join(words), edited(rng, words, 3)
        if ((fingerprint(a.encode()) ^ fingerprint(b.encode())) % 2**64).bit_count() > 4 and len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)):
            break
    docs = spark.createDataFrame([(1, a), (2, b), (3, "another text of seven words in all")], "doc_id long, text string")
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == [1, 3]


def test_empty(spark):
    assert drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
