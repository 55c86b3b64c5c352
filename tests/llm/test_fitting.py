"""What the classifiers fit, in plain Python: risks, gradients, fitted weights, and the rows that fitting takes."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from nichewright.llm import quality, toxicity
from nichewright.llm.text_features import HashedWords, collect_features
from pyspark.sql import functions as F


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def adam(w, gradient, rounds, rate=0.05):
    m, v = [0.0] * len(w), [0.0] * len(w)
    for t in range(1, rounds + 1):
        g = gradient(w)
        for k in range(len(w)):
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
        w = [x - rate * (a / (1 - 0.9**t)) / (math.sqrt(b / (1 - 0.999**t)) + 1e-8) for x, a, b in zip(w, m, v, strict=True)]
    return w


def raw(w, x):
    return sum(a * b for a, b in zip(w, x, strict=False)) + w[-1]


def risk(w, positive, unlabelled, prior):
    """(risk, its negative part): the prior-corrected risks under the logistic loss."""
    plus = sum(math.log1p(math.exp(-raw(w, x))) for x in positive) / len(positive)
    minus = sum(math.log1p(math.exp(raw(w, x))) for x in unlabelled) / len(unlabelled) - prior * sum(math.log1p(math.exp(raw(w, x))) for x in positive) / len(positive)
    return prior * plus + max(0.0, minus), minus


def nnpu_gradient(w, positive, unlabelled, prior, decay):
    d = len(w) - 1
    g, negative = [0.0] * (d + 1), [0.0] * (d + 1)
    for x in unlabelled:
        for k, v in enumerate([*x, 1.0]):
            negative[k] += sigmoid(raw(w, x)) * v / len(unlabelled)
    for x in positive:
        for k, v in enumerate([*x, 1.0]):
            negative[k] -= prior * sigmoid(raw(w, x)) * v / len(positive)
            g[k] += prior * (sigmoid(raw(w, x)) - 1) * v / len(positive)
    follows = risk(w, positive, unlabelled, prior)[1] >= 0
    out = [a + b for a, b in zip(g, negative, strict=True)] if follows else [-b for b in negative]
    return [o + (decay * x if k < d else 0.0) for k, (o, x) in enumerate(zip(out, w, strict=True))]


def groups(seed, n=12, m=20, d=3):
    rng = np.random.default_rng(seed)
    return (rng.random((n, d)) < 0.6).astype(float), (rng.random((m, d)) < 0.3).astype(float)


@pytest.mark.parametrize("prior", [0.05, 0.3, 0.8])
def test_nnpu_weights_equal_plain_loops(prior):
    """At the largest prior the negative part falls below zero, so that steps are undone."""
    positive, unlabelled = groups(1)
    w, b = toxicity.fit_nnpu(positive, unlabelled, prior, rounds=60)
    start = [0.0] * 3 + [math.log(prior / (1 - prior))]
    want = adam(start, lambda w: nnpu_gradient(w, positive.tolist(), unlabelled.tolist(), prior, 2e-4), 60)
    assert np.allclose([*w, b], want, atol=1e-8)
    if prior < 0.5:
        assert risk([*w, b], positive, unlabelled, prior)[0] < risk(start, positive, unlabelled, prior)[0]


def test_the_gradient_is_that_of_the_risk():
    positive, unlabelled = groups(2)
    w, prior = [0.3, -0.2, 0.5, -0.4], 0.2
    g = nnpu_gradient(w, positive.tolist(), unlabelled.tolist(), prior, 0.0)
    for k in range(4):
        up, down = ([x + (s if j == k else 0) for j, x in enumerate(w)] for s in (1e-6, -1e-6))
        assert g[k] == pytest.approx((risk(up, positive, unlabelled, prior)[0] - risk(down, positive, unlabelled, prior)[0]) / 2e-6, abs=1e-6)


def test_pair_weights_equal_plain_loops():
    rng = np.random.default_rng(3)
    good, poor, pairs, decay = rng.normal(0.3, 1, (9, 2)), rng.normal(-0.3, 1, (7, 2)), 50, 1e-3
    draws = np.random.default_rng(7)
    first, second = draws.integers(9, size=pairs), draws.integers(7, size=pairs)
    diff = [[float(np.float32(a - b)) for a, b in zip(good[i], poor[j], strict=True)] for i, j in zip(first, second, strict=True)]

    def loss(w):
        return sum(math.log1p(math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))) for x in diff) / pairs + decay / 2 * sum(x * x for x in w)

    def gradient(w):
        out = [decay * x for x in w]
        for x in diff:
            miss = sigmoid(-sum(a * b for a, b in zip(w, x, strict=True)))
            out = [o - miss * v / pairs for o, v in zip(out, x, strict=True)]
        return out

    want = adam([0.0, 0.0], gradient, 80)
    assert np.allclose(quality.fit_pairs(good, poor, pairs=pairs, rounds=80), want, atol=1e-4)
    for k in range(2):
        up, down = ([x + (s if j == k else 0) for j, x in enumerate(want)] for s in (1e-6, -1e-6))
        assert gradient(want)[k] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)
    assert loss(want) < loss([0.0, 0.0])


def test_the_cut_is_the_quantile_of_label_0(spark):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 3)) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    model = quality.PairModel(np.zeros(1), np.ones(1), np.ones(1))
    cut = quality.with_cut(model, spark.createDataFrame(rows, "doc_id long, raw double"), labels).cut
    from nichewright.llm.text_features import fold

    known = {r.doc_id for r in spark.range(400).select(F.col("id").alias("doc_id")).where(fold(F.col("doc_id")) != 0).collect()}
    poor = sum(i % 4 == 0 for i in known)
    assert abs(sum(v < cut for i, v in rows if i in known) - poor) <= 2


def test_an_id_with_very_many_rows_gives_one(spark):
    rows = [(7, f"word{i} common") for i in range(20_000)] + [(8, "other text"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    ids = spark.createDataFrame([(7, 1), (8, 0), (9, 0)], "doc_id long, group int")
    found = collect_features(docs, ids, HashedWords, pa.int32())
    assert [(i, g, len(x)) for i, g, x in found] == [(7, 1, 2), (8, 0, 2), (9, 0, 0)]
    again = collect_features(docs.repartition(2), ids, HashedWords, pa.int32())
    assert all((a[2] == b[2]).all() for a, b in zip(found, again, strict=True))


def test_a_text_gives_a_bounded_number_of_words():
    raw_text = " ".join(f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd").encode()
    whole = HashedWords()(raw_text)
    assert len(whole) > 900 and (HashedWords(most_kept=50)(raw_text) == whole[:50]).all()
