import random
import zlib

import numpy as np
import pytest
from nichewright.llm import quality, toxicity
from nichewright.llm.shared import table
from nichewright.llm.text_features import HashedWords, shape

SMALL = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string, score double, group string", "doc_id long, quality int, toxic int"


def auc(score, truth):
    rank = np.argsort(np.argsort(score)) + 1
    ones = truth.sum()
    return (rank[truth == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(truth) - ones))


def held_out(rows):
    return [(zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows]


@pytest.mark.parametrize(("make", "label", "cut", "least"), [(toxicity.toxicity_scores, "toxic", 0.5, 0.8), (quality.quality_scores, "quality", 0.3, 0.97)])
def test_held_out_accuracy(spark, make, label, cut, least):
    documents, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    rows = make(documents, labels).collect()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert len(rows) == documents.count() and all(held_out(rows))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id in truth]
    assert auc(np.array([r.score for r in tested]), np.array([truth[r.doc_id] for r in tested])) >= least


def odd_rows():
    rng = random.Random(3)
    plain = [" ".join(rng.choice("the of and some plain words here".split()) for _ in range(30)) for _ in range(60)]
    return [(i, t + " vile" * (i % 3 == 0), 0.5, "g") for i, t in enumerate(plain)] + [(900, None, None, None), (901, "", 1.0, "x"), (None, "vile", 0.0, ""), (1, "twice", 0.0, ""), (902, "a b " * 60000, 0.0, "")]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_nulls_repeats_and_clashing_columns(spark, module):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (2, None, None), (900, 1, 0)], LABELS)
    docs = spark.createDataFrame(odd_rows(), DOCS)
    make, drop = (toxicity.toxicity_scores, toxicity.drop_toxic) if module is toxicity else (quality.quality_scores, quality.drop_poor)
    rows = make(docs, labels).collect()
    assert len(rows) == len(odd_rows()) and all(r.score is not None for r in rows)
    assert drop(docs, labels).columns == docs.columns


@pytest.mark.parametrize("make", [toxicity.toxicity_scores, quality.quality_scores])
def test_empty_tables(spark, make):
    none, docs = spark.createDataFrame([], LABELS), spark.createDataFrame([(1, "x", 0.0, "")], DOCS)
    assert make(docs, none).count() == 1
    assert make(spark.createDataFrame([], DOCS), none).count() == 0


def test_toxic_words_decide(spark):
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], LABELS)
    docs = spark.createDataFrame(odd_rows()[:60], DOCS)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {i for i in range(60) if i % 3}


def test_nnpu_keeps_the_negative_risk_from_falling_below_zero():
    rng = np.random.default_rng(0)
    positive, unlabelled = rng.normal(1, 1, (40, 50)), rng.normal(0, 1, (60, 50))
    w, b = toxicity.fit_nnpu(positive, unlabelled, 0.3, rounds=800, decay=0)
    p, u = toxicity.sigmoid(positive @ w + b), toxicity.sigmoid(unlabelled @ w + b)
    assert -np.log(1 - u + 1e-12).mean() + 0.3 * np.log(1 - p + 1e-12).mean() > -0.2


def test_pairs_are_ranked():
    rng = np.random.default_rng(1)
    good, poor = rng.normal(0.5, 1, (300, 4)), rng.normal(-0.5, 1, (300, 4))
    w = quality.fit_pairs(good, poor)
    assert (w > 0).all() and (good @ w).mean() > (poor @ w).mean()


def test_features_of_odd_texts():
    assert HashedWords()(b"").size == 0 and not shape(b"").any()
    assert np.isfinite(shape(b"\n \n\xff" * 9)).all()
    assert HashedWords(most=1)(b"A b\xc3\xa9 a 1x").tolist() == sorted(zlib.crc32(w) & (1 << 18) - 1 for w in (b"a", b"b\xc3\xa9", b"x"))
