"""Quality scores by Bradley-Terry ranking of document pairs.

Every preferred document (label 1) of a pair should outscore the other (label 0).  A linear score over bounded layout and
repetition features is fitted by the logistic loss on feature differences, and the cut between good and poor is a quantile of
the scores of all documents that may be learned from: the one that splits off as large a share as label 0 has there.

Fitting uses at most ``most_each`` documents of either label, picked by a keyed hash; the quantile is taken over all of them from a
histogram of fixed size; scoring reads every text whole, in one pass without a shuffle.

Cases: a null or empty text has features 0; rows that share an id are scored each on its own, and fitting takes one of
them; without both labels every score
is 0.5; an empty table gives an empty result; other columns pass through unread.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichewright.llm.shared import materialise, text_batches
from nichewright.llm.text_features import SHAPE, collect_features, fold, hashed_sample, score_texts, shape, training_labels

#: ``predicted`` is 1 from this score on; the quantile cut is mapped to it.
CUT = 0.3
#: Raw scores are cut to [-EDGE, EDGE] and counted in steps of STEP for the quantile.
EDGE, STEP = 50.0, 0.005


@dataclass(frozen=True)
class PairModel:
    """score = sigmoid(raw - cut + logit(CUT)) with raw = weights . (features - mean) / scale; no weights: nothing was learned."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    cut: float = 0.0

    def raw_scorer(self):
        if self.weights is None:
            return lambda raw: 0.0
        by, at = self.weights / self.scale, float(self.weights @ (self.mean / self.scale))
        return lambda raw: float(np.clip(expand(shape(raw)) @ by - at, -EDGE, EDGE))

    def scorer(self):
        if self.weights is None:
            return lambda raw: 0.5
        raw_score, shift = self.raw_scorer(), self.cut - np.log(CUT / (1 - CUT))
        return lambda raw: float(1 / (1 + np.exp(-(raw_score(raw) - shift))))


#: Products of pairs of these features are features too: repetition and signs weigh by the length of the text.
CROSSED = [SHAPE.index(n) for n in ("log_words", "distinct_words", "repeated_next", "commonest_word", "word_ends_in_sign", "lone_signs")]


def expand(x: np.ndarray) -> np.ndarray:
    """The features and the products of the crossed ones, along the last axis."""
    c = x[..., CROSSED]
    i, j = np.triu_indices(len(CROSSED))
    return np.concatenate([x, c[..., i] * c[..., j]], axis=-1)


def fit_pairs(good: np.ndarray, poor: np.ndarray, pairs: int = 40000, rounds: int = 400, rate: float = 0.05, decay: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights that minimise the mean of log(1 + exp(-w . (x_good - x_poor))) over drawn pairs, by Adam."""
    rng = np.random.default_rng(seed)
    diff = (good[rng.integers(len(good), size=pairs)] - poor[rng.integers(len(poor), size=pairs)]).astype(np.float32)
    w, m, v = (np.zeros(diff.shape[1]) for _ in range(3))
    for t in range(1, rounds + 1):
        miss = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
        grad = -(miss @ diff) / pairs + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train(documents: DataFrame, labels: DataFrame, most_each: int = 5000) -> PairModel:
    """Fits the weights on a bounded sample of labelled documents outside fold 0; ``cut`` is still open."""
    documents = text_batches(documents)
    known = training_labels(labels, "quality")
    of = documents.select("doc_id").distinct().join(known, "doc_id")
    ids = [hashed_sample(of.where(F.col("label") == k).select("doc_id"), most_each, 3).withColumn("group", F.lit(k)) for k in (1, 0)]
    rows = collect_features(documents, ids[0].unionByName(ids[1]), lambda: shape, pa.float64())
    good, poor = (np.array([x for _, g, x in rows if g == k]) for k in (1, 0))
    if not len(good) or not len(poor):
        return PairModel(np.zeros(0), np.ones(0), None)
    x = expand(np.concatenate([good, poor]))
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    return PairModel(mean, scale, fit_pairs(z[: len(good)], z[len(good) :]))


def with_cut(model: PairModel, scores: DataFrame, labels: DataFrame) -> PairModel:
    """The model with its cut: over all ``scores`` (doc_id, raw) that may be learned from, the quantile at label 0's share."""
    if model.weights is None:
        return model
    known = training_labels(labels, "quality")
    bins = F.floor(F.col("raw") / STEP).alias("bin")
    counts = scores.join(known, "doc_id").groupBy(bins).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("poor")).orderBy("bin").collect()
    poor, below = sum(r.poor for r in counts), 0
    for r in counts:
        if below >= poor:
            return replace(model, cut=r.bin * STEP)
        below += r.n
    return replace(model, cut=EDGE)


def raw_scores(documents: DataFrame, model: PairModel) -> DataFrame:
    return documents.select("doc_id", score_texts(F.col("text"), model.raw_scorer).alias("raw"))


def score(raw: Column, model: PairModel) -> Column:
    """The score of a raw score, as ``PairModel.scorer`` has it."""
    if model.weights is None:
        return F.lit(0.5)
    return 1 / (1 + F.exp(-(raw - F.lit(model.cut - float(np.log(CUT / (1 - CUT)))))))


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; the texts are scored once."""
    model = train(documents, labels)
    raw = materialise(raw_scores(documents, model), "quality-scores")
    model = with_cut(model, raw, labels)
    scored = raw.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score(F.col("raw"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def drop_poor(documents: DataFrame, labels: DataFrame, threshold: float = CUT) -> DataFrame:
    """The documents whose score is at least ``threshold``, with all their columns.

    The cut needs all scores first; the documents are written with them, so that every text is scored once.
    """
    model = train(documents, labels)
    scored = materialise(documents.withColumn("__nw_raw", score_texts(documents["text"], model.raw_scorer)), "quality-documents")
    model = with_cut(model, scored.select("doc_id", F.col("__nw_raw").alias("raw")), labels)
    return scored.where(score(F.col("__nw_raw"), model) >= threshold).select(*documents.columns)
