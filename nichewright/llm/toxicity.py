"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives and any other text is unlabelled.  A numpy model, linear in the presence of hashed
words, minimises the class-prior-corrected risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

where a mini-step that would drive the second term below zero is undone instead of followed, so that a flexible model can't
gain by pushing unlabelled text below its own share of positives.  The prior is estimated from positives and unlabelled text, and
is at most the share of toxic labels among those that may be learned from.

Fitting uses at most ``positives`` and ``unlabelled`` documents, picked by a keyed hash of their ids, and at most ``most_words``
different words of each; scoring reads every text whole, in one pass without a shuffle, and the model that is sent out has a fixed
size.

Cases: a null or empty text has no words and gets the score of the bias alone; rows that share an id are scored each on its
own, and fitting takes one of them; without a positive label every score is 0; an empty table gives an empty result; other columns pass through unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichewright.llm.shared import text_batches
from nichewright.llm.text_features import HashedWords, collect_features, fold, hashed_sample, score_texts, training_labels

BITS = 18


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class WordModel:
    """Weights of the chosen hashed words; ``bias`` is None where there was nothing to learn from."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float | None

    def scorer(self):
        """A function from raw bytes to a score that keeps the recent words' indices."""
        if self.bias is None:
            return lambda raw: 0.0
        place = np.full(1 << BITS, -1, np.int32)
        place[self.chosen] = np.arange(len(self.chosen), dtype=np.int32)
        of_words, weights, bias = HashedWords(BITS), self.weights, self.bias

        def score(raw: bytes) -> float:
            at = place[of_words(raw)]
            return float(sigmoid(bias + weights[at[at >= 0]].sum()))

        return score


def choose_words(positive: list[np.ndarray], unlabelled: list[np.ndarray], most: int, least_seen: int = 5) -> np.ndarray:
    """The indices whose share of documents differs most between the two groups, by a two-proportion z."""
    p, u = (np.bincount(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64), minlength=1 << BITS) for x in (positive, unlabelled))
    a, b = p / max(1, len(positive)), u / max(1, len(unlabelled))
    pooled = (p + u) / max(1, len(positive) + len(unlabelled))
    z = np.abs(a - b) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / max(1, len(positive)) + 1 / max(1, len(unlabelled))))
    z[p + u < least_seen] = 0
    best = np.lexsort((np.arange(len(z)), -z))[:most]
    return np.sort(best[z[best] > 3.5]).astype(np.int64)  # few of some hundred thousand pass by chance


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk under the logistic loss, by Adam on all rows at once."""
    d = positive.shape[1]
    w = np.zeros(d + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, rounds + 1):
        p, u = sigmoid(positive @ w[:-1] + w[-1]), sigmoid(unlabelled @ w[:-1] + w[-1])
        # Logistic loss: l+(f) = log(1 + e^-f) with derivative p - 1, l-(f) = log(1 + e^f) with derivative p.
        spread = lambda x, by: np.append(by @ x, by.sum()) / len(by)
        negative_risk = -np.log1p(-np.minimum(u, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(p, 1 - 1e-12)).mean()
        negative_grad = spread(unlabelled, u) - prior * spread(positive, p)
        grad = prior * spread(positive, p - 1) + negative_grad if negative_risk >= 0 else -negative_grad
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit_balanced(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 150, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model of positives against unlabelled rows, both of equal weight; only its order is used."""
    w, m, v = (np.zeros(positive.shape[1] + 1) for _ in range(3))
    for t in range(1, rounds + 1):
        p, u = sigmoid(positive @ w[:-1] + w[-1]) - 1, sigmoid(unlabelled @ w[:-1] + w[-1])
        grad = np.append(p @ positive, p.sum()) / len(p) + np.append(u @ unlabelled, u.sum()) / len(u)
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows.

    For any set A of texts, P(A | unlabelled) >= prior * P(A | positive), with near equality for the sets that a good score
    picks out: the estimate is the least ratio over cuts of a score that was fitted on the other half of the rows.
    """
    found: list[list[np.ndarray]] = [[], []]
    for half in (0, 1):
        w = fit_balanced(positive[half::2], unlabelled[half::2])
        for rows, out in zip((positive, unlabelled), found, strict=True):
            out.append(rows[1 - half :: 2] @ w[:-1] + w[-1])
    p, u = (np.sort(np.concatenate(x)) for x in found)
    cuts = np.quantile(p, np.linspace(0.1, 0.7, 25))
    above = lambda x: len(x) - np.searchsorted(x, cuts, side="left")
    return float((((above(u) + 1) / (len(u) + 1)) / (above(p) / len(p))).min())


def train(documents: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 10000, features: int = 1024, most_words: int = 20_000) -> WordModel:
    """Fits on the labels of ``column`` toxic outside fold 0 and on unlabelled text outside fold 0."""
    documents = text_batches(documents)
    known = training_labels(labels, "toxic")
    shares = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if not shares.get(1):
        return WordModel(np.zeros(0, np.int64), np.zeros(0), None)
    of = documents.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    toxic = hashed_sample(of.join(known.where("label = 1").select("doc_id"), "doc_id"), positives, 1).withColumn("group", F.lit(1))
    other = hashed_sample(of.where(fold(F.col("doc_id")) != 0), unlabelled, 2).withColumn("group", F.lit(0))
    rows = collect_features(documents, toxic.unionByName(other), lambda: HashedWords(BITS, most_kept=most_words), pa.int32())
    groups = [[x for _, g, x in rows if g == k] for k in (1, 0)]
    if not all(groups):
        return WordModel(np.zeros(0, np.int64), np.zeros(0), None)
    chosen = choose_words(*groups, features)
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    dense = []
    for group in groups:
        x = np.zeros((len(group), len(chosen)), np.float32)
        for i, found in enumerate(group):
            at = place[found]
            x[i, at[at >= 0]] = 1
        dense.append(x)
    # Labels may be richer in toxic rows than the documents are; a prior that is too high would make clean text toxic.
    prior = min(0.95, shares[1] / sum(shares.values()), estimate_prior(*dense) if min(map(len, dense)) > 1 else 1.0)
    weights, bias = fit_nnpu(*dense, max(prior, 1e-4))
    return WordModel(chosen, weights, bias)


def score(model: WordModel, text: Column) -> Column:
    return score_texts(text, model.scorer)


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = train(documents, labels)
    scored = documents.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below ``threshold``, with all their columns."""
    return documents.where(score(train(documents, labels), documents["text"]) < threshold)
