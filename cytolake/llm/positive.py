"""A quality classifier by positive-unlabelled learning.

Trusted positives are the training rows labelled 1; the unlabelled rows are any training rows, whatever their label.
The class prior is estimated from both: a classifier of positives against unlabelled rows orders them by the ratio of their
densities, and the prior is the least ratio of the unlabelled rows' share to the positives' above any place in that order
(class_prior). The risk is the non-negative unbiased one:
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)), with the logistic loss and a small penalty; where
the part in the maximum turns negative, its gradient is reversed. The model is linear in bins and hinges of
features of the text, so its score is a Spark expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import buckets, dropped, looked_up, name_of, scratch, stored, written
from .textstats import FEATURES, text_stats

#: Positives and unlabelled rows that are learned from at most, each those of least hash; the bound on what the driver gathers.
TRAINING_ROWS = 20_000
BINS, STEPS, RATE, PENALTY = 8, 600, 0.05, 1e-4


def training_part() -> Column:
    """Rows whose labels may be learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1


class Classifier:
    """cuts: feature -> thresholds. A row's inputs are 1 for each threshold that its feature is above."""

    def __init__(self, cuts: dict[str, list[float]], weights: np.ndarray, bias: float, prior: float):
        self.cuts, self.weights, self.bias, self.prior = cuts, weights, bias, prior

    def score(self) -> Column:
        """Between 0 and 1."""
        total, weights = F.lit(float(self.bias)), iter(self.weights.tolist())
        for name, cuts in self.cuts.items():
            for cut in cuts:
                total = total + F.when(F.expr(FEATURES[name]) > cut, F.lit(next(weights))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _inputs(x: dict[str, np.ndarray], cuts: dict[str, list[float]]) -> np.ndarray:
    columns = [x[name] > cut for name, some in cuts.items() for cut in some]
    return np.stack(columns, axis=1).astype(np.float64) if columns else np.zeros((len(next(iter(x.values()))), 0))


def _descend(grad_of, size: int, bias: float) -> tuple[np.ndarray, float]:
    """Adam over all rows: weights and bias, from their gradient."""
    w, m, v = np.zeros(size), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        grad = grad_of(w, bias)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def cuts_of(positive: dict[str, np.ndarray], unlabelled: dict[str, np.ndarray]) -> dict[str, list[float]]:
    """Thresholds of each feature: between seen values, and next to the range that nearly all positives are in."""
    out, levels = {}, np.concatenate([np.linspace(0, 1, BINS + 1)[1:-1], [0.01, 0.03, 0.97, 0.99]])
    for name in FEATURES:
        both = np.concatenate([positive[name], unlabelled[name]])
        out[name] = sorted({float(c) for c in np.concatenate([np.quantile(both, levels), np.quantile(positive[name], [0.001, 0.01, 0.99, 0.999])])} if len(both) and len(positive[name]) else set())
    return out


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from inputs of positives and of unlabelled rows. 0.5 without either.

    The unlabelled share above a place of the order is the prior times the positives' share, and more where others stand:
    the least ratio bounds the prior from above, and meets it where positives stand alone. Places above which fewer
    than four fifths of the positives stand say little about the rest.
    """
    if not len(p) or not len(u):
        return 0.5

    found = []
    for k in (0, 1):  # each half is ordered by what the other taught, so that no row is high for being known
        tp, tu, vp, vu = p[k::2], u[k::2], p[1 - k :: 2], u[1 - k :: 2]
        if not min(map(len, (tp, tu, vp, vu))):
            return 0.5

        def grad(w, bias):
            gp, gu = -_sigmoid(-(tp @ w + bias)) / len(tp), _sigmoid(tu @ w + bias) / len(tu)
            return np.append(tp.T @ gp + tu.T @ gu + 0.01 * w, gp.sum() + gu.sum())

        w, _ = _descend(grad, p.shape[1], 0.0)
        above, all_ = np.sort(-(vp @ w)), np.sort(-(vu @ w))
        places = np.quantile(above, np.linspace(0.8, 1, 81))
        found.append((np.searchsorted(all_, places, side="right") / len(vu) / (np.searchsorted(above, places, side="right") / len(vp))).min())
    return float(np.clip(np.mean(found), 0.02, 0.98))


def fit(positive: dict[str, np.ndarray], unlabelled: dict[str, np.ndarray], prior: float | None = None) -> Classifier:
    """Non-negative risk estimation, with the estimated prior unless one is given."""
    cuts = cuts_of(positive, unlabelled)
    p, u = _inputs(positive, cuts), _inputs(unlabelled, cuts)
    prior = class_prior(p, u) if prior is None else prior
    if not len(p) or not len(u):
        return Classifier(cuts, np.zeros(p.shape[1]), float(np.log(prior / (1 - prior))), prior)

    def grad(w, bias):
        zp, zu = p @ w + bias, u @ w + bias
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up, down = -_sigmoid(-zp) / len(p), prior * _sigmoid(zp) / len(p)  # of R+ and of prior * R-, by score
        minus = _sigmoid(zu) / len(u)
        gp, gu = (prior * up - down, minus) if rest >= 0 else (down, -minus)
        return np.append(p.T @ gp + u.T @ gu + PENALTY * w, gp.sum() + gu.sum())

    w, bias = _descend(grad, p.shape[1], float(np.log(prior / (1 - prior))))
    return Classifier(cuts, w, bias, prior)


def train(stats: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> Classifier:
    """From the rows of training_part() only, and of their labels from those of 1. Without positives the score is the prior of 0.5 everywhere."""
    own = stats.where(training_part()).select("doc_id", *(F.expr(c).alias(k) for k, c in FEATURES.items())).withColumn("h", F.xxhash64("doc_id"))
    marked = labels.where("quality is not null and doc_id is not null").where(training_part()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    least = lambda df: df.orderBy("h", *FEATURES).limit(limit).select(*FEATURES).toPandas()
    positives, unlabelled = least(own.join(marked.where("quality = 1"), "doc_id")), least(own)
    return fit(*({k: t[k].to_numpy(float) for k in FEATURES} for t in (positives, unlabelled)))


def classify(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.5). Null and empty texts are scored by their zero counts.

    Repeated rows: a row each. Only doc_id, which deals the rows into parts, and text are read.
    """
    stats = written(text_stats(docs), scratch(docs.sparkSession, "classifier") + "/stats")
    model = train(stats, labels, limit)
    scored = stats.select("doc_id", (~training_part()).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> DataFrame:
    """The rows, with all their columns, that the classifier predicts to be of quality 1. Counts of texts are made once; the names of the rows that go are stored and looked up, so no text is copied or shuffled."""
    root, n = scratch(docs.sparkSession, "classifier"), buckets(docs)
    named = docs.select("doc_id", "text", *name_of(docs))
    stats = written(text_stats(named, keep=("doc_id", "key", "id", "sub")), f"{root}/stats")
    model = train(stats, labels, limit)
    stored(stats.where(model.score() < 0.5).select("key", "id", "sub").distinct().withColumn("number", F.lit(1).cast("long")), n, f"{root}/gone")
    dropped(f"{root}/stats")
    return docs.where(looked_up(docs, n, f"{root}/gone") == 0)
