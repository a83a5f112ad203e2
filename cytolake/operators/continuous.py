"""Two-state models in continuous time: the further two sites are apart, the less one says of the other.

The chain leaves each state at a rate per base, so its transition probabilities over a distance are those of a two-state Markov process. Sites have
beta-binomial counts in each state. Training sums, for each distance between neighbours, how often the chain is expected to begin and end in each
pair of states; the rates that make these likeliest come from the expected stays and jumps between the ends of a step.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from .intervals import segment_by_gap


@dataclass(frozen=True)
class RateModel:
    """emission: alpha and beta of state 0 and of state 1. rates: of leaving state 0 and state 1, per base."""

    emission: tuple = ((0.7, 4.0), (4.0, 0.7))
    rates: tuple = (0.01, 0.01)

    @property
    def start(self) -> tuple[float, float]:
        """The shares of the states in the long run."""
        a, b = self.rates
        return b / (a + b), a / (a + b)


def _parts(rates: tuple) -> tuple[np.ndarray, np.ndarray]:
    """level, change: over a distance t, state i goes to j with probability level[i, j] + change[i, j] * exp(-(sum of rates) * t)."""
    a, b = rates
    level = np.array([[b, a], [b, a]]) / (a + b)
    return level, np.eye(2) - level


def transitions(rates: tuple, distance) -> np.ndarray:
    """Transition probabilities over each distance: (distances, 2, 2)."""
    level, change = _parts(rates)
    return level + change * np.exp(-sum(rates) * np.asarray(distance, float))[:, None, None]


def expectations(rates: tuple, distance) -> tuple[np.ndarray, np.ndarray]:
    """stays, jumps: for each distance t > 0 and each pair of ends i, j, the expected time in state k and the expected number of times that k is left: (distances, 2, 2, 2), k last.

    The integral over u of P[i, k](u) P[l, j](t - u) is a sum of four terms, as each factor is a constant and an exponential.
    """
    t = np.asarray(distance, float)[:, None, None]
    level, change = _parts(rates)
    s = sum(rates)
    e = np.exp(-s * t)
    p = transitions(rates, distance)

    def meeting(k: int, l: int) -> np.ndarray:  # noqa: E741
        u, v = level[:, k][:, None], change[:, k][:, None]
        w, x = level[l, :][None, :], change[l, :][None, :]
        return (u * w * t + (u * x + v * w) * (1 - e) / s + v * x * t * e) / p

    stays = np.stack([meeting(0, 0), meeting(1, 1)], axis=-1)
    jumps = np.stack([rates[0] * meeting(0, 1), rates[1] * meeting(1, 0)], axis=-1)
    return stays, jumps


def fit_rates(distance, counts, rates: tuple, iterations: int = 1000, tolerance: float = 1e-10) -> tuple[float, float]:
    """The rates that make counts[d, i, j] steps over each distance from state i to j likeliest, from given ones on: jumps over stays, again and again."""
    distance, counts = np.asarray(distance, float), np.asarray(counts, float)
    some = (distance > 0) & (counts.sum(axis=(1, 2)) > 0)
    distance, counts = distance[some], counts[some]
    if not len(distance):
        return rates
    for _ in range(iterations):
        stays, jumps = expectations(rates, distance)
        new = (counts[..., None] * jumps).sum(axis=(0, 1, 2)) / np.maximum((counts[..., None] * stays).sum(axis=(0, 1, 2)), 1e-300)
        new = tuple(np.clip(new, 1e-12, 1e3).tolist())
        moved = max(abs(x - y) / max(x, y) for x, y in zip(rates, new))
        rates = new
        if moved < tolerance:
            break
    return rates


def forward_backward(model: RateModel, logs: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of one segment: the states' probabilities (sites x 2), those of the pairs of states at neighbouring sites (sites - 1 x 2 x 2), and the log-likelihood. logs: ln of the counts' probability in each state."""
    n = len(pos)
    top = logs.max(axis=1)
    emit = np.exp(logs - top[:, None])
    steps = transitions(model.rates, np.diff(pos))
    ahead, scale, after = np.empty((n, 2)), np.empty(n), np.ones((n, 2))
    (x, y), each, ways = model.start, emit.tolist(), steps.tolist()
    for t in range(n):
        if t:
            (a, b), (c, d) = ways[t - 1]
            x, y = x * a + y * c, x * b + y * d
        x, y = x * each[t][0], y * each[t][1]
        total = x + y
        x, y = x / total, y / total
        ahead[t], scale[t] = (x, y), total
    x = y = 1.0
    for t in range(n - 2, -1, -1):
        (a, b), (c, d) = ways[t]
        p, q = x * each[t + 1][0], y * each[t + 1][1]
        x, y = a * p + b * q, c * p + d * q
        total = x + y
        x, y = x / total, y / total
        after[t] = x, y
    post = ahead * after
    post /= post.sum(axis=1, keepdims=True)
    pair = ahead[:-1, :, None] * steps * (emit[1:] * after[1:])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return post, pair, float((np.log(scale) + top).sum())


def _logs(model: RateModel, meth: np.ndarray, reads: np.ndarray) -> np.ndarray:
    return np.stack([np.where(reads > 0, kernels.betabinomial_logpmf(meth, reads, a, b), 0.0) for a, b in model.emission], axis=1)


def _segments(rows: DataFrame, desert: int) -> DataFrame:
    t = segment_by_gap(rows.select("chrom", "pos", "n_meth", "n_reads"), desert)
    t = t.groupBy("chrom", "segment").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("n_meth").cast("double").alias("m"), F.col("n_reads").cast("double").alias("n")))).alias("s"))
    return t.select("chrom", "segment", F.col("s.pos").alias("pos"), F.col("s.m").alias("m"), F.col("s.n").alias("n"))


def _rows(batch: pa.RecordBatch):
    for k in range(len(batch)):
        yield (batch["chrom"][k].as_py(), batch["segment"][k].as_py(), *(np.array(batch[c][k].values.to_numpy(zero_copy_only=False)) for c in ("pos", "m", "n")))


def train(rows: DataFrame, model: RateModel | None = None, desert: int = 1000, iterations: int = 10, tolerance: float = 1e-10) -> tuple[RateModel, float]:
    """Fits the model to sites (chrom, pos, n_meth, n_reads) and returns it with the log-likelihood that it was found at. Segments end where neighbours are more than `desert` apart.

    Sites without reads tell nothing but count as steps. A round's sums are a row for each distance, at most `desert` of them. Stops, with the model before, when the
    log-likelihood gains less than the tolerance of itself.
    """
    model, before = model or RateModel(), -np.inf
    segments = _segments(rows, desert).persist()

    def tell(batches):
        for batch in batches:
            found = []
            for _, _, pos, meth, reads in _rows(batch):
                post, pair, score = forward_backward(now, _logs(now, meth, reads), pos)
                level = np.clip(meth / np.maximum(reads, 1), 0.01, 0.99)
                w = post * (reads > 0)[:, None]
                found.append((-1, score, 0.0, 0.0, 0.0))
                found += [(-2 - s, float(v.sum()), float(v @ np.log(level)), float(v @ np.log1p(-level)), 0.0) for s, v in enumerate(w.T)]
                far, which = np.unique(np.diff(pos), return_inverse=True)
                sums = np.zeros((len(far), 4))
                np.add.at(sums, which, pair.reshape(-1, 4))
                found += [(int(d), *map(float, x)) for d, x in zip(far, sums)]
            columns = list(zip(*found)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 0 else pa.float64()) for k, c in enumerate(columns)], names=["d", "a", "b", "c", "e"])

    try:
        for _ in range(iterations):
            now = model
            got = {r.d: tuple(r)[1:] for r in segments.mapInArrow(tell, "d long, a double, b double, c double, e double").groupBy("d").agg(*[F.sum(c).alias(c) for c in "abce"]).collect()}
            if not got or (got[-1][0] - before) / abs(got[-1][0]) < tolerance:
                break
            before = got[-1][0]
            far = sorted(d for d in got if d > 0)
            rates = fit_rates(far, np.array([got[d] for d in far]).reshape(-1, 2, 2), now.rates)
            model = replace(now, emission=tuple(kernels.fit_beta(*got[-2 - s][:3]) for s in (0, 1)), rates=rates)
        else:
            now = model
    finally:
        segments.unpersist()
    return now, float(before)


def decode(rows: DataFrame, model: RateModel, desert: int = 1000) -> DataFrame:
    """chrom, segment, pos, state (the likelier one, 1 if both are equal) and post, the probability of state 0."""
    names = ["chrom", "segment", "pos", "state", "post"]

    def run(batches):
        for batch in batches:
            for chrom, segment, pos, meth, reads in _rows(batch):
                post = forward_backward(model, _logs(model, meth, reads), pos)[0]
                n = len(pos)
                yield pa.RecordBatch.from_arrays([pa.array([chrom] * n, pa.string()), pa.array([segment] * n, pa.int64()), pa.array(pos), pa.array((post[:, 0] <= post[:, 1]).astype(np.int64)), pa.array(np.ascontiguousarray(post[:, 0]))], names=names)

    return _segments(rows, desert).mapInArrow(run, "chrom string, segment long, pos long, state long, post double")
