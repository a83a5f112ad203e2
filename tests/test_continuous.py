"""The continuous-time model against enumeration, numeric integrals and numeric slopes."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.operators import continuous as ct

RATES = (0.03, 0.11)


def _power(rates, t, n=4000):
    """The transition matrix as many small steps."""
    a, b = rates
    return np.linalg.matrix_power(np.eye(2) + np.array([[-a, a], [b, -b]]) * t / n, n)


def test_transitions():
    for t in (0, 1, 7.5, 300):
        assert np.allclose(ct.transitions(RATES, [t])[0], _power(RATES, t), atol=2e-4)
        assert np.allclose(ct.transitions(RATES, [t])[0].sum(axis=1), 1)
    assert np.allclose(ct.transitions(RATES, [3.0])[0] @ ct.transitions(RATES, [4.0])[0], ct.transitions(RATES, [7.0])[0])


@pytest.mark.parametrize("t", [0.5, 9.0, 120.0])
def test_expected_stays_and_jumps(t):
    stays, jumps = ct.expectations(RATES, [t])
    assert np.allclose(stays.sum(axis=-1), t)
    u = (np.arange(20_000) + 0.5) * t / 20_000
    first, rest = ct.transitions(RATES, u), ct.transitions(RATES, t - u)
    whole = ct.transitions(RATES, [t])[0]
    for i, j in itertools.product((0, 1), repeat=2):
        for k in (0, 1):
            assert stays[0, i, j, k] == pytest.approx((first[:, i, k] * rest[:, k, j]).mean() * t / whole[i, j], rel=1e-6)
            assert jumps[0, i, j, k] == pytest.approx(RATES[k] * (first[:, i, k] * rest[:, 1 - k, j]).mean() * t / whole[i, j], rel=1e-6)


def test_slope_of_the_likelihood():
    """Jumps over the rate less stays is the slope of ln P by the rate."""
    d = np.array([2.0, 15.0, 80.0])
    stays, jumps = ct.expectations(RATES, d)
    for k in (0, 1):
        up, down = ([r + (h if i == k else 0) for i, r in enumerate(RATES)] for h in (1e-6, -1e-6))
        slope = (np.log(ct.transitions(tuple(up), d)) - np.log(ct.transitions(tuple(down), d))) / 2e-6
        assert np.allclose(jumps[..., k] / RATES[k] - stays[..., k], slope, rtol=1e-5, atol=1e-5)


def test_fitted_rates_are_the_likeliest():
    g = np.random.default_rng(1)
    d, counts = np.array([3.0, 10.0, 40.0, 0.0]), g.random((4, 2, 2)) * 50
    counts[:, [0, 1], [0, 1]] *= 4
    rates = ct.fit_rates(d, counts, (0.5, 0.001))
    score = lambda r: float((counts[:3] * np.log(ct.transitions(r, d[:3]))).sum())
    for f, h in ((1.001, 1), (0.999, 1), (1, 1.001), (1, 0.999)):
        assert score((rates[0] * f, rates[1] * h)) < score(rates)
    assert ct.fit_rates([0.0], np.ones((1, 2, 2)), RATES) == RATES


@pytest.mark.parametrize("n", [1, 2, 6])
def test_all_paths(n):
    g = np.random.default_rng(n)
    model = ct.RateModel(rates=RATES)
    pos = np.cumsum(g.integers(0, 30, n))
    reads = g.integers(0, 9, n).astype(float)
    meth = np.floor(reads * g.random(n))
    logs = ct._logs(model, meth, reads)
    total, held, both = 0.0, np.zeros((n, 2)), np.zeros((max(0, n - 1), 2, 2))
    for path in itertools.product((0, 1), repeat=n):
        p = model.start[path[0]] * math.exp(sum(logs[t, s] for t, s in enumerate(path)))
        for t in range(1, n):
            p *= ct.transitions(RATES, [pos[t] - pos[t - 1]])[0][path[t - 1], path[t]]
        total += p
        for t, s in enumerate(path):
            held[t, s] += p
            if t:
                both[t - 1, path[t - 1], s] += p
    post, pair, score = ct.forward_backward(model, logs, pos)
    assert score == pytest.approx(math.log(total)) and np.allclose(post, held / total) and np.allclose(pair, both / total)


def test_training_recovers_the_rates(spark):
    g = np.random.default_rng(5)
    rows = []
    for chrom in range(4):
        state, at = 0, 0
        for _ in range(1500):
            gap = int(g.integers(2, 60))
            state = int(g.random() < ct.transitions((0.004, 0.01), [gap])[0][state, 1])
            at += gap
            reads = int(g.integers(0, 20))
            rows.append((f"c{chrom}", at, int(g.binomial(reads, g.beta(*((1, 9), (9, 1))[state]))), reads, state))
    table = spark.createDataFrame(rows, "chrom string, pos long, n_meth long, n_reads long, truth long").repartition(6)
    model, score = ct.train(table, desert=1000, iterations=15)
    assert 0.003 < model.rates[0] < 0.0055 and 0.007 < model.rates[1] < 0.014
    found = ct.decode(table, model, desert=1000)
    good = found.join(table.select("chrom", "pos", "truth"), ["chrom", "pos"]).agg(F.avg((F.col("state") == F.col("truth")).cast("double"))).first()[0]
    assert good > 0.95 and found.count() == len(rows)
    # emissions are fitted to levels, not to counts, so a round may lose likelihood; training ends there, with the model before
    assert ct.train(table, desert=1000, iterations=1)[1] < score
    assert ct.train(table.limit(0))[0] == ct.RateModel() and ct.decode(table.limit(0), model).collect() == []
