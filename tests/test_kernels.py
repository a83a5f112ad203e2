import itertools
import math
from fractions import Fraction

import numpy as np
import pytest

from cytolake.functions import kernels as k
from cytolake.operators import models as m


def test_gamma_functions():
    for x in (0.05, 0.5, 1, 1.5, 3.7, 42, 1e5):
        assert math.isclose(float(k.lgamma(x)), math.lgamma(x), rel_tol=1e-10, abs_tol=1e-10)
        h = 1e-5 * x
        assert math.isclose(float(k.digamma(x)[0]), (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel_tol=1e-5, abs_tol=1e-5)
        assert math.isclose(k.inverse_digamma(float(k.digamma(x)[0])), x, rel_tol=1e-6)
    assert math.isclose(k.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    for x in (0.1, 1.0, 4.0, 30.0):
        assert math.isclose(k.chi2_sf(x, 1), math.erfc(math.sqrt(x / 2)), rel_tol=1e-9)
        assert math.isclose(k.chi2_sf(x, 4), math.exp(-x / 2) * (1 + x / 2), rel_tol=1e-9)
    assert np.allclose(k.probit([0.5, 0.975]), [0, 1.959963984540054])


def test_exact_tests():
    # worked examples with a pseudocount of 1: methylated and not in A, then in B
    for (ma, ua, mb, ub), want in {(16, 7, 21, 11): 0.609908, (21, 18, 15, 22): 0.874119, (20, 19, 15, 25): 0.888384, (3, 20, 12, 16): 0.010825}.items():
        assert abs(k.greater_probability(mb + 1, ub + 1, ma + 1, ua + 1) - want) < 1e-6
    for a, b, c, d in itertools.product(range(4), repeat=4):
        probs = {x: Fraction(math.comb(a + b, x) * math.comb(c + d, a + c - x), math.comb(a + b + c + d, a + c)) for x in range(max(0, a - d), min(a + b, a + c) + 1)}
        assert abs(k.fisher_two_sided(a, b, c, d) - float(sum(p for p in probs.values() if p <= probs[a]))) < 1e-9
    assert abs(k.rank_sum([1, 2, 3], [1, 2, 3]) - 1) < 1e-12


def test_beta_fit_recovers_parameters():
    r = np.random.default_rng(1)
    p = r.beta(2.0, 5.0, 200_000)
    a, b = k.fit_beta(len(p), np.log(p).sum(), np.log(1 - p).sum())
    assert abs(a - 2) < 0.05 and abs(b - 5) < 0.1


def _brute(model, logs):
    n, s = logs.shape
    paths = {}
    for path in itertools.product(range(s), repeat=n):
        p = model.start[path[0]]
        for a, b in zip(path, path[1:]):
            p *= model.trans[a][b]
        paths[path] = p * math.exp(sum(logs[i, x] for i, x in enumerate(path)))
    total = sum(paths.values())
    post = np.array([[sum(v for path, v in paths.items() if path[i] == x) / total for x in range(s)] for i in range(n)])
    counts = np.zeros((s, s))
    for path, v in paths.items():
        for a, b in zip(path, path[1:]):
            counts[a, b] += v / total
    return post, counts, math.log(total), max(paths, key=paths.get)


@pytest.mark.parametrize("states", [2, 3])
def test_hidden_markov_model(states):
    r = np.random.default_rng(states)
    trans = r.dirichlet(np.ones(states), states)
    if states == 3:
        trans = np.array([[0.75, 0.25, 0.0], [0.15, 0.7, 0.15], [0.0, 0.4, 0.6]])
    model = m.Hmm(tuple(r.dirichlet(np.ones(states))), tuple(map(tuple, trans)), (((2.0, 5.0),), ((5.0, 2.0),)), (0, 1, 0)[:states])
    lengths = np.array([1, 6, 4])
    reads = r.integers(1, 30, (11, 1)).astype(float)
    meth = np.floor(reads * r.random((11, 1)))
    logs = m._log_emissions(model, meth, reads)
    post, counts, ll = m.forward_backward(model, logs, lengths)
    want = [_brute(model, part) for part in np.split(logs, np.cumsum(lengths)[:-1])]
    assert np.allclose(post, np.concatenate([w[0] for w in want]))
    assert np.allclose(counts, sum(w[1] for w in want))
    assert math.isclose(ll, sum(w[2] for w in want), rel_tol=1e-10)
    for part, w in zip(np.split(logs, np.cumsum(lengths)[:-1]), want):
        assert tuple(m.viterbi(model, part)) == w[3]


def test_epialleles():
    two = [(0, "CCCCCC")] * 12 + [(0, "TTTTTT")] * 12
    one = [(0, "CTCTCT"), (0, "TCTCTC")] * 3 + [(0, "CCTTCT"), (0, "TTCCTC")] * 3
    assert m.allele_test(two) < 1e-6 < m.allele_test([(0, "CCCCCC")] * 20)
    assert m.allele_test(two, bic=True) < 0 < m.allele_test([(0, "CCNCCC"), (1, "CCCCC")] * 9, bic=True)
    assert 0 <= m.allele_test(one) <= 1


def test_regression_likelihood():
    r = np.random.default_rng(3)
    x = np.array([[1, 0]] * 4 + [[1, 1]] * 4, float)
    n = np.full(8, 40.0)
    far, near = np.array([4, 5, 6, 4, 33, 35, 36, 34.0]), r.binomial(40, 0.5, 8).astype(float)
    test = lambda c: k.chi2_sf(max(0, 2 * (m._fit_regression(x, c, n) - m._fit_regression(x[:, :1], c, n))), 1)
    assert test(far) < 1e-4 < 0.01 < test(near)


def test_joint_levels(spark):
    n = 4000.0
    rows = [("c", 1, n * 0.5, n * 0.5, n * 0.2, n * 0.8, n * 0.3, n * 0.7), ("c", 2, 10.0, 0.0, 0.0, 10.0, 10.0, 0.0), ("c", 3, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    got = {r.pos: r for r in m.joint_levels(spark.createDataFrame(rows, "chrom string, pos long, h double, g double, u double, t double, m double, l double")).collect()}
    assert abs(got[1].pm - 0.3) < 1e-4 and abs(got[1].ph - 0.2) < 1e-4 and got[1].conflicts == 0
    assert got[2].pm > 0.99
