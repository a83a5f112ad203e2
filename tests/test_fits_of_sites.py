"""regressions of many sites by Newton steps, and p-values combined without listing neighbours."""

import math

import numpy as np

from cytolake.functions import kernels
from cytolake.operators import models, significance


def test_gammas():
    x = np.array([1e-6, 0.3, 1.0, 2.5, 7.0, 40.0, 1e4, 3e6])
    ln, one, two = kernels.gammas(x)
    assert np.allclose(ln, [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    assert np.allclose(one, kernels.digamma(x), rtol=1e-10) and np.allclose(two, kernels.trigamma(x), rtol=1e-9)


def test_regressions_reach_the_top_in_few_steps(monkeypatch):
    r = np.random.default_rng(8)
    n = r.integers(0, 50, (60, 7)).astype(float)
    k = np.floor(n * r.random((60, 7)).round(1))
    k[0], k[1] = 0.0, n[1]  # none and all
    x = np.tile(np.array([(1, int(s > 3)) for s in range(1, 8)], float), (60, 1, 1))
    calls, gammas = [], kernels.gammas
    monkeypatch.setattr(kernels, "gammas", lambda z: calls.append(1) or gammas(z))
    got = models._fit_regressions(x, k, n)
    assert len(calls) < 200

    def value(theta, row):
        p = np.clip(1 / (1 + np.exp(-np.clip(x[row] @ theta[:2], -30, 30))), 1e-9, 1 - 1e-9)
        m = math.exp(theta[2])
        return float(sum(kernels.betabinomial_logpmf(k[row, j], n[row, j], p[j] * m, (1 - p[j]) * m) for j in range(7) if n[row, j]))

    for row in range(0, 60, 6):  # no place of a net, made finer around the best, is higher
        best, at, width = -np.inf, np.array([0.0, 0.0, 2.0]), np.array([8.0, 10.0, 9.0])
        for _ in range(14):
            for d in np.stack(np.meshgrid(*[np.linspace(-1, 1, 5)] * 3), axis=-1).reshape(-1, 3):
                theta = at + d * width
                theta[2] = min(15.0, max(-15.0, theta[2]))
                if (v := value(theta, row)) > best:
                    best, top = v, theta
            at, width = top, width * 0.6
        assert got[row] > best - 1e-6


def test_combined_is_pair_by_pair(spark):
    r = np.random.default_rng(2)
    rows = [(c, int(p), float(r.random())) for c in "ab" for p in np.cumsum(r.integers(0, 9, 200)) + (16_300 if c == "b" else 0)] + [("a", 5, -1.0)]
    corr = spark.createDataFrame([(0, 10, 0.6), (1, 10, 0.3), (3, 10, -0.1)], "bin int, n int, corr double")
    t = spark.createDataFrame(rows, "chrom string, pos long, p double")
    out = significance.combined(t, corr, 40, 10)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((x.chrom, x.pos, x.p, x.combined_p) for x in out.collect())
    tested = sorted(x for x in rows if x[2] >= 0)
    assert [g[:3] for g in got] == tested
    tau = {0: 0.6, 1: 0.3, 3: -0.1}
    for chrom, pos, _, p in got:
        near = [(q, v) for c, q, v in tested if c == chrom and abs(q - pos) <= 40]
        rho = sum(1.0 if i == j else tau.get(abs(a - b) // 10, 0.0) if abs(a - b) <= 40 else 0.0 for i, (a, _) in enumerate(near) for j, (b, _) in enumerate(near))
        z = kernels.probit(1 - np.array([v for _, v in near])).sum() / math.sqrt(max(rho, 1e-9))
        assert abs(p - kernels.normal_sf(z)[0]) < 1e-9
