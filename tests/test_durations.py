"""Explicit-duration models against enumeration of all paths; tests and scores of domains against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.functions import kernels
from cytolake.operators import distributions, durations


def _paths(n, longest):
    """All ways to cut n sites into (state, begin, end): domains of gain or loss stand between sites without change."""
    def grow(at, last):
        if at == n:
            yield []
            return
        if last != durations.GAIN and last != durations.LOSS or last is None:
            for state in (durations.GAIN, durations.LOSS):
                for end in range(at + 1, min(n, at + longest) + 1):
                    for rest in grow(end, state):
                        yield [(state, at, end), *rest]
        for rest in grow(at + 1, durations.SAME):
            yield [(durations.SAME, at, at + 1), *rest]

    yield from grow(0, None)


@pytest.mark.parametrize("n, longest", [(1, 3), (2, 1), (5, 2), (6, 9), (7, 3)])
def test_all_paths(n, longest):
    r = random.Random(n)
    model = durations.DurationModel(gain=(2.5, 0.4), loss=(1.5, 0.9), leave=0.3, up=0.7, longest=longest, start=(0.2, 0.5, 0.3))
    x = [r.choice([0.0, 0.1, 0.5, 0.8, 1.0]) for _ in range(n)]
    emit = np.exp([kernels.log_density("beta", np.clip(x, durations.NEAR, 1 - durations.NEAR), a, b) for a, b in model.emission])
    lengths = np.exp(model.log_lengths())
    total, held = 0.0, np.zeros((n, 3))
    for path in _paths(n, longest):
        p, before = 1.0, None
        for state, begin, end in path:
            if before is None:
                p *= model.start[state]
            elif before == durations.SAME:
                p *= 1 - model.leave if state == durations.SAME else model.leave * (model.up if state == durations.GAIN else 1 - model.up)
            p *= emit[state, begin:end].prod()
            if state != durations.SAME:
                p *= lengths[0 if state == durations.GAIN else 1, end - begin - 1]
            before = state
        total += p
        for state, begin, end in path:
            held[begin:end, state] += p
    post, front, back = durations.posteriors(model, x)
    assert math.isclose(front, math.log(total), rel_tol=1e-9, abs_tol=1e-9) and math.isclose(back, front, rel_tol=1e-9, abs_tol=1e-9)
    assert np.allclose(post, held / total, atol=1e-9)


def test_states():
    assert durations.states_of(np.array([[0.5, 0.5, 0.0], [0.6, 0.2, 0.2], [0.1, 0.2, 0.7], [0.4, 0.2, 0.4]])).tolist() == [1, 0, 2, 1]


def _drawn(seed, count, n):
    """Segments of values from a known model, with their states."""
    g = np.random.default_rng(seed)
    rows = []
    for chrom in range(count):
        states = []
        while len(states) < n:
            states += [1] * (1 + g.geometric(0.05))
            states += [int(g.integers(0, 2)) * 2] * max(1, int(g.poisson(12)))
        for k, s in enumerate(states[:n]):
            a, b = ((1, 8), (6, 6), (8, 1))[s]
            rows.append((f"c{chrom}", 10 * k, float(g.beta(a, b)), s))
    return rows


def test_training_recovers_the_model(spark):
    rows = _drawn(3, 4, 500)
    table = spark.createDataFrame(rows, "chrom string, pos long, value double, truth long").repartition(5)
    model, score = durations.train(table, gap=1000, iterations=12)
    assert 8 < model.gain[0] < 16 and 8 < model.loss[0] < 16 and 0.02 < model.leave < 0.09 and 0.3 < model.up < 0.7
    means = [a / (a + b) for a, b in model.emission]
    assert abs(means[0] - 1 / 9) < 0.05 and abs(means[1] - 0.5) < 0.05 and abs(means[2] - 8 / 9) < 0.05
    found = durations.decode(table, model, gap=1000)
    good = found.join(table.select("chrom", "pos", "truth"), ["chrom", "pos"]).agg(F.avg((F.col("state") == F.col("truth")).cast("double"))).first()[0]
    assert good > 0.96
    start, first = durations.train(table, iterations=1)
    assert start == durations.DurationModel() or first < score
    assert durations.train(table.limit(0))[0] == durations.DurationModel()
    assert durations.decode(table.limit(0), model).collect() == []


def test_longest_domain():
    """A domain that may not be long is cut by sites without change."""
    model = durations.DurationModel(longest=5)
    states = durations.states_of(durations.posteriors(model, [0.01] * 16)[0])
    longest = max(len(list(g)) for s, g in itertools.groupby(states.tolist()) if s == durations.GAIN)
    assert longest <= 6 and (states == durations.GAIN).sum() >= 10


# -- paired tests ------------------------------------------------------------------------------------------------------


def _ranked(d):
    order = sorted(map(abs, d))
    return [(order.index(abs(v)) + 1 + order.index(abs(v)) + order.count(abs(v))) / 2 for v in d]


def _plain(x, y):
    """n, greater, w+, w-, and p-values by counting all choices of signs."""
    d = [a - b for a, b in zip(x, y) if a is not None and b is not None and a != b and a == a and b == b]
    n, up = len(d), sum(v > 0 for v in d)
    ranks = _ranked(d)
    w = sum(r for r, v in zip(ranks, d) if v > 0)
    m = sum(ranks) - w
    if not n:
        return (0, 0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0)

    def signed(w):
        if n > 30:
            z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
            return 0.5 * math.erfc(z / math.sqrt(2))
        sums = {0: 1}
        for rank in range(1, n + 1):
            more = dict(sums)
            for s, c in sums.items():
                more[s + rank] = more.get(s + rank, 0) + c
            sums = more
        return 1 - sum(c for s, c in sums.items() if s <= math.floor(max(w - 1, 0))) / 2**n

    sign = lambda k: sum(math.comb(n, j) for j in range(max(k, 1), n + 1)) / 2**n
    return (n, up, w, m, signed(w), signed(m), sign(up), sign(n - up))


def test_signed_rank_table():
    for n in range(1, 11):
        sums = sorted(sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n))
        assert kernels.signed_rank_counts(n).tolist() == [sum(s <= k for s in sums) for k in range(n * (n + 1) // 2 + 1)]
    # fixed values of the published table for 5 and 8 pairs: P(W >= 15) and P(W >= 30)
    assert kernels.signed_rank_upper([15.0], [5])[0] == pytest.approx(1 / 32)
    assert kernels.signed_rank_upper([31.0], [8])[0] == pytest.approx(10 / 256)


def test_paired_tests(spark):
    r = random.Random(8)
    groups = {None: ([1.0, 2.0], [0.0, 5.0]), "none": ([1.0, None], [1.0, 2.0]), "nan": ([float("nan"), 2.0], [1.0, 0.5])}
    for k in range(25):
        n = r.choice([1, 3, 12, 29, 30, 31, 80])
        pick = (lambda: r.choice([0.0, 0.25, 0.5, 1.0])) if k % 2 else r.random
        groups[f"g{k}"] = ([pick() for _ in range(n)], [pick() for _ in range(n)])
    groups["up"] = ([float(k) for k in range(2, 9)], [0.0] * 7)
    rows = [(g, a, b, "x") for g, (x, y) in groups.items() for a, b in zip(x, y)]
    r.shuffle(rows)
    got = distributions.paired_tests(spark.createDataFrame(rows, "g string, x double, y double, size string").repartition(4), ["g"], "x", "y").collect()
    assert len(got) == len(groups)
    for row in got:
        assert tuple(row)[1:] == pytest.approx(_plain(*groups[row.g]), abs=1e-12), row.g
    assert distributions.paired_tests(spark.createDataFrame([], "g string, x double, y double"), ["g"], "x", "y").collect() == []


# -- cutoffs and random windows ---------------------------------------------------------------------------------------


def _stepwise(p, fdr):
    p, i = sorted(p), 0
    while i < len(p) - 1 and p[i + 1] < fdr * (i + 1) / len(p):
        i += 1
    return p[i]


def test_stepwise_cutoff(spark):
    r = random.Random(5)
    for case in range(12):
        p = [r.choice([0.0, 0.001, 0.01, 0.2, r.random() ** 3]) for _ in range(r.choice([1, 2, 30]))]
        fdr = r.choice([0.05, 0.3, 1.0])
        t = spark.createDataFrame([(x,) for x in p] + [(None,)], "p double")
        assert durations.stepwise_cutoff(t, fdr) == _stepwise(p, fdr), (p, fdr)
    assert durations.stepwise_cutoff(t, 2) == 1 and durations.stepwise_cutoff(t, -1) == 0
    assert durations.stepwise_cutoff(t.limit(0), 0.1) is None


def test_random_windows(spark):
    r = random.Random(6)
    rows = [(f"c{k % 3}", k * 50_000 // 3, *(r.randint(0, 9) for _ in range(4))) for k in range(60)]
    sites = spark.createDataFrame(rows, "chrom string, pos long, meth_a long, unmeth_a long, meth_b long, unmeth_b long").repartition(4)
    level = lambda m, u: m / (m + u) if m + u else None
    d = []
    for _, _, ma, ua, mb, ub in sorted(rows):
        a, b = level(ma, ua), level(mb, ub)
        d.append(b - a if a is not None and b is not None else 0.0)
    sizes = spark.createDataFrame([(1,), (7,), (7,), (59,), (60,), (99,)], "size long")
    got = durations.window_scores(sites, sizes, draws=400).collect()
    by = {n: [x.score for x in got if x.size == n] for n in (1, 7, 59)}
    assert all(len(v) == 400 for v in by.values()) and len(got) == 1200
    for n, scores in by.items():
        ways = [abs(sum(d[k : k + n])) for k in range(60 - n)]
        assert all(min(abs(s - w) for w in ways) < 1e-9 for s in scores)
        assert len({round(s, 9) for s in scores}) > 0.8 * len({round(w, 9) for w in ways})
    assert sorted(map(str, got)) == sorted(map(str, durations.window_scores(sites.repartition(2), sizes, draws=400).collect()))
    found = spark.createDataFrame([("c0", 0, 9, 7, s, 1.0, "gain") for s in (0.0, -1.5, 2.0, 99.0)] + [("c0", 0, 9, 99, 1.0, 1.0, "loss")], "chrom string, start long, end long, n long, score double, post double, state string")
    scored = durations.scored_by_windows(found, sites, draws=400).collect()
    assert len(scored) == 5
    for x in scored:
        assert x.p == pytest.approx(sum(s > abs(x.score) for s in by[7]) / 400 if x.n == 7 else 0.0)


def test_scored_by_ranks(spark):
    r = random.Random(7)
    rows = [("c", 10 * k, *(r.randint(1, 9) for _ in range(4))) for k in range(40)]
    sites = spark.createDataFrame(rows, "chrom string, pos long, meth_a long, unmeth_a long, meth_b long, unmeth_b long")
    found = spark.createDataFrame([("c", 0, 101, 11, 0.0, 0.0, "gain"), ("c", 150, 391, 25, 0.0, 0.0, "loss"), ("d", 0, 5, 0, 0.0, 0.0, "loss")], "chrom string, start long, end long, n long, score double, post double, state string")
    for x in durations.scored_by_ranks(found, sites).collect():
        inside = [(mb / (mb + ub), ma / (ma + ua)) for c, p, ma, ua, mb, ub in rows if c == x.chrom and x.start <= p < x.end]
        want = _plain(*zip(*inside)) if inside else (0,) * 4 + (1.0,) * 4
        assert x.p == pytest.approx(want[4 if x.state == "gain" else 5])


# -- weighted fits -------------------------------------------------------------------------------------------------------


def _table(spark, draws, weights=None, scales=None):
    n = len(draws)
    rows = [("g", float(v), float(w), float(s)) for v, w, s in zip(draws, weights if weights is not None else np.ones(n), scales if scales is not None else np.ones(n))]
    rows += [("g", None, 1.0, 1.0), ("g", 3.0, None, 1.0), ("g", 3.0, 0.0, 1.0), ("g", 3.0, -1.0, 1.0), ("empty", None, 1.0, 1.0)]
    return spark.createDataFrame(rows, "k string, x double, weight double, exposure double").repartition(3)


def _fit(table, family, **options):
    out = {r.k: r for r in distributions.fit_family(table, family, ["k"], "x", "weight", "exposure", **options).collect()}
    assert all(v is None for v in tuple(out["empty"])[1:])
    return out["g"]


def test_closed_forms(spark):
    g = np.random.default_rng(1)
    x, w, s = g.integers(1, 9, 200).astype(float), g.random(200), g.choice([1.0, 2.0, 5.0], 200)
    t = _table(spark, x, w, s)
    assert _fit(t, "poisson").mean == pytest.approx((w @ x) / (w @ s))
    assert _fit(t, "exponential").mean == pytest.approx((w @ (x / s)) / w.sum())
    assert _fit(t, "geometric").p == pytest.approx(w.sum() / (w @ (x / s)))
    assert _fit(t, "binomial", trials=10).p == pytest.approx((w @ (x / s)) / w.sum() / 10)
    assert _fit(t, "poisson").total == pytest.approx(w.sum())
    with pytest.raises(ValueError):
        distributions.fit_family(t, "binomial", ["k"], "x")
    with pytest.raises(ValueError):
        distributions.fit_family(t, "cauchy", ["k"], "x")


@pytest.mark.parametrize("family", ["gamma", "beta", "negative_binomial"])
def test_fits_are_the_likeliest(spark, family):
    """No step away from the fit makes the weighted values likelier."""
    g = np.random.default_rng(2)
    w = g.random(400) + 0.1
    draws = {"gamma": g.gamma(3.0, 2.0, 400), "beta": g.beta(2.0, 5.0, 400), "negative_binomial": g.negative_binomial(2.5, 2.5 / 8.5, 400)}[family]
    s = g.choice([1.0, 2.0], 400) if family == "negative_binomial" else np.ones(400)
    r = _fit(_table(spark, draws, w, s), family)
    a, b = tuple(r)[2:]

    def score(a, b):
        if family == "negative_binomial":
            return sum(wi * float(kernels.log_density(family, x, 1 / b, 1 / (1 + b * a * si))) for x, wi, si in zip(draws, w, s))
        return float(w @ kernels.log_density(family, draws, a, b))

    best = score(a, b)
    for da, db in ((1.002, 1), (0.998, 1), (1, 1.002), (1, 0.998)):
        if family == "negative_binomial" and da != 1 and len(set(s)) > 1:
            continue  # with several exposures the mean is that of the sums, as defined
        assert score(a * da, b * db) < best
    assert {"gamma": (3.0, 2.0), "beta": (2.0, 5.0), "negative_binomial": (6.0 * 1.0, 0.4)}[family][1] == pytest.approx(b, rel=0.35)


def test_fits_at_the_edge(spark):
    assert _fit(_table(spark, [2.0, 2.0, 2.0]), "negative_binomial").overdispersion == kernels.OVERDISPERSION[0]
    assert _fit(_table(spark, [0.0, 0.0]), "negative_binomial").mean == 0
    assert _fit(_table(spark, [0.0, 0.5]), "beta").alpha is None
    assert _fit(_table(spark, [0.0, 0.5]), "gamma").shape is None
    assert math.isinf(_fit(_table(spark, [0.5, 0.5]), "gamma").shape)
