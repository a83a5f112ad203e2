"""Values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.functions import kernels
from cytolake.functions.columns import fold
from cytolake.operators import intervals, models, significance, sites


def test_fold_makes_partial_levels_low(spark):
    rows = spark.createDataFrame([(p,) for p in (0.0, 0.25, 0.5, 0.9, 1.0)], "p double")
    assert [round(r[0], 9) for r in rows.orderBy("p").select(fold(F.col("p"))).collect()] == [1.0, 0.5, 0.0, 0.8, 1.0]


def test_stepup_cutoff_is_the_first_that_fails(spark):
    cut = lambda ps: significance.stepup_cutoff(spark.createDataFrame([(p,) for p in ps], "p double"), 0.1).first()[0]
    assert cut([0.01, 0.02, 0.08, 0.5]) == 0.08  # 0.01 < 0.025, 0.02 < 0.05, 0.08 >= 0.075
    assert cut([0.5, 0.6]) == 0.5
    assert cut([0.001, 0.002, 0.003]) == 0.003  # none fails: the greatest
    assert cut([0.03, 0.03, 0.03, 0.9]) == 0.03  # the first of equal ones fails: 0.03 >= 0.025
    assert cut([]) is None
    with pytest.raises(ValueError):
        cut_all = significance.stepup_cutoff(spark.createDataFrame([(0.1,)], "p double"), 0.0)
        cut_all.first()


def _plain(model, logs, lengths):
    """Forward and backward, site by site."""
    trans, at, post, counts, ll = np.array(model.trans), 0, [], 0, 0.0
    for n in lengths:
        e = np.exp(logs[at : at + n])
        a, b = np.zeros((n, len(trans))), np.ones((n, len(trans)))
        for i in range(n):
            a[i] = (np.array(model.start) if i == 0 else a[i - 1] @ trans) * e[i]
        for i in range(n - 2, -1, -1):
            b[i] = trans @ (e[i + 1] * b[i + 1])
        total = a[-1].sum()
        post.append(a * b / total)
        counts = counts + sum(a[i - 1][:, None] * trans * (e[i] * b[i]) / total for i in range(1, n))
        ll, at = ll + math.log(total), at + n
    return np.concatenate(post), counts, ll


def test_blocks_of_segments_are_site_by_site(monkeypatch):
    monkeypatch.setattr(models, "BLOCK", 7)
    rng, model = np.random.default_rng(3), models.Hmm((0.3, 0.5, 0.2), ((0.8, 0.2, 0.0), (0.1, 0.7, 0.2), (0.0, 0.4, 0.6)), (), ())
    lengths = np.array([1, 7, 8, 30, 2, 14])
    logs = np.log(rng.random((lengths.sum(), 3)))
    for got, want in zip(models.forward_backward(model, logs, lengths), _plain(model, logs, lengths)):
        assert np.allclose(got, want)
    _, steps, _ = models.forward_backward(model, logs, lengths, steps=True)
    assert np.allclose(steps.sum(axis=0), _plain(model, logs, lengths)[1]) and not steps[0].any()


def test_a_model_is_saved_and_loaded(spark, tmp_path):
    model = models.Hmm((0.5, 0.5), ((0.9, 0.1), (0.2, 0.8)), (((1.5, 2.0), (3.0, 4.0)), ((5.0, 6.0), (7.0, 8.0))), (0, 1), (1e-10, 1e-10), (False, True))
    models.save_model(spark, model, str(tmp_path / "m"))
    assert models.load_model(spark, str(tmp_path / "m")) == model


def test_neighbours_over_blocks(spark):
    rng = np.random.default_rng(1)
    places = sorted(set(rng.integers(0, 90_000, 300).tolist()))
    rows = spark.createDataFrame([("a", p, p + 40) for p in places], "chrom string, pos long, end long")
    got = sites.distances(rows).orderBy("pos").collect()
    assert [r.gap for r in got] == [None] + [b - a for a, b in zip(places, places[1:])]
    segments = [r.segment for r in intervals.segment_by_gap(rows, 500).orderBy("pos").collect()]
    assert segments == (1 + np.cumsum([0] + [b - a > 500 for a, b in zip(places, places[1:])])).tolist()
    merged, want = intervals.union(rows.withColumnRenamed("pos", "start")), []
    for p in places:
        if want and p <= want[-1][1]:
            want[-1][1] = p + 40
        else:
            want.append([p, p + 40])
    assert sorted([r.start, r.end] for r in merged.collect()) == want


def test_errors(spark):
    one = spark.createDataFrame([("a", 1, 5, 2), ("a", 1, 5, 2)], "chrom string, pos long, n_reads long, n_meth long")
    with pytest.raises(Exception, match="comes twice"):
        sites.paired(one, one).collect()
    with pytest.raises(Exception, match="different sites"):
        sites.lock_step(one.limit(1), one.limit(0)).collect()
    order = lambda names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "chrom string, at long")
    assert sites.chromosome_order([order("abd"), order("bcd")]) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError, match="do not agree"):
        sites.chromosome_order([order("ab"), order("ba")])


def test_families():
    assert math.isclose(float(kernels.log_density("poisson", 2, 3.0)), math.log(9 / 2) - 3)
    assert math.isclose(float(kernels.log_density("normal", 1, 0.0, 1.0)), -0.5 - 0.5 * math.log(2 * math.pi))
    assert math.isclose(float(kernels.log_density("beta", 0.25, 2.0, 2.0)), math.log(6 * 0.25 * 0.75))
    assert math.isclose(float(kernels.log_density("negative_binomial", 0, 3.0, 0.4)), 3 * math.log(0.4))
    assert math.isclose(float(kernels.log_density("gamma", 2, 1.0, 3.0)), -2 / 3 - math.log(3))
    assert math.isclose(float(kernels.log_density("geometric", 3, 0.5)), 3 * math.log(0.5))
    assert math.isclose(kernels.sign_test([1, 2, 3, 4], [0, 0, 0, 9]), 10 / 16)
