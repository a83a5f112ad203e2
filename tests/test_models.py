"""Models against small brute forces."""

import random

from cytolake.operators import models, significance

MODEL = models.Hmm((0.5, 0.5), ((0.9, 0.1), (0.1, 0.9)), (((2.0, 4.0),), ((4.0, 2.0),)), (0, 1))


def test_null_is_a_permutation(spark):
    rows = spark.createDataFrame([("ab"[k % 2], 1, k, [k], [3 * k]) for k in range(700)], "chrom string, segment long, pos long, meth array<long>, reads array<long>")
    got = models.shuffled(rows).collect()
    place = lambda r: (r.chrom, r.segment, r.pos)
    assert sorted(map(place, got)) == sorted(map(place, rows.collect()))
    assert sorted((r.meth[0], r.reads[0]) for r in got) == [(k, 3 * k) for k in range(700)]
    assert sum(r.pos == r.meth[0] for r in got) < 20


def _bins(spark):
    rng = random.Random(5)
    low = lambda k: k % 400 < 60
    rows = []
    for k in range(2000):
        n = rng.randrange(1, 12)
        p = 0.2 if low(k) or rng.random() < 0.15 else 0.75
        rows.append(("a", k, n, sum(rng.random() < p for _ in range(n))))
    return spark.createDataFrame(rows, "chrom string, bin long, n_reads long, n_meth long")


def _runs(spark, rows):
    """(start, end, score) of runs of state 0, by walking over the decoded rows."""
    u = {r.pos: 1 - r.meth[0] / r.reads[0] for r in rows.collect()}
    out, last = [], None
    for r in models.decode(rows, MODEL).orderBy("segment", "pos").collect():
        if r.state == 0:
            if last != r.segment:
                out.append([r.pos, 0, 0.0])
            out[-1][1:] = [r.pos + 1, out[-1][2] + u[r.pos]]
        last = r.segment if r.state == 0 else None
    return out


def test_partial_domains_are_held_against_the_null(spark):
    binned = _bins(spark)
    rows = models.observations(binned.withColumn("pos", binned.bin), 5)
    found, null = _runs(spark, rows), [x[2] for x in _runs(spark, models.shuffled(rows))]
    p = [sum(x > f[2] + 1e-9 for x in null) / len(null) for f in found]
    ranked, cut = sorted(p), -1.0
    for i, x in enumerate(ranked):
        if x >= 0.01 * (i + 1) / len(p):
            break
        cut = x
    good = [f for f, x in zip(found, p) if x <= cut]
    assert 0 < len(good) < len(found)
    merged = []
    for start, end, _ in sorted(good):
        if merged and 20 * start - merged[-1][1] <= 40:
            merged[-1][1] = 20 * end
        else:
            merged.append([20 * start, 20 * end])
    got = models.partial_domains(binned, 20, model=MODEL).orderBy("start").collect()
    assert [[r.start, r.end] for r in got] == merged


def test_untested_rows_stay_and_end_islands(spark):
    counts = [10, 9, 10, 1]
    rows = spark.createDataFrame([("a", k, 1e-6 if k != 3 else -1.0, *counts) for k in range(7)], "chrom string, pos long, p double, cov_a long, meth_a long, cov_b long, meth_b long")
    corr = spark.createDataFrame([(0, 0.1)], "bin long, corr double")
    got = significance.adjusted(rows, corr, 1, 10)
    assert [(r.pos, r.p, r.q is None, r.combined_p is None) for r in got.orderBy("pos").collect()] == [(k, -1.0 if k == 3 else 1e-6, k == 3, k == 3) for k in range(7)]
    assert sorted((r.start, r.end) for r in significance.significant_islands(got, 0.01).collect()) == [(0, 3), (4, 7)]
