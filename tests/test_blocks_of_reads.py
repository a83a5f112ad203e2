"""Reads that meet in blocks of windows: the same results as pattern by pattern, and bounded memory."""

import random

import numpy as np

from cytolake.functions import kernels
from cytolake.operators import models, reads


def _reads(spark, seed=1, n=120):
    r = random.Random(seed)
    rows = [(r.choice("ab"), r.randint(0, 150), "".join(r.choice("CCTTTN") for _ in range(r.choice([1, 3, 20, 90])))) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "chrom string, cpg long, states string").repartition(5)


def _score(parts, bic):
    return models.allele_test(parts, bic=bic)


def test_windows_meet_in_blocks(spark, monkeypatch):
    """Of a block only distinct patterns are held; no row for each window and read is shuffled."""
    rows, t = _reads(spark)
    want = {}
    for chrom, cpg, s in rows:
        for w in range(max(0, cpg - 9), cpg + len(s)):
            part = s[max(0, w - cpg) : w + 10 - cpg]
            if set(part) & set("CT"):
                want.setdefault((chrom, w), []).append((max(0, cpg - w), part))
    want = {k: v for k, v in want.items() if sum(len(p) for _, p in v) >= 40}
    for bic in (False, True):
        got = {(x.chrom, x.window): x for x in models.amr_windows(t, bic=bic).collect()}
        assert got.keys() == want.keys() and len(got) > 100
        assert all(got[k].n_reads == len(v) and abs(got[k].score - _score(v, bic)) < 1e-7 for k, v in want.items())
    from cytolake.operators.reads import BLOCK

    pieces = reads.read_pieces(t, BLOCK, 9)
    assert pieces.count() < len(rows) + sum(len(s) // BLOCK + 2 for _, _, s in rows)


def test_given_regions_meet_in_blocks(spark):
    """a read meets only the regions that begin in its blocks."""
    rows, t = _reads(spark, 2)
    r = random.Random(5)
    regions = list({(r.choice("abc"), at, at + r.choice([1, 8, 70, 200])) for at in (r.randint(0, 230) for _ in range(60))})
    given = spark.createDataFrame(regions, "chrom string, start long, end long").repartition(3)
    want = {}
    for chrom, start, end in regions:
        met = [(max(0, cpg - start), s[max(0, start - cpg) : max(0, end - cpg)]) for c, cpg, s in rows if c == chrom and cpg < end and start < cpg + len(s)]
        met = [m for m in met if set(m[1]) & set("CT")]
        if met:
            want[chrom, start, end] = met
    got = {(x.chrom, x.start, x.end): x for x in models.amr_test(t, given).collect()}
    assert got.keys() == want.keys()
    assert all(got[k].n_reads == len(v) and abs(got[k].score - models.allele_test(v)) < 1e-7 for k, v in want.items())


def test_fisher_holds_few_tables_at_once(monkeypatch):
    """margins of deep tables are summed over in slices of rows."""
    r = np.random.default_rng(4)
    rows = r.integers(0, 400, (4, 300))
    want, sizes, spans = kernels.fisher_two_sided(*rows), [], kernels._spans
    monkeypatch.setattr(kernels, "TABLES", 1000)
    monkeypatch.setattr(kernels, "_spans", lambda low, high: sizes.append(int((high - low).sum())) or spans(low, high))
    assert np.array_equal(kernels.fisher_two_sided(*rows), want)
    assert len(sizes) > 10 and max(sizes) <= 1000


def test_pairs_and_entropy_shuffle_pieces(spark):
    """pieces of reads are shuffled once, as long as their block."""
    _, t = _reads(spark, 3)
    for out in (reads.pair_states(t), reads.entropy(t)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
