"""Trained models and read windows against plain implementations, site by site."""

import itertools
import math
import random

import numpy as np
import pytest

from cytolake.functions import kernels
from cytolake.operators import intervals, models, reads, sites, significance

TWO = models.Hmm((0.5, 0.5), ((0.75, 0.25), (0.25, 0.75)), (((2.0, 5.0),), ((5.0, 2.0),)), (0, 1))
THREE = models.Hmm((0.5, 0.25, 0.25), ((0.99, 0.01, 0.0), (0.05, 0.475, 0.475), (0.0, 0.6, 0.3)), (((2.0, 5.0),), ((5.0, 2.0),)), (0, 1, 0), (1e-10,) * 3)


def _segments(seed, lengths):
    r = random.Random(seed)
    out = []
    for n in lengths:
        low, rows = True, []
        for _ in range(n):
            low = low if r.random() < 0.85 else not low
            reads_ = r.randint(0, 9)
            rows.append((sum(r.random() < (0.15 if low else 0.8) for _ in range(reads_)), reads_))
        out.append(rows)
    return out


def _emit(model, rows):
    def pmf(m, n, a, b):
        if not n:
            return 1.0
        lb = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
        return math.comb(n, m) * math.exp(lb(a + m, b + n - m) - lb(a, b))

    return [[pmf(m, n, *model.emission[g][0]) for g in model.groups] for m, n in rows]


def _expected(model, rows):
    """Posteriors, summed pairs of neighbours and log-likelihood, from sums over all paths of a segment."""
    k, n = len(model.start), len(rows)
    emit, end = _emit(model, rows), model.end or (1.0,) * k
    f = [[model.start[s] * emit[0][s] for s in range(k)]]
    for t in range(1, n):
        f.append([sum(f[-1][a] * model.trans[a][b] for a in range(k)) * emit[t][b] for b in range(k)])
    b = [list(end)]
    for t in range(n - 1, 0, -1):
        b.insert(0, [sum(model.trans[a][c] * emit[t][c] * b[0][c] for c in range(k)) for a in range(k)])
    total = sum(x * y for x, y in zip(f[-1], end))
    post = [[f[t][s] * b[t][s] / total for s in range(k)] for t in range(n)]
    pairs = np.zeros((k, k))
    for t in range(1, n):
        for x, y in itertools.product(range(k), repeat=2):
            pairs[x, y] += f[t - 1][x] * model.trans[x][y] * emit[t][y] * b[t][y] / total
    return post, pairs, math.log(total)


def _plain(model, segments, iterations, tolerance, likelihood):
    """The same rounds in loops over sites; the emissions are fitted by the kernel, which has tests of its own."""
    score = -math.inf
    for _ in range(iterations):
        sums, pairs, now = np.zeros((len(model.emission), 3)), np.zeros((len(model.start),) * 2), 0.0
        for rows in segments:
            post, some, ll = _expected(model, rows)
            pairs, now = pairs + some, now + ll
            for (m, n), p in zip(rows, post):
                if n:
                    level = min(max(m / n, 0.01), 0.99)
                    for s, g in enumerate(model.groups):
                        sums[g] += np.array([1, math.log(level), math.log(1 - level)]) * p[s]
        before, score = score, now
        if likelihood == "relative" and (score - before) / abs(score) < tolerance:
            break
        trans = pairs + models.FLOOR * (np.array(model.trans) > 0)
        trans /= trans.sum(axis=1, keepdims=True)
        moved = np.abs(trans - np.array(model.trans)).max()
        start = model.start if len(model.start) > 2 or model.end else (trans[1, 0] / (trans[0, 1] + trans[1, 0]), trans[0, 1] / (trans[0, 1] + trans[1, 0]))
        model = models.replace(model, start=start, trans=tuple(map(tuple, trans.tolist())), emission=tuple((kernels.fit_beta(*x),) for x in sums))
        if abs(score - before) < tolerance if likelihood == "absolute" else likelihood is None and moved < tolerance:
            break
    return model


def _table(spark, segments):
    rows = [(f"c{i}", 1, t, [m], [n]) for i, some in enumerate(segments) for t, (m, n) in enumerate(some)]
    return spark.createDataFrame(rows, "chrom string, segment long, pos long, meth array<long>, reads array<long>").repartition(5)


@pytest.mark.parametrize("model, likelihood, tolerance", [(TWO, None, 1e-10), (TWO, None, 0.05), (THREE, "relative", 1e-10), (THREE, "relative", 0.02), (models.replace(TWO, end=(1e-10, 1e-10)), "absolute", 1.0)])
def test_training_by_hand(spark, model, likelihood, tolerance):
    segments = _segments(4, [1, 2, 30, 60, 45])
    want = _plain(model, segments, 8, tolerance, likelihood)
    got = models.train(_table(spark, segments), model, 8, tolerance, likelihood)
    assert np.allclose(got.trans, want.trans, rtol=1e-6, atol=1e-9) and np.allclose(got.start, want.start, rtol=1e-6)
    assert np.allclose(np.array(got.emission), np.array(want.emission), rtol=1e-5)


def test_three_states_within_domains(spark):
    """Domains hold a dip that two states would cut them at; a path from the first to the third state is not possible."""
    r = random.Random(2)
    state = lambda k: 0 if k % 100 < 60 else 2 if k % 10 > 6 else 1
    rows = [("a", 5 * k, sum(r.random() < (0.05, 0.9, 0.05)[state(k)] for _ in range(12)), 12) for k in range(900)]
    t = spark.createDataFrame(rows, "chrom string, pos long, n_meth long, n_reads long")
    got = models.hyper_domains(t, desert=1000).orderBy("start").collect()
    assert len(got) == 9
    for k, x in enumerate(got):
        assert abs(x.start - 5 * (100 * k + 60)) <= 20 and abs(x.end - 5 * (100 * k + 97)) <= 25


# -- windows of reads --------------------------------------------------------------------------------------------------


def _reads(seed, n=150):
    r = random.Random(seed)
    return [(r.choice(["a", "b"]), r.randint(0, 30), "".join(r.choice("CCTTN") for _ in range(r.choice([1, 2, 3, 4, 5, 9, 40])))) for _ in range(n)]


@pytest.mark.parametrize("width", [1, 2, 4, 10, 31])
def test_window_patterns(spark, monkeypatch, width):
    rows = _reads(width)
    want = {}
    for chrom, cpg, s in rows:
        for w in range(max(0, cpg - width + 1), cpg + len(s)):
            p = "".join(s[i - cpg] if cpg <= i < cpg + len(s) else "." for i in range(w, w + width))
            want[chrom, w, p] = want.get((chrom, w, p), 0) + 1
    odd = [(None, 3, "CT"), ("a", None, "CT"), ("a", 3, None), ("a", 3, "")]
    got = {}
    for x in reads.window_patterns(spark.createDataFrame(rows + odd, "chrom string, cpg long, states string").repartition(3), width).collect():
        got[x.chrom, x.window, x.pattern] = got.get((x.chrom, x.window, x.pattern), 0) + x.n
    assert got == want


@pytest.mark.parametrize("width, flip", [(4, False), (4, True), (2, False), (1, False), (6, False)])
def test_entropy(spark, width, flip):
    rows = _reads(7)
    if flip:
        swap = str.maketrans("CT", "TC")
        used = [(c, k, s.translate(swap) if s.count("T") > s.count("C") else s) for c, k, s in rows]
        from pyspark.sql import functions as F

        from cytolake.functions.columns import flipped

        made = spark.createDataFrame(rows, "chrom string, cpg long, states string").select("chrom", "cpg", flipped(F.col("states")).alias("states")).collect()
        used = [tuple(x) for x in made]
    else:
        used = rows
    shown = {}
    for chrom, cpg, s in used:
        for i, x in enumerate(s):
            if x in "CT":
                shown.setdefault((chrom, cpg + i), []).append(x == "C")
    level = {k: sum(v) / len(v) for k, v in shown.items()}
    mass, n = {}, {}
    for chrom, cpg, s in used:
        for w in range(max(0, cpg - width + 1), cpg + len(s)):
            n[chrom, w] = n.get((chrom, w), 0) + 1
            for bits in itertools.product((0, 1), repeat=width):
                p = 1.0
                for i, bit in enumerate(bits):
                    x = s[w + i - cpg] if 0 <= w + i - cpg < len(s) else "."
                    one = 1.0 if x == "C" else 0.0 if x == "T" else level.get((chrom, w + i), 0.5)
                    p *= one if bit else 1 - one
                mass[chrom, w, bits] = mass.get((chrom, w, bits), 0.0) + p
    want = {k: -sum(m / n[k] * math.log2(m / n[k]) for b in itertools.product((0, 1), repeat=width) if (m := mass[(*k, b)]) > 0) / width for k in n}
    got = reads.entropy(spark.createDataFrame(rows, "chrom string, cpg long, states string").repartition(3), width, flip).collect()
    assert {(x.chrom, x.window): x.n_reads for x in got} == n
    assert all(abs(x.entropy - want[x.chrom, x.window]) < 1e-9 for x in got)


# -- groups and distances ------------------------------------------------------------------------------------------------


def test_distance_correlation(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.randint(0, 20_000) if k % 2 else r.randint(4000, 4300), r.random()) for k in range(500)] + [("a", 5, None)]
    t = spark.createDataFrame(rows, "chrom string, pos long, v double").repartition(4)
    got = {x.bin: (x.n, x.corr) for x in significance.distance_correlation(t, t.v, 2, 102, 10).collect()}
    pairs = {}
    for c, p, v in rows:
        for d, q, w in rows:
            if c == d and v is not None and w is not None and 2 <= q - p < 102:
                pairs.setdefault((q - p - 2) // 10, []).append((v, w))
    assert set(got) == set(pairs)
    for k, some in pairs.items():
        want = np.corrcoef(np.array(some).T)[0, 1] if len(some) > 1 else 0.0
        assert got[k][0] == len(some) and abs(got[k][1] - want) < 1e-9


def test_bin_size(spark):
    r = random.Random(6)
    rows = [("ab"[k % 2], r.choice([0, 1, 10, 11, r.randint(0, 3000)]), "+", "CpG", r.randint(0, 4), 0) for k in range(900)]
    t = spark.createDataFrame(rows, "chrom string, pos long, strand string, context string, n_reads long, n_meth long").repartition(4)
    for share in (0.3, 0.8, 0.99, 1.1):
        need, want = sites.reads_for_interval(0.8, 1 - 0.8), 400
        for size in range(20, 400, 10):
            held = {}
            for c, p, *_, n, _ in rows:
                k = (c, max(0, -(-p // size) - 1))
                held[k] = held.get(k, 0) + n
            full = [v for v in held.values() if v > 0]
            if sum(v >= need for v in full) >= share * len(full):
                want = size
                break
        assert sites.bin_size(t, 10, 400, 20, share=share).first()[0] == want
    with pytest.raises(ValueError):
        sites.bin_size(t, 7, 400, 20)


def test_clusters(spark):
    r = random.Random(9)
    regions = [("a", s, s + r.randint(1, 9), f"r{s}") for s in range(0, 300, 7)] + [("b", 5, 9, "x")]
    items = [("a", s := r.randint(0, 320), s + r.randint(1, 30), f"i{k}", k % 3) for k in range(120)]
    items += [items[0], items[0], ("c", 1, 2, "far", 0)]
    frame = lambda rows, more="": spark.createDataFrame(rows, "chrom string, start long, end long, name string" + more).repartition(3)
    found = intervals.clustered(frame(items, ", tag int"), frame(regions))
    want = []
    for c, s, e, n, tag in items:
        hit = [(a, b, m) for d, a, b, m in regions if c == d and s < b and a < e]
        if hit:
            want.append((c, s, e, n, tag, *min(hit)))
    assert sorted(map(tuple, found.collect())) == sorted(want)
    moved = sorted(tuple(x) for x in intervals.adjusted_regions(frame(regions), found).collect())
    expect = []
    for c, a, b, m in regions:
        mine = [w for w in want if (w[0], w[5], w[6], w[7]) == (c, a, b, m)]
        expect.append((c, min([a] + [w[1] for w in mine]), max([b] + [w[2] for w in mine]), m, len(mine)))
    assert moved == sorted(expect)


def test_names_and_widths(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    assert sites.unique_names(t).count() == 2
    for bad in ([("a", 1), ("a", 2)], [(None, 1)]):
        with pytest.raises(Exception, match="names of their own"):
            sites.unique_names(spark.createDataFrame(bad, "name string, v int")).collect()
    rows = [("s1", "p1", 1.0), ("s1", "p2", 2.0), ("s2", "p1", 3.0), ("s2", "p2", 4.0)]
    even = lambda r: sites.even_widths(spark.createDataFrame(r, "sample string, probe string, value double"))
    assert even(rows).count() == 4
    for bad in (rows[:3], rows[:3] + [("s2", "p1", 0.0)]):
        with pytest.raises(Exception, match="differ in width"):
            even(bad).collect()


def test_disjoint(spark):
    frame = lambda rows: spark.createDataFrame(rows, "chrom string, start long, end long, name string")
    good = [("a", 0, 5, "x"), ("a", 5, 9, "y"), ("b", 3, 4, "z"), ("a", 20_000, 90_000, "w"), ("a", 90_000, 90_001, "v")]
    assert sorted(map(tuple, intervals.disjoint(frame(good)).collect())) == sorted(good)
    for bad in (("a", 4, 5, "u"), ("a", 50_000, 50_001, "u"), ("b", 9, 8, "u")):
        with pytest.raises(Exception, match="regions overlap"):
            intervals.disjoint(frame([*good, bad])).collect()


def test_bad_sites(spark, tmp_path):
    from cytolake.sources import files

    (tmp_path / "good").write_text("chr1\t5\t+\tCpG\t0.5\t4\nchr1\t9\t-\tCHHx\t1\t3\n")
    assert [tuple(r) for r in files.read_sites(spark, str(tmp_path / "good")).orderBy("pos").collect()] == [("chr1", 5, "+", "CpG", 0.5, 4, 2), ("chr1", 9, "-", "CHHx", 1.0, 3, 3)]
    for k, line in enumerate(("chr1\t5\t.\tCpG\t0.5\t4", "chr1\t5\t+\tCpA\t0.5\t4", "chr1\t5\t+\tCpG\t1.5\t4", "chr1\t5\t+\tCpG\t\t4")):
        (tmp_path / f"bad{k}").write_text(line + "\n")
        with pytest.raises(Exception, match="bad site"):
            files.read_sites(spark, str(tmp_path / f"bad{k}")).collect()
    (tmp_path / "old").write_text("chr1\t5\t6\tCpG:7\t0.25\t+\n")
    assert tuple(files.read_legacy_sites(spark, str(tmp_path / "old")).first()) == ("chr1", 5, "+", "CpG", 0.25, 7)


def test_array_domains(spark):
    """Levels of two kinds of stretches, and some low ones alone; what random order also makes is no domain."""
    r = random.Random(3)
    alone = {k for k in range(900) if r.random() < 0.1}
    low = lambda k: (k // 50) % 3 == 1 or k in alone
    rows = [("a", 10 * k + 5, r.betavariate(1, 9) if low(k) else r.betavariate(9, 1)) for k in range(900) for _ in range(2)]
    rows += [("a", 7, None), ("a", 7, 0.0), ("a", 7, 1.0)]
    got = models.array_partial_domains(spark.createDataFrame(rows, "chrom string, pos long, meth double"), 10).orderBy("start").collect()
    assert len(got) == 6
    for x, k in zip(got, range(1, 18, 3)):
        assert abs(x.start / 10 - 50 * k) <= 6 and abs(x.end / 10 - 50 * k - 50) <= 6
