"""Edge cases on hand-made tables, and properties."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from cytolake.functions.columns import fold, protocol, wilson
from cytolake.operators import intervals as iv
from cytolake.operators import reads, significance, sites
from cytolake.sources import files

SITE = "chrom string, pos long, strand string, context string, n_reads long, n_meth long"


def test_mates(spark):
    t = spark.createDataFrame([("a", 0, "+", "CpG", 2, 1), ("a", 1, "-", "CpGx", 3, 3), ("a", 3, "-", "CpG", 1, 0), ("a", 4, "+", "CpG", 70000, 5), ("b", 5, "-", "CpG", 1, 1)], SITE)
    got = sorted(tuple(r) for r in sites.symmetric(t).collect())
    assert got == [("a", 0, "CpGx", 5, 4, True), ("a", 3, "CpG", 1, 0, False), ("a", 4, "CpG", 70000, 5, False), ("b", 5, "CpG", 1, 1, False)]
    total = t.agg(F.sum("n_reads")).first()[0]
    assert sites.symmetric(t).agg(F.sum("n_reads")).first()[0] == total
    assert sites.symmetric(t, mutated=False).count() == 3


def test_deserts_and_bins(spark):
    t = spark.createDataFrame([("a", p) for p in (0, 1000, 2001, 2002)], "chrom string, pos long")
    assert [r.segment for r in iv.segment_by_gap(t, 1000).orderBy("pos").collect()] == [1, 1, 2, 2]
    s = spark.createDataFrame([("a", p, 1, 1) for p in (0, 10, 11, 45)], "chrom string, pos long, n_reads long, n_meth long")
    got = {r.bin: r.n_reads for r in sites.bins(s, 10).collect()}
    assert got == {0: 2, 1: 1, 2: 0, 3: 0, 4: 1}


def test_interval_algebra(spark):
    r = random.Random(1)
    rows = lambda n: [(f"c{r.randint(0, 2)}", a := r.randint(0, 200), a + r.randint(1, 30)) for _ in range(n)]
    a, b = rows(60), rows(40)
    cover = lambda rows: {(c, x) for c, s, e in rows for x in range(s, e)}
    df = lambda rows: spark.createDataFrame(rows, "chrom string, start long, end long")
    out = lambda d: [(x.chrom, x.start, x.end) for x in d.collect()]
    u = out(iv.union(df(a)))
    assert cover(u) == cover(a) and all(p == q or p[0] != q[0] or p[2] < q[1] or q[2] < p[1] for p in u for q in u)
    assert cover(out(iv.difference(df(a), df(b)))) == cover(a) - cover(b)
    ends = df([(f"c{k}", 0, 300) for k in range(3)]).select("chrom", "end")
    gaps = out(iv.complement(df(a), ends))
    assert cover(gaps) == cover([(f"c{k}", 0, 300) for k in range(3)]) - cover(a)
    assert cover(out(iv.complement(df(gaps), ends))) == cover(a)
    assert sum((e - s) * d for _, s, e, d in [tuple(x) for x in iv.fragments(df(a)).collect()]) == sum(e - s for _, s, e in a)
    pairs = sorted((x.chrom, x.a_start, x.a_end, x.b_start, x.b_end) for x in iv.overlaps(df(a), df(b), bucket=16).collect())
    assert pairs == sorted((c, s, e, s2, e2) for c, s, e in a for c2, s2, e2 in b if c == c2 and s < e2 and s2 < e)
    points = spark.createDataFrame([(f"c{k % 3}", k) for k in range(250)], "chrom string, pos long")
    assert iv.points_in(points, df(a), bucket=16).count() == sum(1 for k in range(250) for c, s, e in a if c == f"c{k % 3}" and s <= k < e)
    touching = df([("c", 0, 5), ("c", 5, 9), ("c", 11, 12)])
    assert sorted(out(iv.union(touching))) == [("c", 0, 9), ("c", 11, 12)]


def test_no_cross_joins(spark):
    p = spark.range(5).select(F.lit("a").alias("chrom"), F.col("id").alias("pos"))
    q = spark.range(5).select(F.lit("a").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 3).alias("end"))
    plan = iv.points_in(p, q)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_bh_and_cutoff(spark):
    r = random.Random(2)
    ps = [r.choice([0.0001, 0.01, 0.2, 1.0, r.random() ** 3]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(ps)), "id long, p double").repartition(7)
    order = sorted(ps)
    n = len(ps)
    best, want = 1.0, {}
    for i in range(n, 0, -1):
        best = min(best, order[i - 1] * n / i)
        want.setdefault(order[i - 1], best)
    want = {p: min(v for q, v in [(x, min(1.0, min(y * n / sum(z <= y for z in order) for y in order if y >= x))) for x in {p}] if q == p) for p in set(ps)}
    for row in significance.bh(df).collect():
        assert abs(row.q - want[row.p]) < 1e-12
    i = next((i for i, p in enumerate(order, 1) if p >= 0.05 * i / n), n + 1)
    assert significance.stepup_cutoff(df, 0.05).first()[0] == order[min(i, n) - 1]  # the first that fails, else the last
    with pytest.raises(ValueError):
        significance.stepup_cutoff(df, 0)


def test_columns(spark):
    low, high = wilson("k", "n", 0.05)
    r = spark.createDataFrame([(5, 10), (0, 0)], "k long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert abs(r[0].l - 0.236593) < 1e-6 and abs(r[0].h - 0.763407) < 1e-6
    assert sites.reads_for_interval() > 10
    row = spark.range(1).select(fold(F.lit(0.75)).alias("f"), protocol(F.lit(0.5)).alias("p"), protocol(F.lit(0.7)).alias("q")).first()
    assert tuple(row) == (0.5, "random", "inconclusive")


def test_reads(spark):
    genome = spark.createDataFrame([("g", "ACGTCAGCCCG" * 3), ("h", "CC")], "chrom string, seq string")
    bases = {(r.chrom, r.pos): r for r in reads.genome_bases(genome, chunk=4).collect()}
    text = "ACGTCAGCCCG" * 3
    assert "".join(bases["g", i].base for i in range(len(text))) == text
    assert all(bases["g", i].a1 == (text[i + 1] if i + 1 < len(text) else None) and bases["g", i].b2 == (text[i - 2] if i > 1 else None) for i in range(len(text)))
    tags = {(r.chrom, r.pos): r.context for r in reads.cytosines(genome).collect()}
    assert tags["g", 1] == "CpG" and tags["g", 2] == "CpG" and tags["h", 0] == "CCG" and tags["h", 1] == "CCG"
    assert tags["g", 4] == "CXG" and tags["g", 7] == "CHH"
    mapped = spark.createDataFrame([("r1", "g", 0, "+", "ACGTTAG"), ("r2", "g", 0, "+", "ATGTCAG"), ("r3", "g", 30, "+", "CCGAAAA")], "read string, chrom string, start long, strand string, seq string")
    got = {(r.chrom, r.pos): (r.n_reads, r.n_meth) for r in reads.pileup(mapped, genome).collect()}
    assert got["g", 1] == (2, 1) and got["g", 4] == (2, 1) and got["g", 31] == (1, 1) and not any(c == "h" for c, _ in got)
    index = {r.pos: r.cpg for r in reads.cpg_index(genome.where("chrom = 'g'")).collect()}
    assert index == {p: i for i, p in enumerate(i for i in range(len(text) - 1) if text[i : i + 2] == "CG")}
    epi = {r.read: (r.cpg, r.states) for r in reads.epireads(mapped, genome).collect()}
    assert epi == {"r1": (0, "C"), "r2": (0, "T"), "r3": (index[31], "C")}
    mates = spark.createDataFrame([("x/1", "g", 0, "+", "ACGT"), ("x/2", "g", 6, "+", "GCC"), ("y/1", "g", 0, "+", "ACGTC"), ("y/2", "g", 3, "+", "TCAG"), ("z/1", "g", 1, "+", "C")], "name string, chrom string, start long, strand string, seq string")
    assert {r.pair: (r.seq, r.end, r.mates) for r in reads.merge_mates(mates).collect()} == {"x/": ("ACGTNNGCC", 9, 2), "y/": ("ACGTCAG", 7, 2), "z/": ("C", 2, 1)}


def test_smoothing_is_level_of_one_site(spark):
    s = spark.createDataFrame([("a", 5, 10, 4), ("a", 500, 0, 0)], "chrom string, pos long, n_reads long, n_meth long")
    assert {r.pos: r.smooth for r in sites.smoothed(s, 20).collect()} == {5: 0.4, 500: None}


def test_files(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("#c\nchr1\t3\t+\tCpG\t0.5\t3\nchr1\t4\t-\tCpGx\t0.1\t10\n")
    with gzip.open(tmp_path / "s.tsv.gz", "wt") as f:
        f.write("chr1\t3\t+\tCpG\t0.5\t3\n")
    rows = files.read_sites(spark, str(tmp_path / "s.tsv")).orderBy("pos").collect()
    assert [r.n_meth for r in rows] == [2, 1] and files.read_sites(spark, str(tmp_path / "s.tsv.gz")).count() == 1
    (tmp_path / "bad.tsv").write_text("chr1\t3\t*\tCpG\t0.5\t3\n")
    with pytest.raises(Exception, match="bad site"):
        files.read_sites(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "a.fa").write_text(">x one\nACG\nTTA\n>y\nCC\n")
    assert {r.chrom: r.seq for r in files.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {"x": "ACGTTA", "y": "CC"}
    (tmp_path / "1.fq").write_text("@r/1 z\nACG\n+\nIII\n@s/1\nTT\n+\nII\n")
    (tmp_path / "2.fq").write_text("@r/2\nCGT\n+\nIII\n@s/2\nAA\n+\nII\n")
    assert sorted(map(tuple, files.read_fastq_pairs(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq")).collect())) == [("r/1", "ACG", "CGT"), ("s/1", "TT", "AA")]
    (tmp_path / "a.sam").write_text("@HD\nq1\t16\tchr1\t5\t60\t1S2M1D1I2M\t*\t0\t0\tTACGTT\tIIIIII\tCV:A:T\nq2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    got = files.on_reference(files.read_sam(spark, str(tmp_path / "a.sam"))).collect()
    assert [(r.read, r.chrom, r.start, r.strand, r.seq, r.tags) for r in got] == [("q1", "chr1", 4, "-", "ACNTT", ["CV:A:T"])]
    (tmp_path / "p.txt").write_text("s1 s2\nchr1:3:+:CpG 5 2 7 0\n")
    assert sorted((r.sample, r.n_reads, r.n_meth) for r in files.read_proportions(spark, str(tmp_path / "p.txt")).collect()) == [("s1", 5, 2), ("s2", 7, 0)]
    (tmp_path / "l.txt").write_text("a\t1\tb\t5\t+\na\t1\tc\t6\t-\n")
    last = sites.last_of(files.read_liftover(spark, str(tmp_path / "l.txt"))).collect()
    assert [(r.to_chrom, r.to_pos) for r in last] == [("c", 6)]


def test_checked_raises(spark):
    t = spark.createDataFrame([("a", 1, "+", "zzz", 1, 1)], SITE)
    with pytest.raises(Exception, match="context"):
        sites.checked(t, ~F.col("context").rlike("^(CpG|CHH|CXG|CCG)x?$"), "bad context").collect()


def test_sessions_stream(spark, tmp_path):
    from cytolake.streaming import windows as sw

    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 10:00:00"), (1, "2024-01-03 00:00:00"), (2, "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "user_id long, t string").select("user_id", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = sw.sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.user_id, r.n) for r in spark.table("sessions").collect()) == [(1, 1), (1, 2), (2, 1)]
