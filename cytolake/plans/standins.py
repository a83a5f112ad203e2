"""Stand-ins for methylomes, made from the driver's tables, in Spark and as SQL common table expressions.

All are integer arithmetic on keys, so that both engines make the same rows. `l_discount * 100` is rounded first, as it
is not integral in every row; (order, line) is no key, so rows are grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, pos, strand, context, sample, n_reads, n_meth: a site of a sample per row."""
    li = table(spark, sf_dir, "lineitem")
    quantity, tenths = F.col("l_quantity").cast("bigint"), F.round(F.col("l_discount") * 100).cast("bigint")
    minus = F.when(F.col("l_returnflag") == "A", 0).otherwise(1)
    k = F.col("l_partkey") % 4
    return (
        li.select(
            F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("chrom"),
            (2 * F.col("l_partkey") + minus).alias("pos"),
            F.when(minus == 0, "+").otherwise("-").alias("strand"),
            F.when(k == 0, "CpG").when(k == 1, "CHH").when(k == 2, "CXG").otherwise("CCG").alias("context"),
            F.col("l_linenumber").cast("bigint").alias("sample"),
            quantity.alias("q"),
            (quantity * tenths).alias("qt"),
        )
        .withColumn("m", F.expr("qt div 10"))
        .groupBy("chrom", "pos", "strand", "context", "sample")
        .agg(F.sum("q").alias("n_reads"), F.sum("m").alias("n_meth"))
    )


SAMPLES = """samples AS (
  SELECT 'chr' || CAST(l_suppkey % 5 AS VARCHAR) AS chrom,
         2 * l_partkey + CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS pos,
         CASE WHEN l_returnflag = 'A' THEN '+' ELSE '-' END AS strand,
         CASE l_partkey % 4 WHEN 0 THEN 'CpG' WHEN 1 THEN 'CHH' WHEN 2 THEN 'CXG' ELSE 'CCG' END AS context,
         CAST(l_linenumber AS BIGINT) AS sample,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n_reads,
         CAST(sum(CAST(l_quantity AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT) // 10) AS BIGINT) AS n_meth
  FROM lineitem GROUP BY ALL)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, pos, strand, context, n_reads, n_meth over all samples."""
    return samples(spark, sf_dir).groupBy("chrom", "pos", "strand", "context").agg(F.sum("n_reads").alias("n_reads"), F.sum("n_meth").alias("n_meth"))


SITES = SAMPLES + """, sites AS (
  SELECT chrom, pos, strand, context, CAST(sum(n_reads) AS BIGINT) AS n_reads, CAST(sum(n_meth) AS BIGINT) AS n_meth
  FROM samples GROUP BY ALL)"""


def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, pos, n_reads, n_meth: both strands of a place together, as symmetric CpG sites."""
    return sites(spark, sf_dir).withColumn("pos", F.expr("pos div 2 * 2")).groupBy("chrom", "pos").agg(F.sum("n_reads").alias("n_reads"), F.sum("n_meth").alias("n_meth"))


COLLAPSED = SITES + """, collapsed AS (
  SELECT chrom, pos // 2 * 2 AS pos, CAST(sum(n_reads) AS BIGINT) AS n_reads, CAST(sum(n_meth) AS BIGINT) AS n_meth FROM sites GROUP BY ALL)"""


_LOW = "(pos div 40) % 4 = 1 OR (pos div 2) % 53 = 7 AND (pos div 40) % 4 = 3"


def _planted_share(reads, pos):
    """Methylated reads: few in the planted blocks and at some single places, many elsewhere."""
    return F.when(F.expr(_LOW), F.expr(f"{reads} * (4 + {pos} % 7) div 100")).otherwise(F.expr(f"{reads} * (85 + {pos} % 11) div 100"))


def planted(spark: SparkSession, sf_dir: str, replicates: bool = False) -> DataFrame:
    """collapsed() with levels that make domains: 40 positions in each 160 are low, and some single places between. With replicates, reads and meth of odd and even samples as arrays."""
    if not replicates:
        return collapsed(spark, sf_dir).withColumn("n_meth", _planted_share("n_reads", "pos"))
    t = samples(spark, sf_dir).withColumn("pos", F.expr("pos div 2 * 2"))
    r = t.groupBy("chrom", "pos").agg(*[F.coalesce(F.sum(F.when(F.col("sample") % 2 == k, F.col("n_reads"))), F.lit(0)).alias(f"r{k}") for k in (0, 1)])
    return r.select("chrom", "pos", F.array("r0", "r1").alias("reads"), F.array(_planted_share("r0", "pos"), _planted_share("r1", "pos")).alias("meth"))


_SHARE = "{r} * CASE WHEN (pos // 40) % 4 = 1 OR (pos // 2) % 53 = 7 AND (pos // 40) % 4 = 3 THEN 4 + pos % 7 ELSE 85 + pos % 11 END // 100"
PLANTED = COLLAPSED + ", planted AS (SELECT chrom, pos, n_reads, " + _SHARE.format(r="n_reads") + " AS n_meth FROM collapsed)"
PLANTED_TWO = SAMPLES + f""", halves AS (SELECT chrom, pos // 2 * 2 AS pos, CAST(coalesce(sum(n_reads) FILTER (sample % 2 = 0), 0) AS BIGINT) AS r0, CAST(coalesce(sum(n_reads) FILTER (sample % 2 = 1), 0) AS BIGINT) AS r1 FROM samples GROUP BY ALL),
  planted_two AS (SELECT chrom, pos, r0, r1, {_SHARE.format(r="r0")} AS m0, {_SHARE.format(r="r1")} AS m1 FROM halves)"""


def assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, pos, and counts of three assays, to which samples are dealt by their number: u, t (TAB), h, g (bisulfite), m, l (oxidative). In SQL the first two pairs are h, g and t, u."""
    t = samples(spark, sf_dir).withColumn("pos", F.expr("pos div 2 * 2"))
    cell = lambda k, x: F.coalesce(F.sum(F.when(F.col("sample") % 3 == k, x)), F.lit(0)).cast("double")
    yes, no = F.col("n_meth"), F.col("n_reads") - F.col("n_meth")
    return t.groupBy("chrom", "pos").agg(*[cell(k, x).alias(c) for k, pair in enumerate(("ut", "hg", "ml")) for c, x in zip(pair, (yes, no))])


ASSAYS = SAMPLES + ", raw AS (SELECT chrom, pos // 2 * 2 AS pos, sample % 3 AS assay, n_meth AS yes, n_reads - n_meth AS no FROM samples), assays AS (SELECT chrom, pos, " + ", ".join(f"CAST(coalesce(sum({x}) FILTER (assay = {k}), 0) AS DOUBLE) AS {c}" for k, pair in enumerate(("hg", "tu", "ml")) for c, x in zip(pair, ("yes", "no"))) + " FROM raw GROUP BY chrom, pos)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAM records of pairs made from lineitem's keys: two ends of 20 and 30 bases, apart, overlapping or dovetailed, as one mapper or another writes them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    one, two = (F.col("c") % 500 + 100).alias("pos"), F.expr("c % 500 + 100 + k % 71 - 15").alias("other")
    base = o.select("k", "c", one, two, F.expr("substr(repeat('ACGTTGCA', 6), cast(k % 8 + 1 as int), 20)").alias("s1"), F.expr("substr(repeat('GATTACAC', 6), cast(c % 8 + 1 as int), 30)").alias("s2"))
    end = lambda i, pos, other, seq, flag, cigar: base.select(F.concat(F.lit("r"), F.col("k").cast("string"), F.lit(f"_{i}")).alias("qname"), F.lit(flag).alias("flag"), F.concat(F.lit("chr"), (F.col("c") % 3).cast("string")).alias("rname"), F.col(pos).alias("pos"), F.lit(255).alias("mapq"), F.lit(cigar).alias("cigar"), F.lit("=").alias("rnext"), F.col(other).alias("pnext"), F.lit(0).alias("tlen"), F.col(seq).alias("seq"), F.lit("*").alias("qual"), F.array(F.when(F.col("k") % 2 == 0, "ZS:Z:++").otherwise("ZS:Z:+-"), F.lit("NM:i:1"), F.when(F.col("k") % 2 == 0, "XR:Z:CT").otherwise("XR:Z:GA")).alias("tags"))
    return end(1, "pos", "other", "s1", 1 + 64, "20M").unionByName(end(2, "other", "pos", "s2", 1 + 16 + 128, "30M"))


RECORDS = """ends AS (SELECT o_orderkey AS k, o_custkey AS c, o_custkey % 500 + 100 AS pos, o_custkey % 500 + 100 + o_orderkey % 71 - 15 AS other,
  substr(repeat('ACGTTGCA', 6), CAST(o_orderkey % 8 + 1 AS INTEGER), 20) AS s1, substr(repeat('GATTACAC', 6), CAST(o_custkey % 8 + 1 AS INTEGER), 30) AS s2 FROM orders),
records AS (SELECT 'r' || k || '_1' AS qname, 65 AS flag, 'chr' || c % 3 AS rname, pos, s1 AS seq, k FROM ends UNION ALL SELECT 'r' || k || '_2', 145, 'chr' || c % 3, other, s2, k FROM ends)"""


def two_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, pos, meth_a, unmeth_a, meth_b, unmeth_b: odd samples against even samples at places that both have."""
    s = samples(spark, sf_dir).withColumn("pos", F.expr("pos div 2 * 2"))
    a = F.col("sample") % 2 == 1
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    g = s.groupBy("chrom", "pos").agg(total("n_meth", a).alias("meth_a"), total("n_reads", a).alias("reads_a"), total("n_meth", ~a).alias("meth_b"), total("n_reads", ~a).alias("reads_b"))
    return g.where("reads_a > 0 and reads_b > 0").select("chrom", "pos", "meth_a", (F.col("reads_a") - F.col("meth_a")).alias("unmeth_a"), "meth_b", (F.col("reads_b") - F.col("meth_b")).alias("unmeth_b"))


TWO_GROUPS = SAMPLES + """, grouped AS (
  SELECT chrom, pos // 2 * 2 AS pos,
         CAST(coalesce(sum(n_meth) FILTER (sample % 2 = 1), 0) AS BIGINT) AS meth_a, CAST(coalesce(sum(n_reads) FILTER (sample % 2 = 1), 0) AS BIGINT) AS reads_a,
         CAST(coalesce(sum(n_meth) FILTER (sample % 2 = 0), 0) AS BIGINT) AS meth_b, CAST(coalesce(sum(n_reads) FILTER (sample % 2 = 0), 0) AS BIGINT) AS reads_b
  FROM samples GROUP BY ALL), two_groups AS (
  SELECT chrom, pos, meth_a, reads_a - meth_a AS unmeth_a, meth_b, reads_b - meth_b AS unmeth_b FROM grouped WHERE reads_a > 0 AND reads_b > 0)"""


_CHANGED = "CASE WHEN (pos {div} 40) % 4 = 1 THEN 0.01 * (1 + pos % 7) WHEN (pos {div} 40) % 4 = 3 THEN 1 - 0.01 * (1 + pos % 7) ELSE 0.01 * (35 + pos * 7 % 30) END"


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, pos, value, meth_a, unmeth_a, meth_b, unmeth_b: places with a gain in one block of 40 positions in 160 and a loss in another. value is near 0 in a gain and near 1 in a loss."""
    t = collapsed(spark, sf_dir).withColumn("value", F.expr(_CHANGED.format(div="div")).cast("double"))
    side = F.expr("CASE WHEN (pos div 40) % 4 = 1 THEN 2 WHEN (pos div 40) % 4 = 3 THEN 8 ELSE 5 END").cast("bigint")
    return t.select("chrom", "pos", "value", side.alias("meth_a"), (10 - side).alias("unmeth_a"), (10 - side).alias("meth_b"), side.alias("unmeth_b"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, start, end, name: disjoint regions."""
    p = table(spark, sf_dir, "part")
    start = 10 * F.expr("p_partkey div 5")
    return p.select(F.concat(F.lit("chr"), (F.col("p_partkey") % 5).cast("string")).alias("chrom"), start.alias("start"), (start + 2 + F.col("p_size") % 8).alias("end"), F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("name"))


REGIONS = """regions AS (
  SELECT 'chr' || CAST(p_partkey % 5 AS VARCHAR) AS chrom, 10 * (p_partkey // 5) AS start, 10 * (p_partkey // 5) + 2 + p_size % 8 AS "end", 'r' || CAST(p_partkey AS VARCHAR) AS name
  FROM part)"""


def crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, start, end, name: regions of which some overlap and some touch."""
    p = table(spark, sf_dir, "part")
    start = 17 * F.expr("p_partkey div 5") + F.col("p_size") % 7
    return p.select(F.concat(F.lit("chr"), (F.col("p_partkey") % 5).cast("string")).alias("chrom"), start.alias("start"), (start + 3 + F.col("p_size") % 23).alias("end"), F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("name"))


CROSSING = """crossing AS (
  SELECT 'chr' || CAST(p_partkey % 5 AS VARCHAR) AS chrom, 17 * (p_partkey // 5) + p_size % 7 AS start, 17 * (p_partkey // 5) + p_size % 7 + 3 + p_size % 23 AS "end", 'x' || CAST(p_partkey AS VARCHAR) AS name
  FROM part)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom (a user), pos (a second), id, value: events as places on a line."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("chrom"), F.unix_timestamp("ts").alias("pos"), F.col("event_id").alias("id"), "value", "event_type")


STEPS = """steps AS (SELECT CAST(user_id AS VARCHAR) AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS pos, event_id AS id, value, event_type FROM events)"""


_FROM = "abcdefghijklmnopqrstuvwxyz"
_BASES, _STATES = "ACGTACGTACGTACGTACGTACGTAC", "CTCTCTCTNTCTCTCTCTCTCTCTCT"


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read, seq: whole texts as bases, by their letters."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("read"), F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _FROM, _BASES).alias("seq")).where("seq <> ''")


BASES = f"""bases AS (SELECT doc_id AS read, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_FROM}', '{_BASES}') AS seq
  FROM documents WHERE regexp_replace(lower(text), '[^a-z]', '', 'g') <> '')"""


def epireads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, cpg, states: whole texts as strings over C, T and N from a CpG ordinal on."""
    d = table(spark, sf_dir, "documents")
    states = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _FROM, _STATES)
    return d.select(F.concat(F.lit("chr"), (F.col("doc_id") % 3).cast("string")).alias("chrom"), (F.col("doc_id") * 7 % 199).alias("cpg"), states.alias("states")).where("states <> ''")


EPIREADS = f"""epireads AS (SELECT 'chr' || CAST(doc_id % 3 AS VARCHAR) AS chrom, doc_id * 7 % 199 AS cpg, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_FROM}', '{_STATES}') AS states
  FROM documents WHERE regexp_replace(lower(text), '[^a-z]', '', 'g') <> '')"""


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, seq: each text is a chromosome."""
    return bases(spark, sf_dir).select(F.concat(F.lit("g"), F.col("read").cast("string")).alias("chrom"), "seq")


GENOME = BASES + """, genome AS (SELECT 'g' || CAST(read AS VARCHAR) AS chrom, seq FROM bases)"""


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read, chrom, start, strand, seq: each text as a read on its own chromosome, up to 4 bases further on."""
    return bases(spark, sf_dir).select("read", F.concat(F.lit("g"), F.col("read").cast("string")).alias("chrom"), (F.col("read") % 5).alias("start"), F.when(F.col("read") % 2 == 0, "+").otherwise("-").alias("strand"), "seq")


ALIGNED = GENOME + """, aligned AS (SELECT read, 'g' || CAST(read AS VARCHAR) AS chrom, read % 5 AS start, CASE WHEN read % 2 = 0 THEN '+' ELSE '-' END AS strand, seq FROM bases)"""
