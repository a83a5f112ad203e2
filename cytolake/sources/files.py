"""Readers and writers of the text formats, as DataFrames. Plain or gzip by extension; bad rows fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges
from .ranges import approximate_lines, chromosome_sizes, genome_chunks, read_genome  # noqa: F401

SITES = "chrom string, pos bigint, strand string, context string, meth double, n_reads bigint"
REGIONS = "chrom string, start bigint, end bigint, name string, score double, strand string"
EPIREADS = "chrom string, cpg bigint, states string"
METHDIFF = "chrom string, pos bigint, strand string, context string, score double, meth_a bigint, unmeth_a bigint, meth_b bigint, unmeth_b bigint"
LIFTOVER = "chrom string, pos bigint, to_chrom string, to_pos bigint, to_strand string"
BEDGRAPH = "chrom string, start bigint, end bigint, value double"
SAM = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def _tabs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, mode="FAILFAST", comment="#")


def _good_sites(t: DataFrame) -> DataFrame:
    """The sites; one with a level outside [0, 1], a strand but + and -, or a context that is none of the four, with or without x, fails."""
    good = F.col("strand").isin("+", "-") & F.col("meth").between(0, 1) & F.col("context").rlike("^(CpG|CHH|CXG|CCG)x?$")
    return t.where(F.when(~F.coalesce(good, F.lit(False)), F.raise_error(F.concat(F.lit("bad site at "), F.coalesce("chrom", F.lit("?")), F.lit(":"), F.coalesce(F.col("pos").cast("string"), F.lit("?")))).cast("boolean")).otherwise(F.lit(True)))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Sites with counts: n_meth is the level times the reads, halves away from zero. Levels outside [0, 1], strands but + and - and unknown contexts fail."""
    t = _good_sites(_tabs(spark, path, SITES))
    return t.withColumn("n_meth", F.round(F.col("meth") * F.col("n_reads")).cast("bigint"))


def read_array_sites(spark: SparkSession, path: str) -> DataFrame:
    """Five columns, without reads: each site counts as one read."""
    return _tabs(spark, path, SITES.rsplit(",", 1)[0]).withColumn("n_reads", F.lit(1).cast("bigint"))


def read_legacy_sites(spark: SparkSession, path: str) -> DataFrame:
    """Six columns of regions with names like CpG:reads and the level as score; checked as read_sites() checks."""
    t = _tabs(spark, path, REGIONS)
    name = F.split("name", ":")
    return _good_sites(t.select("chrom", F.col("start").alias("pos"), "strand", name[0].alias("context"), F.col("score").alias("meth"), name[1].cast("bigint").alias("n_reads")))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return _tabs(spark, path, REGIONS)


def read_epireads(spark: SparkSession, path: str) -> DataFrame:
    return _tabs(spark, path, EPIREADS)


def read_methdiff(spark: SparkSession, path: str) -> DataFrame:
    return _tabs(spark, path, METHDIFF)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return _tabs(spark, path, BEDGRAPH)


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value: each file's lines with their numbers, whatever the partitioning. Files are read by ranges."""
    return ranges.numbered_lines(spark, path)


def read_liftover(spark: SparkSession, path: str) -> DataFrame:
    """With line, as the last of several rows for one place counts."""
    p = F.split("value", "\t")
    return numbered(spark, path).select(p[0].alias("chrom"), p[1].cast("bigint").alias("pos"), p[2].alias("to_chrom"), p[3].cast("bigint").alias("to_pos"), p[4].alias("to_strand"), "line")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """idx, name, seq, qual: records of four lines; the name ends at the first space; a record without @ fails. Files are read by ranges."""
    return ranges.fastq_records(spark, path).drop("file")


def read_fastq_pairs(spark: SparkSession, one: str, two: str, suffix: int = 1) -> DataFrame:
    """read, seq1, seq2 of records at the same place; names that differ before the suffix fail."""
    a, b = read_fastq(spark, one), read_fastq(spark, two)
    both = a.select("idx", F.col("name").alias("read"), F.col("seq").alias("seq1")).join(b.select("idx", F.col("name").alias("other"), F.col("seq").alias("seq2")), "idx")
    head = lambda c: F.expr(f"left({c}, greatest(0, length({c}) - {suffix}))")
    return both.where(F.when(head("read") != head("other"), F.raise_error(F.lit("mates' names differ")).cast("boolean")).otherwise(F.lit(True))).select("read", "seq1", "seq2")


def read_fasta(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """chrom, seq: whole sequences, for short ones; read_genome() has pieces of long ones. The name ends at the first space; names that come twice fail."""
    lines = genome_chunks(spark, path, suffix).groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("start", F.col("seq").cast("string").alias("s")))).alias("l"))
    return lines.select("chrom", F.array_join("l.s", "").alias("seq"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped reads of SAM text: read, chrom, start (0-based), strand, seq, cigar, tags; headers are left out."""
    p = F.split("value", "\t")
    t = spark.read.text(path).where(~F.col("value").startswith("@")).select(*[p[i].alias(c) for i, c in enumerate(SAM)], F.slice(p, F.lit(12), F.greatest(F.lit(0), F.size(p) - 11)).alias("tags"))
    flag = F.col("flag").cast("int")
    return t.where(flag.bitwiseAND(F.lit(4)) == 0).select(F.col("qname").alias("read"), F.col("rname").alias("chrom"), (F.col("pos").cast("bigint") - 1).alias("start"), F.when(flag.bitwiseAND(F.lit(16)) != 0, "-").otherwise("+").alias("strand"), "seq", "cigar", "tags")


def on_reference(reads: DataFrame) -> DataFrame:
    """Adds what the CIGAR makes of seq: inserted and clipped bases go, deleted and skipped ones are N."""
    ops = F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda o: F.struct(F.regexp_extract(o, r"^(\d+)", 1).cast("int").alias("n"), F.regexp_extract(o, r"([A-Z=])$", 1).alias("op")))
    done = F.aggregate(
        ops,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, o: F.when(o["op"].isin("M", "=", "X"), F.struct(F.concat(acc["out"], F.substr(F.col("seq"), acc["at"], o["n"])).alias("out"), (acc["at"] + o["n"]).alias("at")))
        .when(o["op"].isin("I", "S"), F.struct(acc["out"].alias("out"), (acc["at"] + o["n"]).alias("at")))
        .when(o["op"].isin("D", "N"), F.struct(F.concat(acc["out"], F.repeat(F.lit("N"), o["n"])).alias("out"), acc["at"].alias("at")))
        .otherwise(acc),
    )
    return reads.withColumn("seq", done["out"])


def read_proportions(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, strand, context, sample, n_reads, n_meth from a table with a header of sample names and (total, methylated) pairs."""
    lines = numbered(spark, path)
    p = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    names = lines.where("line = 0").select("file", p.alias("names"))
    rows = lines.where("line > 0").join(names, "file").select("names", p.alias("p"))
    key = F.split(F.col("p")[0], ":")
    cells = F.transform("names", lambda n, i: F.struct(n.alias("sample"), F.col("p")[2 * i + 1].cast("bigint").alias("n_reads"), F.col("p")[2 * i + 2].cast("bigint").alias("n_meth")))
    return rows.select(key[0].alias("chrom"), key[1].cast("bigint").alias("pos"), key[2].alias("strand"), key[3].alias("context"), F.explode(cells).alias("c")).select("chrom", "pos", "strand", "context", "c.*")


def read_probe_matrix(spark: SparkSession, path: str) -> DataFrame:
    """sample, probe, value from a table whose header names the probes and whose rows begin with a sample."""
    lines = numbered(spark, path)
    p = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    names = lines.where("line = 0").select("file", p.alias("names"))
    rows = lines.where("line > 0").join(names, "file").select("names", p.alias("p"))
    cells = F.transform("names", lambda n, i: F.struct(n.alias("probe"), F.col("p")[i + 1].cast("double").alias("value")))
    return rows.select(F.col("p")[0].alias("sample"), F.explode(cells).alias("c")).select("sample", "c.*")


def read_conversion(spark: SparkSession, path: str) -> DataFrame:
    """The thirteen columns of a conversion table, after its four header lines."""
    names = "base ptot pconv prate ntot nconv nrate bthtot bthconv bthrate err all errrate".split()
    p = F.split("value", "\t")
    return numbered(spark, path).where("line > 3").select("file", *[p[i].cast("double" if n.endswith("rate") else "bigint").alias(n) for i, n in enumerate(names)])


def write_tabs(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", compression="gzip" if gzip else "none")
