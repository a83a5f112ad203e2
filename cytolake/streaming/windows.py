"""Structured Streaming equivalents: pileups that grow with the reads, and deserts as session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_counts(reads: DataFrame) -> DataFrame:
    """Running counts per site of a stream of read bases (chrom, pos, strand, base); use with output mode complete or update."""
    n = lambda b: F.sum(F.when(F.col("base").isin(*b), 1).otherwise(0))
    return reads.groupBy("chrom", "pos", "strand").agg(n("CT").alias("n_reads"), n("C").alias("n_meth"))


def sessions(events: DataFrame, gap: str = "1 day", late: str = "1 day", key: str = "user_id") -> DataFrame:
    """Segments of a stream of events (key, ts) that are apart by less than the gap: key, start, end, n. Rows later than `late` are dropped by the watermark."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling_levels(sites: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Levels of a stream of observations (ts, chrom, n_reads, n_meth) in windows of time."""
    g = sites.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "chrom").agg(F.sum("n_reads").alias("n_reads"), F.sum("n_meth").alias("n_meth"))
    return g.select("chrom", F.col("w.start").alias("start"), "n_reads", "n_meth", F.try_divide(F.col("n_meth").cast("double"), "n_reads").alias("level"))
