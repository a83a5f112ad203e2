"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, scratch, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node that an edge (a, b: long) touches; root is the smallest node that is reachable.

    Only counts and a checksum reach the driver. Each step groups with partial aggregation and joins on the node, so a
    node with very many edges is dealt out by Spark's skewed joins; each step's edges are a table in the shared folder.
    Loops are nodes of their own. No edges give no rows. Rows with a null on either side are left out.
    """
    spark = edges.sparkSession
    root = scratch(spark, "components")
    nodes = edges.where("a is not null and b is not null").select(F.explode(F.array("a", "b")).alias("node"))
    own = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(own, f"{root}/0")
    before, k = None, 0
    while (state := _state(now)) != before:
        before, k = state, k + 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = written(small, f"{root}/{k}")
        dropped(f"{root}/{k - 1}")
    return nodes.distinct().join(now, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("root"))
