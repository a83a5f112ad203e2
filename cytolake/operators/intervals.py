"""Interval joins and interval algebra over (chrom, start, end), half-open.

Joins always have an equality: the chromosome and a position bucket, into which the longer side is exploded. So they
hash or sort-merge, and Spark can broadcast a side it finds small or split a skewed one. Nothing here is a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import settled

BUCKET = 1 << 14


def _spread(df: DataFrame, start: str, end: str, size: int) -> DataFrame:
    """A row for each bucket that a region touches."""
    last = F.greatest(F.col(start), F.col(end) - 1)
    return df.withColumn("__b", F.explode(F.sequence(F.expr(f"`{start}` div {size}"), F.floor(last / size))))


def points_in(points: DataFrame, regions: DataFrame, how: str = "inner", bucket: int = BUCKET) -> DataFrame:
    """Rows of points (chrom, pos) with the regions (chrom, start, end, others) that hold them: start <= pos < end, strand ignored.

    how: inner, left_semi (points in any region) or left_anti. A point has one bucket, so no pair comes twice.
    """
    r = _spread(regions, "start", "end", bucket).withColumnRenamed("chrom", "__chrom")
    p = points.withColumn("__pb", F.expr(f"pos div {bucket}"))
    on = (F.col("chrom") == F.col("__chrom")) & (F.col("__pb") == F.col("__b")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    out = p.join(r, on, how).drop("__pb")
    return out.drop("__chrom", "__b") if how == "inner" else out


def overlaps(a: DataFrame, b: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs of overlapping regions: chrom, a_start, a_end, b_start, b_end and the other columns with a_ or b_ before them."""
    def side(df, x):
        return df.select("chrom", *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c != "chrom"])

    left, right = _spread(side(a, "a"), "a_start", "a_end", bucket), _spread(side(b, "b"), "b_start", "b_end", bucket)
    pairs = left.join(right, ["chrom", "__b"]).where("a_start < b_end and b_start < a_end")
    return pairs.where(F.col("__b") == F.expr(f"greatest(a_start, b_start) div {bucket}")).drop("__b")


def clustered(items: DataFrame, regions: DataFrame) -> DataFrame:
    """Items (chrom, start, end, others) with the region that they are of: adds region_start, region_end, region (its name).

    Of several regions that an item overlaps, that is the first by start, end and name. Items in no region are left out; equal items each stay.
    """
    own = items.columns
    counted = items.groupBy(*own).agg(F.count(F.lit(1)).alias("__copies"))
    pairs = overlaps(counted, regions.select("chrom", "start", "end", "name"))
    keys = ["chrom", *[f"a_{c}" for c in own if c != "chrom"]]
    first = pairs.groupBy(*keys, "a___copies").agg(F.min(F.struct("b_start", "b_end", "b_name")).alias("r"))
    named = [F.col("chrom") if c == "chrom" else F.col(f"a_{c}").alias(c) for c in own]
    each = first.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("a___copies"))))
    return each.select(*named, F.col("r.b_start").alias("region_start"), F.col("r.b_end").alias("region_end"), F.col("r.b_name").alias("region"))


def adjusted_regions(regions: DataFrame, members: DataFrame) -> DataFrame:
    """Regions (chrom, start, end, name) with their ends moved out to those of their members by clustered(), and n, how many they have. Regions without stay as they are."""
    keys = ["chrom", "start", "end", "name"]
    ends = members.groupBy("chrom", F.col("region_start").alias("start"), F.col("region_end").alias("end"), F.col("region").alias("name")).agg(F.min("start").alias("__low"), F.max("end").alias("__high"), F.count(F.lit(1)).alias("n"))
    met = regions.select(*keys).join(ends, keys, "left")
    return met.select("chrom", F.least("start", "__low").alias("start"), F.greatest("end", "__high").alias("end"), "name", F.coalesce("n", F.lit(0)).alias("n"))


# -- in order along a chromosome, in blocks -------------------------------------------------------------------
# What runs along a whole chromosome is done within blocks of positions and then over the blocks, of which there are few,
# so that no task sorts a chromosome.


def blocked(rows: DataFrame, at: str = "pos", size: int = BUCKET) -> DataFrame:
    """Adds __b, the block of positions that a row is in."""
    return rows.withColumn("__b", F.expr(f"`{at}` div {size}"))


def _before(rows: DataFrame, keys: tuple, agg: Column, over) -> DataFrame:
    """keys, __b and __before: what the blocks before hold, by `agg` within a block and `over` of its results."""
    w = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(*keys, "__b").agg(agg.alias("__of")).select(*keys, "__b", over(F.col("__of")).over(w).alias("__before"))


def _windows(keys: tuple, order: tuple):
    w = Window.partitionBy(*keys, "__b").orderBy(*order)
    return w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)


def running_sum(rows: DataFrame, value: Column, into: str, keys: tuple = ("chrom",), order: tuple = ("pos",)) -> DataFrame:
    """Adds the sum of a value up to and with this row. rows: blocked()."""
    r = rows.withColumn("__v", value)
    upto, _ = _windows(keys, order)
    met = r.join(_before(r, keys, F.sum("__v"), F.sum), [*keys, "__b"])
    return met.withColumn(into, F.coalesce("__before", F.lit(0)) + F.sum("__v").over(upto)).drop("__v", "__before")


def running_max(rows: DataFrame, value: str, into: str, keys: tuple = ("chrom",), order: tuple = ("pos",)) -> DataFrame:
    """Adds the greatest value of the rows before this one; null for the first. rows: blocked()."""
    _, below = _windows(keys, order)
    met = rows.join(_before(rows, keys, F.max(value), F.max), [*keys, "__b"])
    return met.withColumn(into, F.greatest("__before", F.max(value).over(below))).drop("__before")


def neighbour(rows: DataFrame, value: str, into: str, ahead: bool = False, keys: tuple = ("chrom",), order: tuple = ("pos",)) -> DataFrame:
    """Adds the value of the row before this one, or of the one after; null at the end. rows: blocked()."""
    w = Window.partitionBy(*keys, "__b").orderBy(*order)
    blocks = Window.partitionBy(*keys).orderBy("__b")
    edge = F.min_by(value, F.struct(*order)) if ahead else F.max_by(value, F.struct(*order))
    shift = F.lead if ahead else F.lag
    edges = rows.groupBy(*keys, "__b").agg(edge.alias("__of")).select(*keys, "__b", shift("__of").over(blocks).alias("__near"))
    return rows.join(edges, [*keys, "__b"]).withColumn(into, F.coalesce(shift(value).over(w), F.col("__near"))).drop("__near")


def haloed(rows: DataFrame, reach: int, at: str = "pos", size: int | None = None) -> DataFrame:
    """Each row in every block that its reach touches: adds __b, and __own in the block that the row itself is in. For windows by range within (chrom, __b)."""
    size = size or max(BUCKET, 16 * reach)
    spread = F.sequence(F.expr(f"greatest(0, `{at}` - {reach}) div {size}"), F.expr(f"(`{at}` + {reach}) div {size}"))
    return rows.withColumn("__b", F.explode(spread)).withColumn("__own", F.col("__b") == F.expr(f"`{at}` div {size}"))


def union(regions: DataFrame) -> DataFrame:
    """Regions that overlap or touch become one: chrom, start, end, n."""
    order = ("start", "end")
    seen = settled(running_max(blocked(settled(regions.select("chrom", "start", "end"), "regions"), "start"), "end", "before", order=order))
    numbered = running_sum(seen, F.coalesce((F.col("start") > F.col("before")).cast("int"), F.lit(1)), "k", order=order)
    return numbered.groupBy("chrom", "k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("k")


def merge_near(regions: DataFrame, gap: int, names: bool = False) -> DataFrame:
    """Disjoint regions at most `gap` apart become one, with the least score: chrom, start, end, score, n; with names, name: theirs one after the other."""
    seen = running_max(blocked(regions, "start"), "end", "before", order=("start",))
    new = F.coalesce((F.col("start") - F.col("before") > gap).cast("int"), F.lit(1))
    name = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "name"))), lambda x: x["name"]), "").alias("name")] if names else []
    return running_sum(seen, new, "k", order=("start",)).groupBy("chrom", "k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("score").alias("score"), F.count(F.lit(1)).alias("n"), *name).drop("k")


def disjoint(regions: DataFrame) -> DataFrame:
    """The regions; one that overlaps another of its chromosome, or ends before it begins, fails. What touches is apart."""
    from .sites import checked

    seen = running_max(blocked(regions, "start"), "end", "__before", order=("start", "end"))
    return checked(seen, (F.col("start") < F.col("__before")) | (F.col("end") < F.col("start")), "regions overlap").drop("__b", "__before")


def complement(regions: DataFrame, ends: DataFrame) -> DataFrame:
    """What the regions leave of [0, end) of each chromosome of ends (chrom, end), also of those without a region."""
    merged = settled(union(regions).select("chrom", "start", "end"), "union")
    rows = merged.unionByName(ends.select("chrom", F.col("end").alias("start"), F.col("end")))
    seen = running_max(blocked(rows, "start"), "end", "before", order=("start", "end"))
    return seen.withColumn("gap", F.coalesce("before", F.lit(0))).where("gap < start").select("chrom", F.col("gap").alias("start"), F.col("start").alias("end"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stretches that are in both, of disjoint regions each."""
    return overlaps(a.select("chrom", "start", "end"), b.select("chrom", "start", "end")).select("chrom", F.greatest("a_start", "b_start").alias("start"), F.least("a_end", "b_end").alias("end"))


def difference(a: DataFrame, b: DataFrame, compat: bool = False) -> DataFrame:
    """What is in a and not in b. With compat, chromosomes without a region of b give nothing."""
    ends = a.select("chrom", "end").unionByName(b.select("chrom", "end")).groupBy("chrom").agg((F.max("end") + 1).alias("end"))
    rest = complement(b, ends)
    if compat:
        rest = rest.join(b.select("chrom").distinct(), "chrom", "left_semi")
    return intersect(union(a).select("chrom", "start", "end"), rest)


def fragments(regions: DataFrame) -> DataFrame:
    """The stretches between neighbouring region borders that lie in some region: chrom, start, end, depth."""
    events = regions.select("chrom", F.col("start").alias("at"), F.lit(1).alias("d")).unionByName(regions.select("chrom", F.col("end").alias("at"), F.lit(-1).alias("d")))
    steps = blocked(events.groupBy("chrom", "at").agg(F.sum("d").alias("d")), "at")
    swept = neighbour(running_sum(steps, F.col("d"), "depth", order=("at",)), "at", "end", True, order=("at",))
    return swept.where("depth > 0").select("chrom", F.col("at").alias("start"), "end", "depth")


def segment_by_gap(rows: DataFrame, gap: int, keys: tuple = ("chrom",), at: str = "pos") -> DataFrame:
    """Adds segment (1, 2, ... within the keys): a new one begins after a step of more than `gap`. Rows at one place are of one segment."""
    placed = blocked(rows.select(*keys, at).distinct(), at)
    before = neighbour(placed, at, "__last", keys=keys, order=(at,))
    new = F.coalesce((F.col(at) - F.col("__last") > gap).cast("int"), F.lit(1))
    numbered = running_sum(before, new, "segment", keys, (at,)).select(*keys, at, "segment")
    return rows.join(numbered, [*keys, at]).select(*rows.columns, "segment")


def islands(rows: DataFrame, inside: Column, keys: tuple = ("chrom",), at: str = "pos") -> DataFrame:
    """The rows where the condition holds, with island: a number per run of neighbouring such rows within the keys."""
    marked = blocked(rows.withColumn("__in", F.coalesce(inside, F.lit(False))), at)
    return running_sum(marked, (~F.col("__in")).cast("int"), "island", keys, (at,)).where("__in").drop("__in", "__b")


def domains(rows: DataFrame, inside: Column, keys: tuple = ("chrom", "segment"), score: Column | None = None) -> DataFrame:
    """Runs within segments: the keys, start of the first, end after the last, n, score (n unless given)."""
    run = islands(rows, inside, keys)
    return run.groupBy(*keys, "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count(F.lit(1)).alias("n"), F.sum(F.lit(1.0) if score is None else score).alias("score")).drop("island")
