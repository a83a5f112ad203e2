"""Operators on methylation sites: chrom, pos, strand, context, n_reads, n_meth (bigint counts; the level is their ratio)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, wilson
from .intervals import blocked, haloed, neighbour, points_in, running_sum, union

#: The level of `levels` and `roi_stats`; with 0.95 the interval is narrow, as the reference's default has it.
ALPHA = 0.95


def symmetric(sites: DataFrame, mutated: bool = True) -> DataFrame:
    """Mates, a + site and the - site right after it, as one: chrom, pos, context, n_reads, n_meth, paired.

    A site without a mate stays as it is. With mutated=False, sites whose context ends in x are left out afterwards.
    """
    w = Window.partitionBy("chrom", "__b").orderBy("pos", "strand")
    mate = lambda c, f: f(c).over(w)
    after = (F.col("strand") == "+") & (mate("strand", F.lead) == "-") & (mate("pos", F.lead) == F.col("pos") + 1)
    before = (F.col("strand") == "-") & (mate("strand", F.lag) == "+") & (mate("pos", F.lag) == F.col("pos") - 1)
    plus = lambda c: F.col(c) + F.when(F.col("after"), F.col(f"next_{c}")).otherwise(0)
    rows = haloed(sites, 2).withColumns({"after": F.coalesce(after, F.lit(False)), "before": F.coalesce(before, F.lit(False)), "next_n_reads": mate("n_reads", F.lead), "next_n_meth": mate("n_meth", F.lead), "next_context": mate("context", F.lead)})
    other = F.when(F.col("after") & F.col("next_context").endswith("x") & ~F.col("context").endswith("x"), F.concat("context", F.lit("x"))).otherwise(F.col("context"))
    out = rows.where("__own and not before").select("chrom", "pos", other.alias("context"), plus("n_reads").alias("n_reads"), plus("n_meth").alias("n_meth"), F.col("after").alias("paired"))
    return out if mutated else out.where(~F.col("context").endswith("x"))


def levels(sites: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row per context and one for all of them (context = cytosines)."""
    low, high = wilson("n_meth", "n_reads", alpha)
    covered = F.col("n_reads") > 0
    level = ratio("n_meth", "n_reads")
    base = sites.select(F.substring("context", 1, 3).alias("context"), "n_reads", "n_meth", F.col("context").endswith("x").alias("mut"), level.alias("level"), (low > 0.5).alias("up"), (high < 0.5).alias("down"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    aggs = [
        F.count(F.lit(1)).alias("total_sites"), count(covered).alias("sites_covered"), F.max("n_reads").alias("max_depth"), count(F.col("mut")).alias("mutations"),
        F.sum("n_meth").alias("total_c"), F.sum(F.col("n_reads") - F.col("n_meth")).alias("total_t"), F.sum("level").alias("sum_level"), count(F.col("up")).alias("called_meth"), count(F.col("down")).alias("called_unmeth"),
    ]
    out = base.groupingSets([["context"], []], "context").agg(*aggs)
    coverage = F.col("total_c") + F.col("total_t")
    return out.select(
        F.coalesce("context", F.lit("cytosines")).alias("context"), "total_sites", "sites_covered", "max_depth", "mutations", "total_c", "total_t", coverage.alias("coverage"), "called_meth", "called_unmeth",
        ratio(coverage, "total_sites").alias("mean_depth"), ratio(coverage, "sites_covered").alias("mean_depth_covered"), ratio("sum_level", "sites_covered").alias("mean_meth"),
        ratio("total_c", coverage).alias("mean_meth_weighted"), ratio("called_meth", F.col("called_meth") + F.col("called_unmeth")).alias("fractional_meth"),
    )


def roi_stats(sites: DataFrame, regions: DataFrame, all_regions: bool = False, alpha: float = ALPHA) -> DataFrame:
    """Per region: name, n_sites, n_covered, n_meth, n_reads, called_meth, called_unmeth, level (null without reads).

    Regions without reads are left out unless all_regions is set.
    """
    low, high = wilson("n_meth", "n_reads", alpha)
    hits = points_in(sites.select("chrom", "pos", "n_reads", "n_meth"), regions)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    keys = ["chrom", "start", "end", "name"]
    found = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sites"), count(F.col("n_reads") > 0).alias("n_covered"), F.sum("n_meth").alias("n_meth"), F.sum("n_reads").alias("n_reads"), count(low > 0.5).alias("called_meth"), count(high < 0.5).alias("called_unmeth"))
    if all_regions:
        found = regions.select(*keys).join(found, keys, "left").fillna(0)
    else:
        found = found.where("n_reads > 0")
    return found.withColumn("level", ratio("n_meth", "n_reads"))


def select_sites(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """Sites in any of the regions; each once, however many hold it."""
    return points_in(sites, union(regions).select("chrom", "start", "end"), "left_semi")


def merge_sum(samples: DataFrame) -> DataFrame:
    """Sites of several samples added up."""
    return samples.groupBy("chrom", "pos", "strand", "context").agg(F.sum("n_reads").alias("n_reads"), F.sum("n_meth").alias("n_meth"))


def merge_table(samples: DataFrame, names: list[int]) -> DataFrame:
    """A row for each site, with reads and methylated reads of each sample; 0 where a sample lacks the site."""
    cell = lambda s, c: F.coalesce(F.sum(F.when(F.col("sample") == s, F.col(c))), F.lit(0))
    return samples.groupBy("chrom", "pos", "strand").agg(*[cell(s, c).alias(f"s{s}_{x}") for s in names for c, x in (("n_reads", "r"), ("n_meth", "m"))])


def merge_fraction(samples: DataFrame, names: list[int], min_reads: int = 1) -> DataFrame:
    """A row for each site, with each sample's level; null unless it has more than min_reads reads."""
    cell = lambda s: F.max(F.when((F.col("sample") == s) & (F.col("n_reads") > min_reads), ratio("n_meth", "n_reads")))
    return samples.groupBy("chrom", "pos", "strand").agg(*[cell(s).alias(f"s{s}") for s in names])


def outer_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tracks (chrom, start, value) side by side; 0 where one has nothing."""
    return a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), ["chrom", "start"], "full_outer").select("chrom", "start", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


def last_of(index: DataFrame, order: str = "line") -> DataFrame:
    """One row per place of a liftover index: the last that it lists."""
    return index.groupBy("chrom", "pos").agg(F.max_by(F.struct("to_chrom", "to_pos", "to_strand"), order).alias("to")).select("chrom", "pos", "to.*")


def liftover(sites: DataFrame, index: DataFrame, plus_strand: bool = False) -> DataFrame:
    """Sites at their places in another genome; with plus_strand, a site that lands on - is moved to its + mate."""
    out = sites.join(last_of(index), ["chrom", "pos"])
    flip = (F.col("to_strand") == "-") & F.lit(plus_strand)
    return out.select(F.col("to_chrom").alias("chrom"), (F.col("to_pos") - flip.cast("int")).alias("pos"), F.when(flip, "+").otherwise(F.col("to_strand")).alias("strand"), "context", "n_reads", "n_meth")


def unlifted(sites: DataFrame, index: DataFrame) -> DataFrame:
    return sites.join(index.select("chrom", "pos"), ["chrom", "pos"], "left_anti")


def lift_filter(sites: DataFrame, unique: bool = False) -> DataFrame:
    """Sites that were lifted to one place added up; with unique, such places are dropped altogether."""
    out = sites.groupBy("chrom", "pos", "strand").agg(F.min("context").alias("context"), F.sum("n_reads").alias("n_reads"), F.sum("n_meth").alias("n_meth"), F.count(F.lit(1)).alias("n"))
    return (out.where("n = 1") if unique else out).drop("n")


def bins(sites: DataFrame, size: int) -> DataFrame:
    """Counts in right-closed bins, of all bins from each chromosome's first with reads to its last: chrom, bin, start, end, n_reads, n_meth."""
    idx = F.greatest(F.lit(0), F.expr(f"(pos + {size - 1}) div {size}") - 1)
    some = sites.groupBy("chrom", idx.alias("bin")).agg(F.sum("n_reads").alias("n_reads"), F.sum("n_meth").alias("n_meth"))
    ends = some.groupBy("chrom").agg(F.min(F.when(F.col("n_reads") > 0, F.col("bin"))).alias("lo"), F.max("bin").alias("hi"))
    dense = ends.where("lo is not null").select("chrom", F.explode(F.sequence("lo", "hi")).alias("bin"))
    out = dense.join(some, ["chrom", "bin"], "left").fillna(0, ["n_reads", "n_meth"])
    return out.withColumns({"start": F.col("bin") * size, "end": (F.col("bin") + 1) * size})


def reads_for_interval(conf: float = 0.8, alpha: float = 0.05) -> int:
    """Reads from which a Wilson interval at level one half is at most 1 - conf wide."""
    from ..functions.columns import z_of

    z, n = z_of(alpha), 1
    while 2 * z * (0.25 / n + z * z / (4 * n * n)) ** 0.5 / (1 + z * z / n) > 1 - conf:
        n += 1
    return n


def bin_size_pass(sites: DataFrame, sizes: list[int], need: int) -> DataFrame:
    """Per candidate size: n_covered bins, n_pass of them with at least `need` reads, and their share; one pass over the sites."""
    idx = F.greatest(F.lit(0), F.expr("(pos + size - 1) div size") - 1)
    each = sites.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).groupBy("size", "chrom", idx.alias("bin")).agg(F.sum("n_reads").alias("n_reads")).where("n_reads > 0")
    out = each.groupBy("size").agg(F.count(F.lit(1)).alias("n_covered"), F.sum(F.when(F.col("n_reads") >= need, 1).otherwise(0)).alias("n_pass"))
    return out.select(F.col("size").cast("bigint").alias("size"), "n_covered", "n_pass", ratio("n_pass", "n_covered").alias("share"))


def unique_names(features: DataFrame, name: str = "name") -> DataFrame:
    """The features; one whose name another has too fails, and so does one without a name."""
    times = F.count(F.lit(1)).over(Window.partitionBy(name))
    bad = (F.col("__times") > 1) | F.col(name).isNull()
    return checked(features.withColumn("__times", times), bad, "features need names of their own").drop("__times")


def even_widths(rows: DataFrame, keys: tuple = ("sample",), item: str = "probe") -> DataFrame:
    """A long table (keys, item, value); fails where a row of the matrix has another number of items than the widest one, or an item twice."""
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(item).alias("kinds"))
    most = F.max("n").over(Window.partitionBy())
    good = checked(per.withColumn("__most", most), (F.col("n") != F.col("kinds")) | (F.col("n") != F.col("__most")), "rows differ in width")
    return rows.join(good.select(*keys), list(keys))


def probe_means(probes: DataFrame, features: DataFrame) -> DataFrame:
    """Mean value per sample and feature of the probes in it: sample, name, n_probes, mean. probes: sample, chrom, pos, value."""
    return points_in(probes, features).groupBy("sample", "name").agg(F.count(F.lit(1)).alias("n_probes"), F.avg("value").alias("mean"))


def smoothed(sites: DataFrame, bandwidth: int) -> DataFrame:
    """Adds smooth: the level around each site, weighted by reads and by an Epanechnikov kernel in distance.

    The weighted sums come from sums of counts, of counts times the distance from the block's start, and of counts times its square, so no list of neighbours is made.
    """
    size = max(1 << 14, 16 * bandwidth)
    rows = haloed(sites, bandwidth, size=size).withColumn("__x", (F.col("pos") - F.col("__b") * size).cast("double"))
    w = Window.partitionBy("chrom", "__b").orderBy("pos").rangeBetween(-bandwidth, bandwidth)
    x, width = F.col("__x"), (bandwidth + 1) ** 2

    def total(c):
        n = F.col(c).cast("double")
        s0, s1, s2 = F.sum(n).over(w), F.sum(n * x).over(w), F.sum(n * x * x).over(w)
        return s0 * width - (s2 - 2 * x * s1 + x * x * s0)

    return rows.withColumn("smooth", ratio(total("n_meth"), total("n_reads"))).where("__own").select(*sites.columns, "smooth")


def local_linear(sites: DataFrame, bandwidth: int) -> DataFrame:
    """Adds smooth: at each site a line fitted to the levels of the sites within the bandwidth, each weighted by its reads and by an Epanechnikov kernel, as its value there, within [0, 1]; the weighted mean where all weight is at one place."""
    rows = haloed(sites, bandwidth)
    near = F.collect_list(F.struct("pos", "n_reads", "n_meth")).over(Window.partitionBy("chrom", "__b").orderBy("pos").rangeBetween(-bandwidth, bandwidth))
    d = lambda x: (x["pos"] - F.col("pos")).cast("double")
    weight = lambda x: (1 - F.pow(d(x) / (bandwidth + 1), F.lit(2)))
    total = lambda f: F.aggregate("near", F.lit(0.0), lambda acc, x: acc + weight(x) * f(x))
    sums = rows.withColumn("near", near).where("__own").withColumns({"s0": total(lambda x: x["n_reads"]), "s1": total(lambda x: x["n_reads"] * d(x)), "s2": total(lambda x: x["n_reads"] * d(x) * d(x)), "t0": total(lambda x: x["n_meth"]), "t1": total(lambda x: x["n_meth"] * d(x))})
    under = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    line = (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / under
    value = F.when(F.abs(under) > 1e-9, F.least(F.lit(1.0), F.greatest(F.lit(0.0), line))).otherwise(ratio("t0", "s0"))
    return sums.withColumn("smooth", value).select(*sites.columns, "smooth")


def cumulative(sites: DataFrame) -> DataFrame:
    """Adds reads_upto and meth_upto: the counts of a chromosome's sites up to and with this one."""
    both = running_sum(running_sum(blocked(sites), F.col("n_reads"), "reads_upto"), F.col("n_meth"), "meth_upto")
    return both.drop("__b")


def distances(sites: DataFrame) -> DataFrame:
    """Adds gap: how far the site before is; null for a chromosome's first."""
    return neighbour(blocked(sites), "pos", "__last").withColumn("gap", F.col("pos") - F.col("__last")).drop("__b", "__last")


def paired(a: DataFrame, b: DataFrame, uncovered: bool = False) -> DataFrame:
    """Sites that both methylomes have: chrom, pos, meth_a, unmeth_a, meth_b, unmeth_b. Without reads on a side they count only with `uncovered`. A place that comes twice in one of them fails."""

    def side(df, x):
        once = df.groupBy("chrom", "pos").agg(F.sum("n_meth").alias(f"meth_{x}"), F.sum("n_reads").alias("n"), F.count(F.lit(1)).alias("k"))
        return checked(once, F.col("k") > 1, "a site comes twice").select("chrom", "pos", f"meth_{x}", (F.col("n") - F.col(f"meth_{x}")).alias(f"unmeth_{x}"))

    out = side(a, "a").join(side(b, "b"), ["chrom", "pos"])
    return out if uncovered else out.where("meth_a + unmeth_a > 0 and meth_b + unmeth_b > 0")


def methdiff_rows(rows: DataFrame) -> DataFrame:
    """line: a site's row of a methdiff table, of chrom, pos, strand, context, score and the four counts."""
    columns = ["chrom", "pos", "strand", "context", "score", "meth_a", "unmeth_a", "meth_b", "unmeth_b"]
    return rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("line"))


def lock_step(*replicates: DataFrame) -> DataFrame:
    """chrom, pos, reads, meth (arrays over the replicates). A site that some replicate lacks, or has twice, fails."""
    k = len(replicates)
    all_ = None
    for i, df in enumerate(replicates):
        df = df.select("chrom", "pos", F.lit(i).alias("i"), "n_reads", "n_meth")
        all_ = df if all_ is None else all_.unionByName(df)
    out = all_.groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("i", "n_reads", "n_meth"))).alias("x"), F.countDistinct("i").alias("kinds"))
    good = checked(out, (F.size("x") != k) | (F.col("kinds") != k), "inputs have different sites")
    return good.select("chrom", "pos", F.col("x.n_reads").alias("reads"), F.col("x.n_meth").alias("meth"))


def array_bins(sites: DataFrame, size: int) -> DataFrame:
    """Probes of an array (chrom, pos, meth) in right-closed bins: chrom, bin, n, level, the mean kept within [0.01, 0.99]."""
    idx = F.greatest(F.lit(0), F.expr(f"(pos + {size - 1}) div {size}") - 1)
    mean = F.avg("meth")
    return sites.groupBy("chrom", idx.alias("bin")).agg(F.count("meth").alias("n"), F.least(F.lit(0.99), F.greatest(F.lit(0.01), mean)).alias("level"))


def bin_size(sites: DataFrame, resolution: int = 500, most: int = 500_000, least: int = 1000, conf: float = 0.8, share: float = 0.8) -> DataFrame:
    """One row: size, the least multiple of the resolution, from `least` on, of which at least `share` of the bins with reads have enough of them; else `most`."""
    need = reads_for_interval(conf, 1 - conf)
    # counts in bins of the resolution are all that larger bins are made of: a group is a chromosome's length over the resolution
    idx = F.greatest(F.lit(0), F.expr(f"(pos + {resolution - 1}) div {resolution}") - 1)
    fine = sites.groupBy("chrom", idx.cast("long").alias("bin")).agg(F.sum("n_reads").cast("long").alias("n")).where("n > 0")
    times = [k // resolution for k in range(least, most, resolution)]
    if any(k % resolution for k in (least, most)):
        raise ValueError("sizes are multiples of the resolution")

    def tell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        order = np.argsort(t["bin"].to_numpy())
        bins_, n = t["bin"].to_numpy()[order], t["n"].to_numpy()[order]
        rows = []
        for k in times:
            wide = bins_ // k
            sums = np.add.reduceat(n, np.flatnonzero(np.append(True, wide[1:] != wide[:-1])))
            rows.append((k * resolution, len(sums), int((sums >= need).sum())))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["size", "covered", "passed"])

    passing = fine.groupBy("chrom").applyInArrow(tell, "size long, covered long, passed long").groupBy("size").agg(ratio(F.sum("passed"), F.sum("covered")).alias("share"))
    return passing.agg(F.coalesce(F.min(F.when(F.col("share") >= share, F.col("size"))), F.lit(most).cast("bigint")).alias("size"))


def roi_names(stats: DataFrame) -> DataFrame:
    """Rows of roi_stats() with name:sites:covered:methylated:reads as name, and the level as score."""
    parts = [F.col(c).cast("string") for c in ("name", "n_sites", "n_covered", "n_meth", "n_reads")]
    return stats.select("chrom", "start", "end", F.concat_ws(":", *parts).alias("name"), F.col("level").alias("score"))


def numbered_names(regions: DataFrame, prefix: str) -> DataFrame:
    """Adds name: the prefix and a number, 0, 1, ... in the order of chrom and start. Numbers come from counts per block, not from one sort."""
    r = blocked(regions, "start")
    counts = r.groupBy("chrom", "__b").agg(F.count(F.lit(1)).alias("n"))
    chroms = counts.groupBy("chrom").agg(F.sum("n").alias("n")).select("chrom", F.coalesce(F.sum("n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__chroms"))
    own = running_sum(r, F.lit(1), "__k", order=("start", "end")).join(chroms, "chrom")
    return own.withColumn("name", F.concat(F.lit(prefix), (F.col("__chroms") + F.col("__k") - 1).cast("string"))).drop("__b", "__k", "__chroms")


def chromosome_order(samples: list[DataFrame]) -> list[str]:
    """An order of the chromosomes that agrees with the order (columns chrom, at) that each sample has them in; fails if there is none.

    Only the list of chromosomes of each sample, a genome's few names, comes to the driver.
    """
    from graphlib import CycleError, TopologicalSorter

    graph = TopologicalSorter()
    for df in samples:
        names = [r[0] for r in df.groupBy("chrom").agg(F.min("at").alias("at")).orderBy("at", "chrom").collect()]
        for name in names:
            graph.add(name)
        for one, two in zip(names, names[1:]):
            graph.add(two, one)
    try:
        return list(graph.static_order())
    except CycleError as e:
        raise ValueError("the samples' orders of chromosomes do not agree") from e


def checked(sites: DataFrame, problem: Column, what: str) -> DataFrame:
    """The rows; reading one for which the condition holds raises an error."""
    guard = F.when(problem, F.raise_error(F.lit(what)).cast("boolean")).otherwise(F.lit(True))
    return sites.where(guard)
