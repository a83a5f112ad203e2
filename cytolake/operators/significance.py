"""Differences, significance and false discovery rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import kernels
from .intervals import haloed, points_in


def _distinct(f, *columns: pd.Series) -> pd.Series:
    """f of the distinct rows of counts, all at once, and so of all rows."""
    rows = np.stack([np.asarray(c, np.int64) for c in columns], axis=1)
    if not len(rows):
        return pd.Series([], dtype="float64")
    some, which = np.unique(rows, axis=0, return_inverse=True)
    return pd.Series(f(*some.T)[which.ravel()])


@F.pandas_udf(DoubleType())
def greater_probability(ma: pd.Series, ua: pd.Series, mb: pd.Series, ub: pd.Series) -> pd.Series:
    """P(level of A < level of B) of rows of counts, each at least 1."""
    return _distinct(kernels.greater_probability, ma, ua, mb, ub)


@F.pandas_udf(DoubleType())
def fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided exact test of 2 x 2 tables."""
    return _distinct(kernels.fisher_two_sided, a, b, c, d)


@F.pandas_udf(DoubleType())
def probit(p: pd.Series) -> pd.Series:
    return pd.Series(kernels.probit(p))


@F.pandas_udf(DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    return pd.Series(kernels.normal_sf(z))


@F.pandas_udf(DoubleType())
def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(kernels.chi2_sf(x, df))


@F.pandas_udf(DoubleType())
def betabin_logpmf(k: pd.Series, n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(kernels.lchoose(n, k) + kernels.lbeta(k + a, n - k + b) - kernels.lbeta(a, b))


def register(spark) -> None:
    """Makes the kernels callable from SQL, the bounds of the Wilson interval too (wilson_lo, wilson_hi of methylated reads, reads and z)."""
    for name, f in {"exact_pop_greater": greater_probability, "fisher_2x2": fisher, "probit": probit, "normal_sf": normal_upper, "chi2_sf": chi2_upper, "betabin_logpmf": betabin_logpmf}.items():
        spark.udf.register(name, f)
    for name, sign, cap in (("wilson_lo", "-", "greatest(0D, {})"), ("wilson_hi", "+", "least(1D, {})")):
        bound = f"try_divide(m / n + z * z / (2 * n) {sign} z * sqrt(m / n * (1 - m / n) / n + z * z / (4 * n * n)), 1 + z * z / n)"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(m DOUBLE, n DOUBLE, z DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN {cap.format(bound)} END")


def methdiff(rows: DataFrame, pseudo: int = 1) -> DataFrame:
    """Adds score = P(A > B) to rows (chrom, pos, meth_a, unmeth_a, meth_b, unmeth_b)."""
    c = lambda x: F.col(x) + pseudo
    return rows.withColumn("score", greater_probability(c("meth_b"), c("unmeth_b"), c("meth_a"), c("unmeth_a")))


def dmr_counts(regions: DataFrame, scores: DataFrame, cutoff: float = 0.05, lower: bool = True) -> DataFrame:
    """Per region: n_sites and n_sig of the scores in it; significant below the cutoff, or above one less it."""
    sig = F.col("score") < cutoff if lower else F.col("score") > 1 - cutoff
    keys = ["chrom", "start", "end"]
    found = points_in(scores.select("chrom", "pos", "score"), regions.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sites"), F.sum(F.when(sig, 1).otherwise(0)).alias("n_sig"))
    return regions.select(*keys).join(found, keys, "left").fillna(0, ["n_sites", "n_sig"])


def _ranks(rows: DataFrame, p: str) -> DataFrame:
    """Distinct values of p with n, their rows, rank, how many rows are no greater, and rows, all of them.

    Windows run over buckets of p and over the buckets' sums, not over all rows. Buckets are even in the logarithm, so that
    neither small nor large values crowd.
    """
    counts = rows.groupBy(p).agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.ceil(F.log(F.greatest(F.col(p), F.lit(1e-300))) * 64))
    sums = counts.groupBy("bucket").agg(F.sum("n").alias("total"))
    below = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("bucket", F.coalesce(F.sum("total").over(below), F.lit(0)).alias("before"), F.sum("total").over(Window.partitionBy()).alias("rows"))
    w = Window.partitionBy("bucket").orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(before, "bucket").select(p, "n", "bucket", "rows", (F.col("before") + F.sum("n").over(w)).alias("rank"))


def bh(rows: DataFrame, p: str = "p", into: str = "q") -> DataFrame:
    """Benjamini-Hochberg: the least p * n / rank of this and all greater p, 1 at most."""
    raw = _ranks(rows, p).withColumn("raw", F.least(F.lit(1.0), F.col(p) * F.col("rows") / F.col("rank")))
    later = raw.groupBy("bucket").agg(F.min("raw").alias("least"))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    after = later.select("bucket", F.coalesce(F.min("least").over(above), F.lit(1.0)).alias("after"))
    w = Window.partitionBy("bucket").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    done = raw.join(after, "bucket").select(p, F.least(F.min("raw").over(w), "after").alias(into))
    return rows.join(done, p)


def stepup_cutoff(rows: DataFrame, alpha: float, p: str = "p") -> DataFrame:
    """One row: the least p that is not below alpha * rank / n, or the greatest p if all are; null without rows. Only what is below the cutoff is significant."""
    if not 0 < alpha <= 1:
        raise ValueError("the cutoff must be in (0, 1]")
    failing = F.col(p) >= alpha * (F.col("rank") - F.col("n") + 1) / F.col("rows")
    return _ranks(rows, p).agg(F.coalesce(F.min(F.when(failing, F.col(p))), F.max(p)).alias("cutoff"))


def fdr_cutoff(rows: DataFrame, tests: int, alpha: float, p: str = "p") -> DataFrame:
    """One row: the greatest p that is below alpha * rank / tests, of rows of which `tests` were made; 0 if none is."""
    return _ranks(rows, p).agg(F.coalesce(F.max(F.when(F.col(p) < alpha * F.col("rank") / F.lit(tests), F.col(p))), F.lit(0.0)).alias("cutoff"))


def empirical_p(observed: DataFrame, null: DataFrame, score: str = "score") -> DataFrame:
    """Adds p: the share of null scores that are greater. Ranks come from the distinct values of both, in buckets."""
    both = observed.groupBy(score).agg(F.lit(0).cast("bigint").alias("n")).unionByName(null.groupBy(score).agg(F.count(F.lit(1)).alias("n"))).groupBy(score).agg(F.sum("n").alias("n"))
    part = both.withColumn("bucket", F.floor(score))
    sums = part.groupBy("bucket").agg(F.sum("n").alias("total"))
    above = sums.withColumn("above", F.coalesce(F.sum("total").over(Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    w = Window.partitionBy("bucket").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    done = part.withColumn("within", F.coalesce(F.sum("n").over(w), F.lit(0))).join(above, "bucket")
    n = max(1, null.count())
    return observed.hint("merge").join(done.select(score, ((F.col("above") + F.col("within")) / n).alias("p")).hint("merge"), score)


def distance_correlation(rows: DataFrame, value: Column, lo: int, hi: int, step: int) -> DataFrame:
    """Pearson correlation of values of neighbours on a chromosome, by bins of distance in [lo, hi): bin, n, corr (0 for one pair or none). Null values have no pairs.

    Blocks of positions with the band after them are one task's each; only sums for each bin leave it, no pairs. A site at its own place is its own neighbour where lo is 0.
    """
    size = max(1 << 12, 8 * hi)
    blocks = F.sequence(F.expr(f"greatest(0, pos - {hi - 1}) div {size}"), F.expr(f"pos div {size}"))
    near = rows.select("chrom", F.col("pos").cast("long").alias("pos"), value.cast("double").alias("v"), F.explode(blocks).alias("block")).where("v is not null")
    names = ["bin", "n", "sx", "sy", "sxx", "syy", "sxy"]

    def sums(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))  # sites of a block and of the band after it
        order = np.argsort(t["pos"].to_numpy(), kind="stable")
        pos, v = t["pos"].to_numpy()[order], t["v"].to_numpy()[order]
        own = np.flatnonzero(pos // size == key[1].as_py())
        at, end = np.searchsorted(pos, pos[own] + lo), np.searchsorted(pos, pos[own] + hi)
        total = np.zeros((6, -(-(hi - lo) // step)))
        while len(own):
            some = at < end
            own, at, end = own[some], at[some], end[some]
            bins, x, y = (pos[at] - pos[own] - lo) // step, v[own], v[at]
            for k, w in enumerate((None, x, y, x * x, y * y, x * y)):
                total[k] += np.bincount(bins, w, total.shape[1])
            at = at + 1
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0][seen].astype(np.int64)), *map(pa.array, total[1:, seen])], names=names)

    found = near.groupBy("chrom", "block").applyInArrow(sums, "bin long, n long, sx double, sy double, sxx double, syy double, sxy double")
    agg = found.groupBy("bin").agg(*[F.sum(c).alias(c) for c in names[1:]])
    c = lambda s: F.col(s).cast("double")
    top = c("n") * c("sxy") - c("sx") * c("sy")
    under = (c("n") * c("sxx") - c("sx") * c("sx")) * (c("n") * c("syy") - c("sy") * c("sy"))
    return agg.select("bin", "n", F.coalesce(F.when((F.col("n") > 1) & (under > 0), top / F.sqrt(under)), F.lit(0.0)).alias("corr"))


def band_neighbours(rows: DataFrame, reach: int) -> DataFrame:
    """Adds n_near (rows within reach on either side, itself included) and near_sum of reads."""
    w = Window.partitionBy("chrom", "__b").orderBy("pos").rangeBetween(-reach, reach)
    near = haloed(rows, reach).withColumns({"n_near": F.count(F.lit(1)).over(w), "near_sum": F.sum("n_reads").over(w)})
    return near.where("__own").select(*rows.columns, "n_near", "near_sum")


def combined(rows: DataFrame, correlations: DataFrame, reach: int, step: int) -> DataFrame:
    """Adds combined_p to rows (chrom, pos, p): Stouffer-Liptak over the loci within reach, with correlations (bin, corr) by distance.

    Blocks of positions with the reach on either side are one task's each; sums over pairs come from running sums of each lag, no pairs are listed.
    """
    table = {r["bin"]: r["corr"] for r in correlations.collect()}  # one row for each distance bin
    tau = np.array([float(table.get(k, 0.0)) for k in range(reach // step + 1)])
    tested = haloed(rows.where("p >= 0").withColumn("__z", probit(1 - F.col("p"))), reach)
    own = rows.columns
    kinds = {f.name: f for f in tested.schema.fields}

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        t = t.take(pa.array(np.argsort(t["pos"].to_numpy(), kind="stable")))
        pos, z = t["pos"].to_numpy().astype(np.int64), t["__z"].to_numpy()
        mine = np.flatnonzero(t["__own"].to_numpy())
        low, high = np.searchsorted(pos, pos[mine] - reach), np.searchsorted(pos, pos[mine] + reach, side="right")
        upto = np.append(0.0, np.cumsum(z))
        rho, lag = (high - low).astype(float), 1  # each with itself
        while lag < len(pos):
            d = pos[lag:] - pos[:-lag]
            near = d <= reach
            if not near.any():
                break
            sums = np.append(0.0, np.cumsum(np.where(near, tau[np.minimum(d // step, len(tau) - 1)], 0.0)))
            begin = np.minimum(low, len(pos) - lag)
            rho += 2 * (sums[np.maximum(begin, high - lag)] - sums[begin])
            lag += 1
        out = t.select(own).take(pa.array(mine))
        score = kernels.normal_sf((upto[high] - upto[low]) / np.sqrt(np.maximum(rho, 1e-9)))
        yield from out.append_column("combined_p", pa.array(score)).combine_chunks().to_batches()

    schema = StructType([kinds[c] for c in own] + [StructField("combined_p", DoubleType())])
    return tested.groupBy("chrom", "__b").applyInArrow(work, schema)


def adjusted(rows: DataFrame, correlations: DataFrame, reach: int, step: int) -> DataFrame:
    """Adds combined_p and its q to all rows (chrom, pos, p); both are null where p is outside [0, 1], of untested rows."""
    tested = bh(combined(rows.where("p between 0 and 1").select("chrom", "pos", "p"), correlations, reach, step), "combined_p")
    return rows.join(tested.select("chrom", "pos", "combined_p", "q"), ["chrom", "pos"], "left")


def significant_islands(rows: DataFrame, cutoff: float) -> DataFrame:
    """Runs of neighbouring rows (chrom, pos, p, q, cov_a, meth_a, cov_b, meth_b) with 0 <= q < cutoff that hold some p < cutoff: chrom, start, end, n, n_sig, diff."""
    from .intervals import islands

    run = islands(rows, (F.col("q") >= 0) & (F.col("q") < cutoff))
    out = run.groupBy("chrom", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("p") < cutoff, 1).otherwise(0)).alias("n_sig"), F.sum("cov_a").alias("ca"), F.sum("meth_a").alias("ma"), F.sum("cov_b").alias("cb"), F.sum("meth_b").alias("mb"))
    return out.where("n_sig > 0").select("chrom", "start", "end", "n", "n_sig", (F.try_divide(F.col("ma").cast("double"), "ca") - F.try_divide(F.col("mb").cast("double"), "cb")).alias("diff"))
