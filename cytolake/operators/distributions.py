"""Tests of paired values and weighted fits of distributions, group by group.

Groups are summed up where their rows are: no group is collected. Ranks within a group go over buckets of its values and then over
the buckets' sums, so a group with most of the rows is many tasks' work.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..functions import kernels

_PAIR = StructType().add("a", DoubleType()).add("b", DoubleType())


def paired_tests(rows: DataFrame, keys: list[str], x: str, y: str, least: float = 1e-20) -> DataFrame:
    """Signed-rank and sign tests of x against y for each group: keys, n, n_greater, w_greater, w_less, p_greater, p_less, sign_greater, sign_less.

    n: pairs that differ by more than `least`; others, and those with a null or NaN, are left out. Ties have their ranks' mean. p_greater is
    small where x is the greater one. A group without such pairs has p-values of 1. The group's rows may be any number.
    """
    d = F.col(x).cast("double") - F.col(y).cast("double")
    # own columns begin with __, so that keys may have any name
    t = rows.select(*keys, F.when(~F.isnan(d), d).alias("__d"))
    groups = t.select(*keys).distinct()
    sizes = t.where(F.abs("__d") > least).groupBy(*keys, F.abs("__d").alias("__size")).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.when(F.col("__d") > 0, 1).otherwise(0)).alias("__up"))
    sizes = sizes.withColumn("__bucket", F.ceil(F.log2("__size") * 64))
    sums = sizes.groupBy(*keys, "__bucket").agg(F.sum("__n").alias("__held"))
    renamed = [F.col(k).alias(f"__key_{k}") for k in keys]
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    below = F.coalesce(F.sum("__held").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*renamed, F.col("__bucket").alias("__of"), below.alias("__below"))
    within = F.sum("__n").over(Window.partitionBy(*keys, "__bucket").orderBy("__size").rowsBetween(Window.unboundedPreceding, 0))
    # the mean rank of the tied pairs that end at place __end
    ranked = sizes.withColumn("__end", within).join(sums, same & (F.col("__bucket") == F.col("__of")))
    ranked = ranked.withColumn("__rank", F.col("__below") + F.col("__end") - (F.col("__n") - 1) / F.lit(2.0))
    up, n, rank = F.col("__up"), F.col("__n"), F.col("__rank")
    told = ranked.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(up).alias("n_greater"), F.sum(rank * up).alias("w_greater"), F.sum(rank * (n - up)).alias("w_less"))
    counts = ("n", "n_greater", "w_greater", "w_less")
    full = groups.join(told.select(*renamed, *counts), same, "left").select(*keys, *[F.coalesce(c, F.lit(0)).cast("double" if c[0] == "w" else "long").alias(c) for c in counts])
    less = F.col("n") - F.col("n_greater")
    return full.withColumns({"p_greater": _signed_rank("w_greater", "n"), "p_less": _signed_rank("w_less", "n"), "sign_greater": _sign("n_greater", "n"), "sign_less": _sign(less, "n")})


@F.pandas_udf(DoubleType())
def _signed_rank(w: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(kernels.signed_rank_upper(w, n))


@F.pandas_udf(DoubleType())
def _sign(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(kernels.sign_upper(k, n))


@F.pandas_udf(_PAIR)
def _gamma(gap: pd.Series, mean: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kernels.fit_gamma(g, m) if g == g else (None, None) for g, m in zip(gap, mean)], columns=["a", "b"], dtype="float64")


@F.pandas_udf(_PAIR)
def _beta(weight: pd.Series, p: pd.Series, q: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([kernels.fit_beta(w, a, b) if a == a and b == b else (None, None) for w, a, b in zip(weight, p, q)], columns=["a", "b"], dtype="float64")


@F.pandas_udf(DoubleType())
def _overdispersion(values: pd.Series, mean: pd.Series) -> pd.Series:
    rows = [[(v["v"], v["s"], v["w"]) for v in some] for some in values]
    return pd.Series([kernels.fit_overdispersion(*zip(*r), m) if m == m else None for r, m in zip(rows, mean)], dtype="float64")


#: The families and their parameters, in order.
FAMILIES = {
    "exponential": ("mean",),
    "poisson": ("mean",),
    "geometric": ("p",),
    "binomial": ("p",),
    "gamma": ("shape", "scale"),
    "beta": ("alpha", "beta"),
    "negative_binomial": ("mean", "overdispersion"),
}


def fit_family(rows: DataFrame, family: str, keys: list[str], value: str, weight: str | Column | None = None, scale: str | Column | None = None, trials: int | None = None) -> DataFrame:
    """Weighted maximum likelihood for each group: keys, total (weight), and the family's parameters.

    Rows whose value, weight or scale is null, or whose weight is not positive, do not count; a group without others has null parameters. scale is each row's
    exposure: counts have the mean times it, other values are divided by it. geometric counts from 1; binomial needs its trials. beta has no
    fit where a value is 0 or 1, nor gamma where one is 0 (null). gamma's shape is infinite where all values are equal.

    All families but one take sums only. negative_binomial takes a group's distinct pairs of value and scale, with their weights: counts and few scales.
    """
    if family not in FAMILIES:
        raise ValueError(f"no such family: {family}")
    if family == "binomial" and not trials:
        raise ValueError("a binomial fit needs the number of trials")
    counted = family in ("poisson", "negative_binomial")
    column = lambda c: F.lit(1.0) if c is None else (F.col(c) if isinstance(c, str) else c).cast("double")
    t = rows.select(*keys, F.col(value).cast("double").alias("v"), column(weight).alias("w"), column(scale).alias("s"))
    t = t.withColumn("v", F.col("v") if counted else F.col("v") / F.col("s"))
    known = F.col("v").isNotNull() & F.col("s").isNotNull() & (F.col("w") > 0)
    # equal rows are summed up first: counts come often
    t = t.groupBy(*keys, *[F.when(known, F.col(c)).alias(c) for c in ("v", "s")]).agg(F.sum(F.when(known, F.col("w"))).alias("w"))
    total, wx = F.sum("w"), F.sum(F.col("w") * F.col("v"))
    mean = wx / total
    log = lambda c: F.when(c > 0, F.log(c)).otherwise(F.lit(float("nan")))
    logs = F.sum(F.col("w") * log(F.col("v"))) / total
    if family in ("exponential", "poisson"):
        out = {"mean": wx / F.sum(F.col("w") * F.col("s")) if counted else mean}
    elif family == "geometric":
        out = {"p": total / wx}
    elif family == "binomial":
        out = {"p": mean / trials}
    elif family == "gamma":
        both = t.groupBy(*keys).agg(total.alias("total"), (F.log(mean) - logs).alias("gap"), mean.alias("m")).withColumn("f", _gamma("gap", "m"))
        return both.select(*keys, "total", F.col("f.a").alias("shape"), F.col("f.b").alias("scale"))
    elif family == "beta":
        other = F.sum(F.col("w") * log(1 - F.col("v")))
        both = t.groupBy(*keys).agg(total.alias("total"), F.sum(F.col("w") * log(F.col("v"))).alias("p"), other.alias("q")).withColumn("f", _beta("total", "p", "q"))
        return both.select(*keys, "total", F.col("f.a").alias("alpha"), F.col("f.b").alias("beta"))
    else:
        held = F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "s", "w")))
        both = t.groupBy(*keys).agg(total.alias("total"), (wx / F.sum(F.col("w") * F.col("s"))).alias("mean"), held.alias("held"))
        return both.select(*keys, "total", "mean", _overdispersion("held", "mean").alias("overdispersion"))
    return t.groupBy(*keys).agg(total.alias("total"), *[c.alias(n) for n, c in out.items()])
