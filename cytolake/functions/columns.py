"""Scalar expressions that stay inside Catalyst."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a, b) -> Column:
    """a / b as a double; null where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def z_of(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)


def wilson(n_meth, n_reads, alpha: float) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within [0, 1]; null without reads."""
    z = z_of(alpha)
    n = (F.col(n_reads) if isinstance(n_reads, str) else n_reads).cast("double")
    p = ratio(n_meth, n_reads)
    n = F.when(n > 0, n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    mid, scale = p + z * z / (2 * n), 1 + z * z / n
    return F.greatest(F.lit(0.0), (mid - half) / scale), F.least(F.lit(1.0), (mid + half) / scale)


def half_up(x) -> Column:
    """Rounded to an integer, halves away from zero."""
    return F.round(x).cast("bigint")


def fold(p: Column) -> Column:
    """Levels folded so that partial ones are low: 1 at both ends and 0 in the middle."""
    return F.when(p <= 0.5, 1 - 2 * p).otherwise(1 - 2 * (1 - p))


def flipped(states: Column) -> Column:
    """Swaps C and T where C is the minority."""
    c = F.length(states) - F.length(F.regexp_replace(states, "C", ""))
    return F.when(2 * c < F.length(states), F.translate(states, "CT", "TC")).otherwise(states)


def revcomp(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def base_count(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def protocol(t_rich: Column) -> Column:
    """Class of a library by the share of T-rich read pairs."""
    return F.when(t_rich >= 0.8, "original").when(t_rich <= 0.2, "pbat").when(t_rich.between(0.4, 0.6), "random").otherwise("inconclusive")


def context_tag(two_before: Column, before: Column, base: Column, after: Column, two_after: Column) -> Column:
    """Context of a cytosine on either strand, by the bases around it; null neighbours are in no set, other bases are N."""
    plus = F.when(after == "G", "CpG").when(after.isin("A", "C", "T") & two_after.isin("A", "C", "T"), F.when(after == "C", "CCG").otherwise("CHH"))
    plus = F.when(after == "G", "CpG").when(after.isin("A", "C", "T") & two_after.isin("A", "C", "T"), "CHH").when(after.isin("A", "T") & (two_after == "G"), "CXG").otherwise("CCG")
    minus = F.when(before == "C", "CpG").when(before.isin("A", "G", "T") & two_before.isin("A", "G", "T"), "CHH").when(before.isin("A", "T") & (two_before == "C"), "CXG").otherwise("CCG")
    null_safe = lambda c: F.coalesce(c, F.lit("CCG"))
    return F.when(base == "C", null_safe(plus)).when(base == "G", null_safe(minus)).otherwise("N")


def strip_suffix(name: Column, size: int) -> Column:
    """A read's name without its last letters; a name that is no longer than that stays."""
    return F.when(F.length(name) > size, F.substr(name, F.lit(1), (F.length(name) - size).cast("int"))).otherwise(name)


def strip_extension(path: Column) -> Column:
    """The last part of a path without its folder and what follows the last dot."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(F.instr(base, ".") > 1, F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


def site_type(context: Column, kind: str) -> Column:
    """Whether a context, with or without the mark of a mutation, is of a kind: all, CpG, CHH, CXG, CCG, CHG (both of the latter) or CH (all but CpG)."""
    plain = F.regexp_replace(context, "x$", "")
    sets = {"CHG": ["CXG", "CCG"], "CH": ["CHH", "CXG", "CCG"]}
    if kind not in ("all", "CpG", "CHH", "CXG", "CCG", *sets):
        raise ValueError(f"no such kind of site: {kind}")
    return F.lit(True) if kind == "all" else plain.isin(sets.get(kind, [kind]))
