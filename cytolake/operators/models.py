"""Statistical models: hidden Markov segmentation, epiallele mixtures, beta-binomial regression, joint assays.

Only these leave the JVM: segments or rows go to vectorised Python in packs, and the driver sees sums of sufficient
statistics, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import kernels
from ..tables import settled
from .intervals import domains, segment_by_gap

FLOOR = 1e-10


# -- hidden Markov models ------------------------------------------------------------------------------------

#: Sites of a block; blocks of all segments step together.
BLOCK = 128


@dataclass(frozen=True)
class Hmm:
    """States with beta-binomial emissions, shared by states of one group; a transition of 0 never becomes possible. end: of ending in each state, 1 each unless given."""

    start: tuple
    trans: tuple
    emission: tuple  # (alpha, beta) of each group and replicate
    groups: tuple  # group of each state
    end: tuple = ()
    arrays: tuple = ()  # which replicates are arrays: levels with beta emissions


def _log_emissions(model: Hmm, meth: np.ndarray, reads: np.ndarray) -> np.ndarray:
    """Per site and state, summed over replicates with reads. meth, reads: sites x replicates."""

    def of(r, a, b):
        if model.arrays and model.arrays[r]:
            return kernels.log_density("beta", np.clip(meth[:, r] / np.maximum(reads[:, r], 1), 0.01, 0.99), a, b)
        return kernels.betabinomial_logpmf(meth[:, r], reads[:, r], a, b)

    by = [sum(np.where(reads[:, r] > 0, of(r, *pair[r]), 0.0) for r in range(reads.shape[1])) for pair in model.emission]
    return np.stack([by[g] for g in model.groups], axis=1)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that sum to one, and the logarithms of what they were divided by."""
    total = x.sum(axis=tuple(range(1, x.ndim)))
    return x / total.reshape(-1, *[1] * (x.ndim - 1)), np.log(total)


def forward_backward(model: Hmm, logs: np.ndarray, lengths: np.ndarray, steps: bool = False):
    """Posteriors (sites x states), expected transitions and log-likelihood of segments that stand one after the other. With steps, transitions site by site.

    Segments are cut into blocks. The sites of a block after its first make one k x k transfer matrix; the blocks of a
    segment are scanned in order for the vectors at their borders; then all blocks go over their sites at once. So the loops
    are as long as a block and as the number of blocks of the longest segment.
    """
    n, k = logs.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k)), 0.0
    top = logs.max(axis=1, keepdims=True)
    emit, trans, end = np.exp(logs - top), np.array(model.trans), np.array(model.end or (1.0,) * k)
    lengths = np.asarray(lengths)
    count = -(-lengths // BLOCK)  # blocks of each segment
    segment = np.repeat(np.arange(len(lengths)), count)
    rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = (np.cumsum(lengths) - lengths)[segment] + rank * BLOCK
    size = np.minimum(BLOCK, lengths[segment] - rank * BLOCK)
    longer = [np.flatnonzero(size > t) for t in range(size.max())]
    rest = np.tile(np.eye(k), (len(begin), 1, 1))
    for t, on in enumerate(longer[1:], 1):
        rest[on] = _scaled(rest[on] @ trans * emit[begin[on] + t][:, None, :])[0]
    ahead, last, after = np.empty((len(begin), k)), np.empty((len(begin), k)), np.tile(end, (len(begin), 1))
    by_rank = [np.flatnonzero(rank == r) for r in range(count.max())]
    for r, on in enumerate(by_rank):
        ahead[on] = np.array(model.start) if r == 0 else last[on - 1] @ trans
        last[on] = _scaled(np.einsum("bi,bij->bj", ahead[on] * emit[begin[on]], rest[on]))[0]
    for on in reversed(by_rank):
        on = on[rank[on] < count[segment[on]] - 1]
        after[on] = _scaled((emit[begin[on + 1]] * np.einsum("bij,bj->bi", rest[on + 1], after[on + 1])) @ trans.T)[0]
    alpha, beta, scale = np.empty((n, k)), np.empty((n, k)), np.empty(n)
    for t, on in enumerate(longer):
        at = begin[on] + t
        alpha[at], scale[at] = _scaled((ahead[on] if t == 0 else alpha[at - 1] @ trans) * emit[at])
    for t, on in reversed(list(enumerate(longer))):
        at, inner = begin[on] + t, size[on] > t + 1
        here, x = after[on].copy(), at[inner] + 1
        here[inner] = (emit[x] * beta[x]) @ trans.T
        beta[at] = _scaled(here)[0]
    step = np.ones(n, bool)
    step[np.cumsum(lengths) - lengths] = False
    at = np.flatnonzero(step)
    pair = alpha[at - 1][:, :, None] * trans * (emit[at] * beta[at])[:, None, :]
    counts = np.zeros((n, k, k))
    counts[at] = pair / pair.sum(axis=(1, 2), keepdims=True)
    counts = counts if steps else counts.sum(axis=0)
    post = alpha * beta
    whole = scale.sum() + top.sum() + np.log(alpha[np.cumsum(lengths) - 1] @ end).sum()
    return post / post.sum(axis=1, keepdims=True), counts, float(whole)


def viterbi(model: Hmm, logs: np.ndarray) -> np.ndarray:
    """The likeliest states of one segment."""
    with np.errstate(divide="ignore"):
        start, trans = np.log(model.start), np.log(model.trans)
    score, back = start + logs[0], []
    for row in logs[1:]:
        paths = score[:, None] + trans
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0) + row
    states = [int(score.argmax())]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return np.array(states[::-1])


def _segments(rows: DataFrame) -> DataFrame:
    """chrom, segment and the sites of each segment in order, as binary arrays: pos (long), meth and reads (double, sites x replicates)."""

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        order = np.argsort(t["pos"].to_numpy(), kind="stable")
        flat = lambda c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(order), -1)[order]
        cells = [pa.array([x.tobytes()], pa.binary()) for x in (t["pos"].to_numpy()[order], flat("meth"), flat("reads"))]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), *cells], names=["chrom", "segment", "pos", "meth", "reads"])

    typed = rows.select("chrom", F.col("segment").cast("bigint").alias("segment"), F.col("pos").cast("bigint").alias("pos"), F.col("meth").cast("array<double>").alias("meth"), F.col("reads").cast("array<double>").alias("reads"))
    return typed.groupBy("chrom", "segment").applyInArrow(pack, "chrom string, segment long, pos binary, meth binary, reads binary")


def _arrays(batch: pa.RecordBatch):
    """Of a batch of _segments(): positions, meth, reads and the segments' lengths."""
    pos = [np.frombuffer(x, np.int64) for x in batch["pos"].to_pylist()]
    wide = lambda c: np.concatenate([np.frombuffer(x, float).reshape(len(p), -1) for x, p in zip(batch[c].to_pylist(), pos)])
    return np.concatenate(pos), wide("meth"), wide("reads"), np.array([len(p) for p in pos])


def train(rows: DataFrame, model: Hmm, iterations: int = 10, tolerance: float = 1e-10, likelihood: str | None = None) -> Hmm:
    """Baum-Welch. Segments are shuffled and packed once; each iteration sends one row of sums per task to the driver, which fits the emissions.

    Stops when no transition moves by the tolerance. With likelihood "absolute", when the log-likelihood moves by less than it; with "relative", when
    that gains less than the tolerance of itself, and then with the model that it was found at.
    """
    packed = _segments(rows).persist()
    try:
        return _trained(packed, model, iterations, tolerance, likelihood)
    finally:
        packed.unpersist()


def _trained(packed: DataFrame, model: Hmm, iterations: int, tolerance: float, likelihood: str | None) -> Hmm:
    reps, k = len(model.emission[0]), len(model.start)
    score = -np.inf
    for _ in range(iterations):
        now = model

        def step(batches):
            for batch in batches:
                if not len(batch):
                    continue
                _, meth, reads, lengths = _arrays(batch)
                post, counts, ll = forward_backward(now, _log_emissions(now, meth, reads), lengths)
                level = np.clip(meth / np.maximum(reads, 1), 0.01, 0.99)
                sums = []
                for g in range(len(now.emission)):
                    w = post[:, [s for s in range(k) if now.groups[s] == g]].sum(axis=1)
                    for r in range(reps):
                        own = w * (reads[:, r] > 0)
                        sums += [own.sum(), (own * np.log(level[:, r])).sum(), (own * np.log(1 - level[:, r])).sum()]
                yield pa.RecordBatch.from_arrays([pa.array([[*map(float, sums), *counts.ravel().tolist(), ll]], pa.list_(pa.float64()))], names=["sums"])

        got = packed.mapInArrow(step, "sums array<double>").agg(*[F.sum(F.col("sums")[i]) for i in range(3 * len(model.emission) * reps + k * k + 1)]).first()
        if got[0] is None:
            break
        got = list(got)
        before, score = score, got[-1]
        if likelihood == "relative" and (score - before) / abs(score) < tolerance:
            break
        emission = tuple(tuple(kernels.fit_beta(*got[3 * (g * reps + r) : 3 * (g * reps + r) + 3]) for r in range(reps)) for g in range(len(model.emission)))
        counts = np.array(got[3 * len(model.emission) * reps : -1]).reshape(k, k)
        trans = counts + FLOOR * (np.array(model.trans) > 0)
        trans = trans / trans.sum(axis=1, keepdims=True)
        moved = np.abs(trans - np.array(model.trans)).max()
        start = model.start
        if k == 2 and not model.end:
            start = (trans[1, 0] / (trans[0, 1] + trans[1, 0]), trans[0, 1] / (trans[0, 1] + trans[1, 0]))
        model = replace(model, start=tuple(start), trans=tuple(map(tuple, trans.tolist())), emission=emission)
        if abs(score - before) < tolerance if likelihood == "absolute" else likelihood is None and moved < tolerance:
            break
    return model


def decode(rows: DataFrame, model: Hmm, most_likely_path: bool = False) -> DataFrame:
    """chrom, segment, pos, state, post (of state 0), unmeth (mean share of unmethylated reads over the replicates), into and out_of: by posterior, or by the likeliest path.

    into and out_of are the probabilities that the step to this site goes from another state to state 0, or from it to another; 0 at a segment's first site.
    """
    schema = "chrom string, segment long, pos long, state long, post double, unmeth double, into double, out_of double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            pos, meth, reads, lengths = _arrays(batch)
            logs = _log_emissions(model, meth, reads)
            post, steps, _ = forward_backward(model, logs, lengths, steps=True)
            states = post.argmax(axis=1)
            if most_likely_path:
                states = np.concatenate([viterbi(model, part) for part in np.split(logs, np.cumsum(lengths)[:-1])])
            into, out_of = steps[:, 1:, 0].sum(axis=1), steps[:, 0, 1:].sum(axis=1)
            unmeth = np.where(reads > 0, 1 - meth / np.maximum(reads, 1e-300), 0.0).mean(axis=1)
            which = np.repeat(np.arange(len(lengths)), lengths)
            heads = [pa.array(np.array(batch["chrom"].to_pylist(), object)[which], pa.string()), pa.array(np.array(batch["segment"].to_pylist(), np.int64)[which])]
            yield pa.RecordBatch.from_arrays([*heads, *map(pa.array, (pos, states.astype(np.int64), np.ascontiguousarray(post[:, 0]), unmeth, into, out_of))], names=names)

    return _segments(rows).mapInArrow(run, schema)


def save_model(spark, model: Hmm, path: str) -> None:
    """Writes a model's parameters as text: a name and numbers in a row."""
    flat = [("START", model.start), *(("TRANS", t) for t in model.trans), *(("EMISSION", [x for pair in g for x in pair]) for g in model.emission), ("GROUPS", model.groups), ("END", model.end), ("ARRAYS", [int(a) for a in model.arrays])]
    rows = [(i, "\t".join([name, *(repr(float(x)) for x in values)])) for i, (name, values) in enumerate(flat)]
    spark.createDataFrame(rows, "i int, value string").orderBy("i").coalesce(1).select("value").write.mode("overwrite").text(path)


def load_model(spark, path: str) -> Hmm:
    """Reads what save_model() wrote."""
    found: dict[str, list] = {}
    for row in spark.read.text(path).collect():  # a few lines
        name, *values = row.value.split("\t")
        found.setdefault(name, []).append(tuple(map(float, values)))
    emission = tuple(tuple(zip(g[::2], g[1::2])) for g in found["EMISSION"])
    return Hmm(found["START"][0], tuple(found["TRANS"]), emission, tuple(map(int, found["GROUPS"][0])), found["END"][0], tuple(map(bool, found["ARRAYS"][0])))


def _ordered(rows: DataFrame, seed: int) -> DataFrame:
    """Adds k: 1, 2, ... over all rows in the order of a hash of the place. Windows run over buckets and over the buckets' sums, not over all rows."""
    hashed = rows.withColumn("h", F.xxhash64(F.lit(seed), "chrom", "pos")).withColumn("b", F.shiftright("h", 52))
    sums = hashed.groupBy("b").agg(F.count(F.lit(1)).alias("total"))
    before = sums.select("b", F.coalesce(F.sum("total").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("b").orderBy("h", "chrom", "pos"))
    return hashed.withColumn("within", within).join(before, "b").withColumn("k", F.col("before") + F.col("within"))


def shuffled(rows: DataFrame) -> DataFrame:
    """The same places with all their counts permuted: places and counts stand in the orders of two hashes, the same at every partitioning."""
    return _ordered(rows, 409).select("k", "chrom", "segment", "pos").hint("merge").join(_ordered(rows, 408).select("k", "meth", "reads").hint("merge"), "k").drop("k")


def observations(sites: DataFrame, desert: int, replicates: int = 1) -> DataFrame:
    """Sites (chrom, pos, n_reads, n_meth, or arrays of them) with reads, in segments."""
    if replicates == 1:
        sites = sites.withColumns({"reads": F.array("n_reads"), "meth": F.array("n_meth")})
    covered = sites.where(F.exists("reads", lambda x: x > 0))
    return settled(segment_by_gap(settled(covered.select("chrom", "pos", "meth", "reads"), "sites"), desert), "segments")


def significant_runs(rows: DataFrame, model: Hmm, cutoff: float = 0.01) -> DataFrame:
    """chrom, segment, start, end, n, score, p of the runs of state 0 whose unmethylated shares sum to what random order rarely reaches: p is below the step-up cutoff."""
    from .significance import empirical_p, stepup_cutoff

    runs = lambda r: settled(domains(settled(decode(r, model), "states"), F.col("state") == 0, score=F.col("unmeth")), "runs")
    scored = settled(empirical_p(runs(rows), runs(shuffled(rows))), "scored")
    limit = stepup_cutoff(scored, cutoff)  # one row
    return scored.crossJoin(F.broadcast(limit)).where(F.col("p") < F.col("cutoff")).drop("cutoff")


def hypomethylated_regions(sites: DataFrame, desert: int = 1000, iterations: int = 10, cutoff: float = 0.01, replicates: int = 1, partial: bool = False, model: Hmm | None = None) -> DataFrame:
    """chrom, start, end, n, score, p, name (HYPO0, ...) of regions of low methylation: runs of state 0 that random order rarely matches.

    """
    from ..functions.columns import fold
    from .sites import numbered_names

    rows = observations(sites, desert, replicates)
    if partial:
        rows = rows.withColumn("meth", F.zip_with("meth", "reads", lambda m, r: F.when(r > 0, r * fold(m / r)).otherwise(0.0)))
    if model is None:
        mean = rows.agg(F.avg(F.aggregate("reads", F.lit(0).cast("bigint"), lambda a, x: a + x) / replicates)).first()[0] or 1.0
        model = Hmm((0.5, 0.5), ((0.75, 0.25), (0.25, 0.75)), (((0.33 * mean, 0.67 * mean),) * replicates, ((0.67 * mean, 0.33 * mean),) * replicates), (0, 1))
        model = train(rows, model, iterations)
    return numbered_names(settled(significant_runs(rows, model, cutoff).drop("segment"), "domains"), "HYPO")


def hyper_domains(sites: DataFrame, desert: int = 1000, iterations: int = 10, min_meth: float = 4.0, path: bool = False, model: Hmm | None = None) -> DataFrame:
    """Domains with methylation (plant-like): three states, hypo - hyper - hypo within domains; chrom, start, end, n, score."""
    rows = observations(sites, desert)
    if model is None:
        mean = rows.agg(F.avg(F.col("reads")[0])).first()[0] or 1.0
        low, high = ((0.33 * mean, 0.67 * mean),), ((0.67 * mean, 0.33 * mean),)
        # The model that training begins with. Its last row of transitions does not add up to one.
        model = Hmm((0.5, 0.25, 0.25), ((0.99, 0.01, 0.0), (0.05, 0.475, 0.475), (0.0, 0.6, 0.3)), (low, high), (0, 1, 0), (1e-10, 1e-10, 1e-10))
        model = train(rows, model, iterations, likelihood="relative")
    states = settled(decode(rows, model, most_likely_path=path), "states")
    return domains(states, F.col("state") > 0, score=1 - F.col("unmeth")).where(F.col("score") >= min_meth).drop("segment")


def partial_domains(binned: DataFrame, size: int, iterations: int = 10, cutoff: float = 0.01, sites: DataFrame | None = None, model: Hmm | None = None, replicates: int = 1, arrays: bool = False) -> DataFrame:
    """Partially methylated domains from bins (chrom, bin, and n_reads, n_meth or arrays reads, meth): chrom, start, end, score, n, name.

    Runs of state 0 that random order rarely matches, named PMD0, ... in order. With sites (chrom, pos, n_reads, n_meth, over all
    replicates), their ends are moved to where the levels change most; then ones at most two bins apart are joined, names and all.
    With arrays, a bin's level has a beta distribution, however many probes (n_reads) it is the mean of.
    With sites also start_score, end_score and start_sure, end_sure: how well the levels on either side of the ends fit the model, and the reads on the poorer side.
    """
    from .intervals import merge_near
    from .sites import numbered_names

    rows = observations(binned.withColumn("pos", F.col("bin")), 5, replicates)
    if model is None:
        # The model that training begins with.
        model = Hmm((0.5, 0.5), ((0.99, 0.01), (0.01, 0.99)), (((0.05, 0.95),) * replicates, ((0.95, 0.05),) * replicates), (0, 1), (1e-10, 1e-10), (arrays,) * replicates)
        model = train(rows, model, iterations, tolerance=1e-5, likelihood="absolute")
    found = significant_runs(rows, model, cutoff).select("chrom", (F.col("start") * size).alias("start"), (F.col("end") * size).alias("end"), F.col("n").cast("double").alias("score"))
    found = settled(numbered_names(settled(found), "PMD"), "domains")
    if sites is None:
        return merge_near(found, 2 * size, names=True)
    sites = settled(sites, "sites")
    merged = settled(merge_near(settled(sharpened(found, sites, size, model)), 2 * size, names=True))
    return boundary_scores(merged, sites, size, model)


def array_partial_domains(probes: DataFrame, size: int, iterations: int = 10, cutoff: float = 0.01) -> DataFrame:
    """partial_domains() of probes of an array (chrom, pos, meth): their levels, kept within [0.01, 0.99], are averaged in right-closed bins. Null levels are left out."""
    bin_ = F.greatest(F.lit(0), F.expr(f"(pos + {size - 1}) div {size}") - 1)
    level = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("meth").cast("double")))
    binned = probes.where("meth is not null").groupBy("chrom", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n_reads"), F.sum(level).alias("n_meth"))
    return partial_domains(binned, size, iterations, cutoff, arrays=True)


def partial_domains_of(sites: DataFrame, resolution: int = 500, most: int = 500_000, least: int = 1000, **options) -> DataFrame:
    """partial_domains() with the bin size that the sites' coverage asks for (sites.bin_size), ends moved by the sites; adds bin_size. Without sites there are no domains."""
    from .sites import bin_size, bins

    size = bin_size(sites, resolution, most, least).first()[0]
    return partial_domains(bins(sites, size), size, sites=sites, **options).withColumn("bin_size", F.lit(size))


def _at_ends(regions: DataFrame, sites: DataFrame, size: int) -> DataFrame:
    """Sites within `size` of a region's end: chrom, name, side, at, pos, n_reads, n_meth. Windows are independent of one another."""
    from .intervals import points_in

    side = lambda s: regions.select("chrom", "name", F.lit(s).alias("side"), F.col(s).alias("at"))
    edges = side("start").unionByName(side("end")).withColumns({"start": F.greatest(F.lit(0), F.col("at") - size), "end": F.col("at") + size})
    per = sites.groupBy("chrom", "pos").agg(F.sum("n_reads").alias("n_reads"), F.sum("n_meth").alias("n_meth"))
    return points_in(per, edges.hint("merge"))  # two or more rows for each domain, which Spark takes to be as small as before the explode


def _fit(model: Hmm, low: Column, high: Column, swapped: Column | None = None) -> Column:
    """Mean over replicates of the ln density of levels under the emissions of state 0 (low) and 1 (high); the other way round where swapped holds."""
    edge = lambda p: F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))

    def of(p, a, b):
        return (a - 1) * F.log(edge(p)) + (b - 1) * F.log(1 - edge(p)) - float(kernels.lbeta(a, b))

    pairs = list(zip(*model.emission))
    plain = sum((of(low, *f) + of(high, *g) for f, g in pairs), F.lit(0.0)) / len(pairs)
    if swapped is None:
        return plain
    return F.when(swapped, sum((of(low, *g) + of(high, *f) for f, g in pairs), F.lit(0.0)) / len(pairs)).otherwise(plain)


def sharpened(regions: DataFrame, sites: DataFrame, size: int, model: Hmm) -> DataFrame:
    """Ends of domains moved, within a bin either way, to the site at which the levels inside (state 0) and outside (state 1) fit the model best, of those where the outside is higher; chrom, start, end, score, name."""
    near = _at_ends(regions, sites, size)
    w = Window.partitionBy("chrom", "name", "side").orderBy("pos")
    all_ = Window.partitionBy("chrom", "name", "side")
    upto = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = near.withColumns({"r0": upto("n_reads"), "m0": upto("n_meth"), "r": F.sum("n_reads").over(all_), "m": F.sum("n_meth").over(all_), "k": F.row_number().over(w), "n": F.count(F.lit(1)).over(all_)})
    left = F.col("side") == "start"  # a site itself belongs to the inside
    inner_r, inner_m = F.when(left, F.col("r") - F.col("r0")).otherwise(F.col("r0") + F.col("n_reads")), F.when(left, F.col("m") - F.col("m0")).otherwise(F.col("m0") + F.col("n_meth"))
    outer_r, outer_m = F.col("r") - inner_r, F.col("m") - inner_m
    low, high = F.try_divide(inner_m.cast("double"), inner_r), F.try_divide(outer_m.cast("double"), outer_r)
    tried = t.where((F.col("k") > 1) & (F.col("k") < F.col("n"))).withColumns({"low": low, "high": high}).where("high > low").withColumn("fit", _fit(model, F.col("low"), F.col("high")))
    best = tried.groupBy("chrom", "name").pivot("side", ["start", "end"]).agg(F.max_by("pos", F.struct("fit", -F.col("pos"))))
    best = best.withColumnsRenamed({"start": "new_start", "end": "new_end"})
    moved = regions.hint("merge").join(best.hint("merge"), ["chrom", "name"], "left")
    return moved.select("chrom", F.coalesce("new_start", "start").alias("start"), F.coalesce("new_end", "end").alias("end"), "score", "name").where("start < end")


def boundary_scores(regions: DataFrame, sites: DataFrame, size: int, model: Hmm) -> DataFrame:
    """Adds start_score, end_score (exp of the mean ln density of the levels before and from the end on, within `size`) and start_sure, end_sure (reads on the poorer side)."""
    before = F.col("pos") < F.col("at")
    n = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    s = _at_ends(regions, sites, size).groupBy("chrom", "name", "side").agg(n("n_reads", before).alias("r0"), n("n_meth", before).alias("m0"), n("n_reads", ~before).alias("r1"), n("n_meth", ~before).alias("m1"))
    one, two = F.try_divide(F.col("m0").cast("double"), "r0"), F.try_divide(F.col("m1").cast("double"), "r1")
    scored = s.select("chrom", "name", "side", F.exp(_fit(model, one, two, F.col("side") == "start")).alias("score"), F.least("r0", "r1").alias("sure"))
    wide = scored.groupBy("chrom", "name").agg(*[F.max(F.when(F.col("side") == x, F.col(c))).alias(f"{x}_{c}") for x in ("start", "end") for c in ("score", "sure")])
    return regions.hint("merge").join(wide.hint("merge"), ["chrom", "name"], "left")


# -- epialleles ----------------------------------------------------------------------------------------------


def allele_test(reads: list[tuple[int, str]], iterations: int = 10, bic: bool = False, counts: list[int] | None = None) -> float:
    """Score of two epialleles against one for reads (offset, states), each as often as counts say: a p-value, or with bic the difference of criteria (negative favours two)."""
    width = max(at + len(s) for at, s in reads)
    letters = np.frombuffer("".join(("." * at + s).ljust(width, ".") for at, s in reads).encode(), np.uint8).reshape(-1, width)
    times = np.ones(len(reads)) if counts is None else np.asarray(counts, float)
    total = times.sum()
    x = np.where(letters == ord("C"), 1.0, np.where(letters == ord("T"), 0.0, np.nan))
    seen, ones = ~np.isnan(x), np.nan_to_num(x)
    eps = 1e-10
    fit = lambda w: (w @ ones + eps) / (w @ seen + 2 * eps)
    one = fit(times)
    like = lambda p: (np.where(seen, ones * np.log(p) + (1 - ones) * np.log(1 - p), 0.0)).sum(axis=1)
    l1 = float(times @ like(one))
    a, b = np.full(width, 0.25), np.full(width, 0.75)
    for _ in range(iterations):
        share = 1 / (1 + np.exp(np.clip(like(b) - like(a), -500, 500)))
        share = np.clip(share * (0.5 * total / max(times @ share, eps)), 0, 1)  # the alleles are equally frequent
        a, b = fit(times * share), fit(times * (1 - share))
    l2 = float(times @ (np.logaddexp(like(a), like(b)) + np.log(0.5)))
    if bic:
        r = np.log(total)
        return (2 * width * r - 2 * l2) - (width * r - 2 * l1)
    return float(kernels.chi2_sf(max(0.0, 2 * (l2 - l1)), width)[0])


def allele_tests(digits: np.ndarray, times: np.ndarray, starts: np.ndarray, widths: np.ndarray, iterations: int = 10, bic: bool = False) -> np.ndarray:
    """allele_test() of many sets at once. digits: patterns by CpGs (1 for C, 2 for T, else nothing), the sets one after the other from `starts` on; times: how many reads show them; widths: CpGs of each set."""
    width, eps = digits.shape[1], 1e-10
    told = np.concatenate([digits == 1, digits == 2], axis=1).astype(float)
    ends = np.append(starts[1:], len(digits))
    of, cuts = np.repeat(np.arange(len(starts)), ends - starts), list(zip(starts.tolist(), ends.tolist()))
    crowded = len(digits) > 32 * len(starts)  # a product for each set pays
    per = lambda x: np.add.reduceat(x, starts)

    def sums(w):
        """Of C and of T at each CpG, weighted."""
        return np.stack([w[i:j] @ told[i:j] for i, j in cuts]) if crowded else np.add.reduceat(w[:, None] * told, starts, axis=0)

    def like(logs):
        return np.concatenate([told[i:j] @ x for (i, j), x in zip(cuts, logs)]) if crowded else np.einsum("ij,ij->i", told, logs[of])

    def fit(s):
        return (s[:, :width] + eps) / (s[:, :width] + s[:, width:] + 2 * eps)

    logs = lambda p: np.log(np.concatenate([p, 1 - p], axis=1))
    total, every = per(times), sums(times)
    l1 = per(times * like(logs(fit(every))))
    a, b = np.full((len(starts), width), 0.25), np.full((len(starts), width), 0.75)
    for _ in range(iterations):
        share = 1 / (1 + np.exp(np.clip(like(logs(b) - logs(a)), -500, 500)))
        share = np.clip(share * (0.5 * total / np.maximum(per(times * share), eps))[of], 0, 1)  # the alleles are equally frequent
        a, b = fit(sums(times * share)), fit(sums(times * (1 - share)))
    l2 = per(times * (np.logaddexp(like(logs(a)), like(logs(b))) + np.log(0.5)))
    if bic:
        r = np.log(total)
        return (2 * widths * r - 2 * l2) - (widths * r - 2 * l1)
    return kernels.chi2_sf(np.maximum(0.0, 2 * (l2 - l1)), widths)


#: Patterns whose sets are tested at once.
PATTERNS = 1 << 16


def amr_windows(reads: DataFrame, width: int = 10, min_coverage: int = 4, iterations: int = 10, bic: bool = False) -> DataFrame:
    """chrom, window, n_reads, score of the windows of CpGs with at least min_coverage observations per CpG.

    Reads meet in blocks of windows (reads.window_groups); of a window only its distinct patterns are held.
    """
    from .reads import BLOCK, digits_of, window_groups

    letters = np.arange(0, 2 * width, 2, dtype=np.uint64)

    def work(chrom, first, window, code, n):
        each = code[:, None] >> letters & np.uint64(3)
        told = ((each == 1) | (each == 2)).any(axis=1)
        window, code, n, each = window[told], code[told], n[told], each[told]
        shown = np.bincount(window, (each > 0).sum(axis=1) * n, BLOCK)
        extent = np.zeros(BLOCK, np.int64)
        np.maximum.at(extent, window, width - (each > 0).argmax(axis=1))  # after a pattern's last letter nothing is shown
        deep = shown[window] >= min_coverage * width
        window, code, n = window[deep], code[deep], n[deep]
        starts = np.flatnonzero(np.append(True, window[1:] != window[:-1])[: len(window)])
        ends = np.append(starts[1:], len(window))
        k = 0
        while k < len(starts):
            j = max(k + 1, int(np.searchsorted(ends, starts[k] + PATTERNS, side="right")))
            rows, own = slice(starts[k], ends[j - 1]), window[starts[k:j]]
            score = allele_tests(digits_of(code[rows], width), n[rows].astype(float), starts[k:j] - starts[k], extent[own], iterations, bic)
            yield pa.RecordBatch.from_arrays([pa.array([chrom] * len(own), pa.string()), pa.array(own + first), pa.array(np.add.reduceat(n[rows], starts[k:j] - starts[k])), pa.array(score)], names=["chrom", "window", "n_reads", "score"])
            k = j

    return window_groups(reads, width, work, "chrom string, window long, n_reads long, score double")


def amr_test(reads: DataFrame, regions: DataFrame, iterations: int = 10, bic: bool = False) -> DataFrame:
    """chrom, start, end, n_reads, score of given regions over CpG ordinals, by the reads that reach into them. Equal regions are one.

    Regions stand in the block of CpGs that they begin in, and reads are cut to blocks with as many CpGs after them as the longest region may
    need, so both meet once; of a region only distinct patterns are held.
    """
    from .reads import BLOCK, in_groups, merged_rows, piece_digits, read_pieces

    given = settled(regions.where("start < end and end > 0").select("chrom", F.greatest(F.lit(0), "start").cast("long").alias("low"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct(), "regions")
    longest = given.agg(F.max(F.col("end") - F.col("low"))).first()[0] or 1
    size = max(BLOCK, longest)
    none = lambda kind: F.lit(None).cast(kind)
    own = given.select("chrom", F.expr(f"low div {size}").alias("block"), F.lit(0).alias("kind"), none("int").alias("at"), none("binary").alias("states"), "start", "end")
    parts = read_pieces(reads, size, longest - 1).select("chrom", "block", F.lit(1).alias("kind"), "at", "states", none("long").alias("start"), none("long").alias("end"))

    def work(key, batches):
        first, asked, held = key[1] * size, [], []
        for batch in batches:
            told = batch["kind"].to_numpy() == 0
            for start, end in zip(batch["start"].to_numpy(zero_copy_only=False)[told], batch["end"].to_numpy(zero_copy_only=False)[told]):
                asked.append((int(start), int(end)))
                held.append([])
            if told.all() or not asked:
                continue
            for digits in piece_digits(iter([batch.slice(int(told.sum()))]), size + longest - 1):
                for (start, end), mine in zip(asked, held):
                    some = digits[:, max(0, start) - first : end - first]
                    some = some[((some == 1) | (some == 2)).any(axis=1)]
                    if len(some):
                        mine.append(merged_rows([(some, np.ones(len(some), np.int64))]))
                    if len(mine) > 16:
                        mine[:] = [merged_rows(mine)]
        for (start, end), mine in zip(asked, held):
            if not mine:
                continue
            patterns, n = merged_rows(mine)
            skip = max(0, -start)  # ordinals below 0 have no letters
            extent = skip + int(np.flatnonzero((patterns > 0).any(axis=0))[-1]) + 1
            score = allele_tests(patterns, n.astype(float), np.zeros(1, np.int64), np.array([extent]), iterations, bic)
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), *(pa.array([int(x)], pa.int64()) for x in (start, end, n.sum())), pa.array(score)], names=["chrom", "start", "end", "n_reads", "score"])

    return in_groups(own.unionByName(parts), ["chrom", "block"], work, "chrom string, start long, end long, n_reads long, score double", ("kind",))


def amr_regions(scored: DataFrame, index: DataFrame, width: int = 10, gap: int = 1000, cutoff: float = 0.01) -> DataFrame:
    """Regions in base pairs of significant windows: chrom, start, end, score, n.

    In this order: the false discovery rate's cutoff over all tested windows; windows at or under `cutoff` that overlap or touch become one with the
    least score; ordinals become places by `index` (chrom, cpg, pos); regions at most `gap` apart are joined; those at or above the
    rate's cutoff go, then those narrower than half the gap. An end is the place of the CpG after the last one of the region, or of the last.
    """
    from .intervals import merge_near
    from .significance import fdr_cutoff

    scored = settled(scored, "windows")
    accepted = scored.where(F.col("score") < cutoff)
    tests = scored.count()
    limit = fdr_cutoff(accepted, tests, cutoff, "score")  # one row
    collapsed = settled(merge_near(accepted.select("chrom", F.col("window").alias("start"), (F.col("window") + width - 1).alias("end"), "score"), 1).drop("n"))
    placed = merge_near(settled(to_base_pairs(collapsed, index)), gap)
    good = placed.crossJoin(F.broadcast(limit)).where((F.col("score") <= F.col("cutoff")) & (F.col("end") - F.col("start") >= gap / 2))
    return good.drop("cutoff")


def to_base_pairs(regions: DataFrame, index: DataFrame) -> DataFrame:
    """Regions (chrom, start, end, others) over CpG ordinals at the places of these CpGs by index (chrom, cpg, pos). An end is its CpG's own place. An ordinal without a place fails."""
    from .sites import checked

    of = lambda c: index.select("chrom", F.col("cpg").alias(c), F.col("pos").alias(f"__{c}"))
    met = regions.join(of("start"), ["chrom", "start"], "left").join(of("end"), ["chrom", "end"], "left")
    good = checked(met, F.col("__start").isNull() | F.col("__end").isNull(), "an ordinal has no place")
    return good.select(*[F.col(f"__{c}").alias(c) if c in ("start", "end") else F.col(c) for c in regions.columns])


def amrs(scored: DataFrame, width: int = 10, gap: int = 10, cutoff: float = 0.01) -> DataFrame:
    """Windows under the step-up cutoff as regions over CpG ordinals: overlapping and near ones joined, short ones dropped."""
    from .intervals import merge_near
    from .significance import bh

    sig = settled(bh(settled(scored, "windows").withColumn("p", F.col("score"))).where(F.col("q") < cutoff))
    merged = merge_near(sig.select("chrom", F.col("window").alias("start"), (F.col("window") + width).alias("end"), "score"), gap)
    return merged.where(F.col("end") - F.col("start") >= gap / 2)


# -- regression ----------------------------------------------------------------------------------------------


#: Sites whose regressions are fitted at once. A fit ends where a step promises no more than this, in log-likelihood.
SITES, GAIN = 2048, 1e-9


def _fit_regressions(x: np.ndarray, k: np.ndarray, n: np.ndarray, steps: int = 60) -> np.ndarray:
    """Greatest log-likelihoods of beta-binomial counts with a logit-linear mean and one dispersion, of many sites at once.

    x: sites x samples x factors; k, n: sites x samples, n = 0 for a sample without the site. Newton steps with each site's own second
    derivatives, of which eigenvalues count by their size, so that all steps go up; halved where they do not.
    """
    return np.concatenate([_newton(*(z[i : i + SITES] for z in (x, k, n)), steps) for i in range(0, len(x), SITES)] or [np.zeros(0)])


def _newton(x: np.ndarray, k: np.ndarray, n: np.ndarray, steps: int) -> np.ndarray:
    sites, _, factors = x.shape
    size, seen = factors + 1, (n > 0).astype(float)
    ways = (kernels.lchoose(n, k) * seen).sum(axis=1)

    def told(theta, rows):
        """Values, slopes and second derivatives; the last parameter is the logarithm of alpha + beta."""
        xs, ks, ns, on = x[rows], k[rows], n[rows], seen[rows]
        p = np.clip(1 / (1 + np.exp(-np.clip(np.einsum("ijk,ik->ij", xs, theta[:, :-1]), -30, 30))), 1e-9, 1 - 1e-9)
        q, m = 1 - p, np.exp(theta[:, -1:])
        parts = np.stack([ks + p * m, p * m, ns - ks + q * m, q * m, ns + m])
        (ka, a, nb, b, nm), (m0,) = (zip(*kernels.gammas(z)) for z in (parts, m[None]))
        first, other, both = ([u - v for u, v in zip(*pair)] for pair in ((ka, a), (nb, b), (m0, nm)))
        value = ((first[0] + other[0] + both[0]) * on).sum(axis=1)
        gap, w = (first[1] - other[1]) * on, m * p * q
        eta = w * gap
        level = m * (p * first[1] + q * other[1] + both[1]) * on
        slope = np.concatenate([np.einsum("ijk,ij->ik", xs, eta), level.sum(axis=1, keepdims=True)], axis=1)
        bend = np.empty((len(rows), size, size))
        bend[:, :-1, :-1] = np.einsum("ijk,ijl,ij->ikl", xs, xs, (w * (q - p) * gap + w * w * (first[2] + other[2]) * on))
        bend[:, -1, :-1] = bend[:, :-1, -1] = np.einsum("ijk,ij->ik", xs, eta + w * m * (p * first[2] - q * other[2]) * on)
        bend[:, -1, -1] = (level + m * m * (p * p * first[2] + q * q * other[2] + both[2]) * on).sum(axis=1)
        return value, slope, bend

    theta = np.zeros((sites, size))
    theta[:, -1] = 2.5
    rows = np.arange(sites)
    value, slope, bend = told(theta, rows)
    for _ in range(steps):
        at_end = (np.abs(theta[rows, -1]) >= 15) & (slope[rows, -1] * theta[rows, -1] > 0)  # the dispersion goes no further
        g, h = slope[rows].copy(), bend[rows].copy()
        g[at_end, -1] = 0.0
        h[at_end, -1, :], h[at_end, :, -1], h[at_end, -1, -1] = 0.0, 0.0, -1.0
        w, v = np.linalg.eigh(h)
        move = np.einsum("ijk,ik->ij", v, np.einsum("ijk,ij->ik", v, g) / np.maximum(np.abs(w), 1e-8))
        going = np.flatnonzero((move * g).sum(axis=1) > GAIN)
        rows, move, g = rows[going], move[going], g[going]
        if not len(rows):
            break
        move *= np.minimum(1.0, 5 / np.maximum(np.abs(move).max(axis=1), 1e-300))[:, None]
        rate, open_ = np.ones(len(rows)), np.ones(len(rows), bool)
        for _ in range(25):
            at = np.flatnonzero(open_)
            if not len(at):
                break
            tried = theta[rows[at]] + rate[at, None] * move[at]
            tried[:, -1] = np.clip(tried[:, -1], -15, 15)
            new, s, b = told(tried, rows[at])
            fine = new >= value[rows[at]] + 1e-4 * ((tried - theta[rows[at]]) * g[at]).sum(axis=1)
            good = rows[at[fine]]
            theta[good], value[good], slope[good], bend[good] = tried[fine], new[fine], s[fine], b[fine]
            open_[at[fine]] = False
            rate[at[~fine]] /= 2
        rows = rows[~open_]
    return value + ways


def _fit_regression(x: np.ndarray, k: np.ndarray, n: np.ndarray) -> float:
    return float(_fit_regressions(x[None], k[None], n[None])[0])


def regression(rows: DataFrame, design: dict[int, tuple], factor: int) -> DataFrame:
    """p of a likelihood-ratio test of one factor per site: chrom, pos, p, cov_a, meth_a (factor off), cov_b, meth_b (on).

    rows: chrom, pos, counts (array of struct sample, n_reads, n_meth); design: sample -> row of 0 and 1. p is -1 where
    a side has no reads or all counts are methylated or none is.
    """

    names = sorted(design)
    table = np.array([design[s] for s in names], float)
    on = table[:, factor] == 1

    def run(batches):
        for batch in batches:
            counts = batch["counts"]
            some = counts.flatten()
            row = np.repeat(np.arange(len(batch)), counts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            sample = some.field("sample").to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(names, sample), len(names) - 1)
            if (np.asarray(names)[at] != sample).any():
                raise ValueError("a sample is not in the design")
            n, k = np.zeros((len(batch), len(names))), np.zeros((len(batch), len(names)))
            np.add.at(n, (row, at), some.field("n_reads").to_numpy(zero_copy_only=False))
            np.add.at(k, (row, at), some.field("n_meth").to_numpy(zero_copy_only=False))
            a, b = n[:, ~on].sum(axis=1), n[:, on].sum(axis=1)
            use = np.flatnonzero((a > 0) & (b > 0) & (k.sum(axis=1) > 0) & (k.sum(axis=1) < n.sum(axis=1)))
            p = np.full(len(batch), -1.0)
            x = np.tile(table, (len(use), 1, 1))
            gain = _fit_regressions(x, k[use], n[use]) - _fit_regressions(np.delete(x, factor, axis=2), k[use], n[use])
            p[use] = kernels.chi2_sf(np.maximum(0.0, 2 * gain), 1)
            whole = [c.astype(np.int64) for c in (a, k[:, ~on].sum(axis=1), b, k[:, on].sum(axis=1))]
            yield pa.RecordBatch.from_arrays([batch["chrom"], batch["pos"].cast(pa.int64()), pa.array(p), *map(pa.array, whole)], names=["chrom", "pos", "p", "cov_a", "meth_a", "cov_b", "meth_b"])

    return rows.select("chrom", "pos", "counts").mapInArrow(run, "chrom string, pos long, p double, cov_a long, meth_a long, cov_b long, meth_b long")


# -- joint assays --------------------------------------------------------------------------------------------


def _wilson_apart(value, a, b, z):
    """1 where a value is not inside the Wilson interval of counts a against b, nor where there are none."""
    n = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        p = a / n
        mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
        return (~((value < np.minimum(1.0, mid + half)) & (value > np.maximum(0.0, mid - half)))).astype(np.int64)


def _snapped(x, tolerance):
    return np.where(x <= 2 * tolerance, 0.0, np.where(x >= 1 - 2 * tolerance, 1.0, x))


def _until_still(step, p, q, tolerance, iterations):
    """Repeats a step on rows until neither number of a row moves by more than the tolerance, `iterations` + 1 times at most."""
    p, q, on = p.copy(), q.copy(), np.arange(len(p))
    for _ in range(iterations + 1):
        if not len(on):
            break
        new_p, new_q = step(on, p[on], q[on])
        moved = np.maximum(np.abs(new_p - p[on]), np.abs(new_q - q[on]))
        p[on], q[on] = new_p, new_q
        on = on[moved > tolerance]
    return p, q


def _capped(pdf, pairs, cap):
    """Counts of (yes, no) columns with reads above the cap as if the level were of `cap` reads, rounded."""
    out = []
    for a, b in pairs:
        a, b = pdf[a].to_numpy(float), pdf[b].to_numpy(float)
        n = a + b
        most = np.minimum(n, cap)
        yes = np.where(n > cap, np.floor(a * most / np.maximum(n, 1) + 0.5), a)
        out += [yes, most - yes]
    return out


#: Columns of the input by the names that the estimates below use.
_OUTER = {"h": "u", "g": "t", "t": "h", "u": "g", "m": "m", "l": "l"}
_JOINT = "chrom string, pos long, pm double, ph double, pu double, conflicts long"


def joint_levels(rows: DataFrame, tolerance: float = 1e-10, iterations: int = 500, cap: int = 500, alpha: float = 0.05) -> DataFrame:
    """5mC, 5hmC and unmodified shares per site from bisulfite (h: mC + hmC, g: rest), TAB (u: hmC, t: rest) and oxidative (m: mC, l: rest) counts.

    chrom, pos, pm, ph, pu and conflicts: how many assays' Wilson intervals do not hold the estimate. Null where fewer than
    two assays have reads. Reads above `cap` count as `cap`. Where the three levels add up to one they are the answer; else
    expectation-maximisation over which modification a read stands for, with shares next to 0 or 1 set to it.
    """
    from ..functions.columns import z_of

    z = z_of(alpha)

    def run(frames):
        for pdf in frames:
            h, g, t, u, m, l = _capped(pdf, (("h", "g"), ("t", "u"), ("m", "l")), cap)
            total = h + g + t + u + m + l
            with np.errstate(divide="ignore", invalid="ignore"):
                hat_h, hat_m, hat_u = h / (h + g), m / (m + l), u / (t + u)
            enough = ((h + g > 0).astype(int) + (t + u > 0) + (m + l > 0)) > 1
            sure = enough & (hat_h + hat_m + hat_u == 1)
            p, q, r = (x / (n + tolerance) + tolerance for x, n in ((m, m + l), (h, h + g), (u, t + u)))
            p, q = p / (p + q + r), q / (p + q + r)

            def step(on, p, q):
                of_t, of_g = t[on] * p / (p + q), g[on] * p / (1 - q)
                share = (h[on] + t[on] - of_t) / (h[on] + u[on] + t[on] - of_t + g[on] - of_g)
                new = (m[on] + of_t + of_g) / total[on]
                kept = np.maximum(tolerance, np.minimum(new, 1 - 2 * tolerance))
                return kept, np.maximum(tolerance, np.minimum(share * (1 - new), 1 - tolerance - kept))

            todo = np.flatnonzero(enough & ~sure)
            full = lambda on: todo[on]
            p2, q2 = _until_still(lambda on, p, q: step(full(on), p, q), p[todo], q[todo], tolerance, iterations)
            pm, ph, pu = (np.where(sure, x, np.nan) for x in (hat_m, hat_h, hat_u))
            pm[todo], ph[todo], pu[todo] = (_snapped(x, tolerance) for x in (p2, q2, 1 - p2 - q2))
            apart = _wilson_apart(ph, h, g, z) + _wilson_apart(pm, m, l, z) + _wilson_apart(pu, u, t, z)
            yield _result(pdf, pm, ph, pu, np.where(sure, 0, apart), enough)

    return rows.select("chrom", "pos", *[F.col(_OUTER[c]).alias(c) for c in "hgtuml"]).mapInPandas(run, _JOINT)


def _result(pdf, pm, ph, pu, conflicts, enough):
    none = lambda x: pd.array(np.where(enough, x, 0.0), dtype="Float64") if x.dtype == float else pd.array(np.where(enough, x, 0), dtype="Int64")
    out = pd.DataFrame({"chrom": pdf["chrom"], "pos": pdf["pos"], "pm": none(pm), "ph": none(ph), "pu": none(pu), "conflicts": none(conflicts)})
    out.loc[~enough, ["pm", "ph", "pu", "conflicts"]] = pd.NA
    return out


def joint_levels_two(rows: DataFrame, missing: str, tolerance: float = 1e-10, iterations: int = 500, cap: int = 500, alpha: float = 0.05) -> DataFrame:
    """joint_levels() of two assays; `missing` is the third: bisulfite, tab or oxidative. Columns of the other two as there.

    The levels of two of the shares are the answer if they add up to one at most, and the third is the rest; else
    expectation-maximisation. Which shares the assays tell: TAB hmC, oxidative mC, bisulfite the unmodified.
    """
    from ..functions.columns import z_of

    # first and second assay as (yes, no) columns, and the shares in the order first, second, rest
    plan = {"oxidative": (("h", "g"), ("u", "t"), ("ph", "pu", "pm")), "tab": (("u", "t"), ("m", "l"), ("pu", "pm", "ph")), "bisulfite": (("m", "l"), ("h", "g"), ("pm", "ph", "pu"))}
    if missing not in plan:
        raise ValueError("missing must be bisulfite, tab or oxidative")
    one, two, shares = plan[missing]
    z = z_of(alpha)

    def run(frames):
        for pdf in frames:
            x, y, v, w = _capped(pdf, (one, two), cap)
            enough = (x + y > 0) & (v + w > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                a, b = x / (x + y), v / (v + w)
            over = enough & ~(a + b <= 1)
            todo = np.flatnonzero(over)
            p, q = tolerance + a[todo], tolerance + b[todo]
            high = p + q >= 1
            p, q = np.where(high, np.maximum(tolerance, (1 - tolerance) * p / (p + q)), p), q
            q = np.where(high, np.maximum(tolerance, 1 - p - tolerance), q)
            n = (x + y + v + w)[todo]

            def step(on, p, q):
                moved = y[todo][on] * q / (1 - p)
                share = x[todo][on] / (x[todo][on] + y[todo][on] - moved)
                new = (v[todo][on] + moved) / n[on]
                kept = np.maximum(tolerance, np.minimum(share * (1 - new), 1 - 2 * tolerance))
                return kept, np.maximum(tolerance, np.minimum(new, 1 - tolerance - kept))

            p, q = _until_still(step, p, q, tolerance, iterations)
            first, second = a.copy(), b.copy()
            first[todo], second[todo] = p, q
            rest = 1 - first - second
            first[todo], second[todo], rest[todo] = (_snapped(s, tolerance) for s in (p, q, rest[todo]))
            conflicts = np.where(over, _wilson_apart(first, x, y, z) + _wilson_apart(second, v, w, z), 0)
            got = dict(zip(shares, (first, second, rest)))
            yield _result(pdf, got["pm"], got["ph"], got["pu"], conflicts, enough)

    return rows.select("chrom", "pos", *[F.col(_OUTER[c]).alias(c) for c in (*one, *two)]).mapInPandas(run, _JOINT)
