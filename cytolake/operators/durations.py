"""Three-state models whose domains have lengths of their own: gain and loss of a level between two samples, against no change.

A domain of gain or loss has a length from a negative binomial distribution, up to a greatest one, and is followed by sites without change; those
are left with a fixed probability. Values in (0, 1), such as P(level of A < level of B), have a beta distribution in each state.
A segment is one row and one task's; training sums what segments tell.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from .distributions import paired_tests
from .intervals import blocked, islands, points_in, segment_by_gap
from .significance import _ranks

GAIN, SAME, LOSS = 0, 1, 2
#: Values nearer to 0 or 1 are taken to be this far from them.
NEAR = 1e-10
#: Sites of a block; the blocks of a long segment step together. How far apart what two rounds say of a block's border may be, of 1.
BLOCK, SETTLED = 512, 1e-13


@dataclass(frozen=True)
class DurationModel:
    """emission: alpha and beta of gain, same and loss. gain, loss: mean and overdispersion of their lengths. leave: that a site without change is the last one, of which `up` go to gain."""

    emission: tuple = ((0.5, 2.0), (1.5, 1.5), (2.0, 0.5))
    gain: tuple = (10.0, 0.5)
    loss: tuple = (10.0, 0.5)
    leave: float = 0.02
    up: float = 0.5
    longest: int = 200
    start: tuple = (1 / 3, 1 / 3, 1 / 3)

    def log_lengths(self) -> np.ndarray:
        """ln of the probability of each length 1 ... longest, of gain and of loss."""
        n = np.arange(1, self.longest + 1)
        return np.stack([kernels.log_density("negative_binomial", n, 1 / a, 1 / (1 + a * m)) for m, a in (self.gain, self.loss)])


def _log_sum(x: np.ndarray) -> float:
    top = x.max(initial=-np.inf)
    return top if np.isneginf(top) else float(top + np.log(np.exp(x - top).sum()))


def posteriors(model: DurationModel, x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Of one segment's values: the states' probabilities at each site (sites x 3), and ln of the likelihood from the front and from the back.

    A domain that begins or ends with the segment has its whole length in it. Long segments go in blocks, and where numbers get too small for that, by logarithms.
    """
    if len(x) >= 2 * BLOCK:
        got = _in_blocks(model, x)
        if got is not None:
            return got
    return _by_logs(model, x)


def _in_blocks(model: DurationModel, x: np.ndarray) -> tuple[np.ndarray, float, float] | None:
    """posteriors() with all blocks of a segment a site further at once; None where numbers get too small.

    Of a domain, its age (from the front) or what is left of it (from the back) is all that a site must know, so a block's border is the weight of no
    change and of each age of gain and loss. Borders begin as guesses; blocks whose border moved are gone over again until none does. The border of
    the segment's end is known, so what then stands is the only solution.
    """
    x = np.clip(np.asarray(x, float), NEAR, 1 - NEAR)
    n, size = len(x), BLOCK
    count = -(-n // size)
    logs = np.stack([kernels.log_density("beta", x, a, b) for a, b in model.emission])
    top = logs.max(axis=0)
    emit = np.ones((3, count * size))
    emit[:, :n] = np.exp(logs - top)
    emit = np.ascontiguousarray(emit.reshape(3, count, size).transpose(0, 2, 1))  # states x sites of a block x blocks
    last = n - 1 - (count - 1) * size  # the last site's place in the last block
    weights = np.stack([np.exp(v) for v in model.log_lengths()])  # of gain and of loss
    total = np.arange(model.longest)[:, None] + np.arange(model.longest)
    hankel = np.where(total < model.longest, weights[:, np.minimum(total, model.longest - 1)], 0.0)
    with np.errstate(all="ignore"):
        a = _settled(lambda on, border: _ahead(model, emit[..., on], weights, border, on == 0), count, model.longest, 1)
        z = _settled(lambda on, border: _behind(model, emit[..., on], weights, border, np.where(on == count - 1, last, -1)), count, model.longest, -1)
        whole = a["same"][0] * z["after"][0]
        cover = np.einsum("sab,sab->sb", a["ages"], hankel @ z["rest"])
        whole = whole + cover.sum(axis=0)
        scale = a["scale"] + z["scale"]
        weight = np.exp(scale - scale[0]) / whole
        steps = a["entry"] * z["begun"] * weight  # that a domain begins here, less that one ended before
        steps[:, 1:] -= (a["ended"] * z["follow"] * weight)[:, :-1]
        steps[:, 0] = cover / whole
        post = np.empty((count * size, 3))
        post[:, SAME] = (a["same"] * z["after"] * weight).T.ravel()
        for s, k in ((GAIN, 0), (LOSS, 1)):
            post[:, s] = np.maximum(np.cumsum(steps[k], axis=0), 0.0).T.ravel()
        post = post[:n]
        front = top.sum() + a["gain"][:-1].sum() + a["scale"][last, -1] + np.log(a["same"][last, -1] + a["ended"][:, last, -1].sum())
        first = model.start[SAME] * emit[SAME, 0, 0] * z["after"][0, 0] + model.start[GAIN] * z["begun"][0, 0, 0] + model.start[LOSS] * z["begun"][1, 0, 0]
        back = top.sum() + z["gain"][1:].sum() + z["scale"][0, 0] + np.log(first)
        post = post / post.sum(axis=1, keepdims=True)
    return (post, float(front), float(back)) if np.isfinite(post).all() and np.isfinite([front, back]).all() else None


def _settled(go, count: int, most: int, ahead: int) -> dict:
    """What go(blocks, borders) tells of all blocks, again for those whose border, the one that their neighbour tells, moved. Borders: weights of no change, then of gain and loss by age, that add up to one."""
    border = np.zeros((1 + 2 * most, count))
    border[0] = 1.0
    out, on = {}, np.arange(count)
    while len(on):
        got = go(on, border[:, on])
        for name, x in got.items():
            if name not in out:
                out[name] = x
            else:
                out[name][..., on] = x
        told = on[(on + ahead >= 0) & (on + ahead < count)]
        moved = np.abs(out["border"][:, told] - border[:, told + ahead]).sum(axis=0) > SETTLED
        on = np.sort(told[moved] + ahead)
        border[:, on] = out["border"][:, on - ahead]
    return out


def _into(model: DurationModel) -> np.ndarray:
    return np.array([model.leave * model.up, model.leave * (1 - model.up)])


def _ahead(model: DurationModel, emit: np.ndarray, weights: np.ndarray, border: np.ndarray, first: np.ndarray) -> dict:
    """From the front, by sites of blocks: same (the site is without change), entry (a domain begins before its value), ended, their scale; ages at the first site; the border after the last and the logarithm that it adds."""
    size, blocks, most = emit.shape[1], emit.shape[2], model.longest
    into, begin, older = _into(model)[:, None], np.array(model.start)[[GAIN, LOSS]][:, None], weights[:, ::-1]
    held = np.zeros((2, most + size, blocks))  # weights of the domains that go on, by the site that they begin at
    held[:, :most] = border[1:].reshape(2, most, blocks)[:, ::-1]
    same, stop = border[0], np.stack([older[s] @ held[s, :most] for s in (0, 1)])
    out = {"same": np.empty((size, blocks)), "scale": np.empty((size, blocks)), "entry": np.empty((2, size, blocks)), "ended": np.empty((2, size, blocks))}
    scale = np.zeros(blocks)
    for t in range(size):
        if t and t % 8 == 0:
            norm = same + held[:, t : t + most].sum(axis=(0, 1))
            same, stop, scale = same / norm, stop / norm, scale + np.log(norm)
            held[:, t : t + most] /= norm
        entry, before = same * into, same * (1 - model.leave) + stop.sum(axis=0)
        if t == 0:
            entry, before = np.where(first, begin, entry), np.where(first, model.start[SAME], before)
        held[:, most + t] = entry
        if t == 0:
            out["ages"] = held[:, most:0:-1].copy()
        for s, state in ((0, GAIN), (1, LOSS)):
            window = held[s, t + 1 : t + 1 + most]
            window *= emit[state, t]
            stop[s] = older[s] @ window
        same = emit[SAME, t] * before
        out["same"][t], out["scale"][t], out["entry"][:, t], out["ended"][:, t] = same, scale, entry, stop
    left = np.concatenate([same[None], held[:, size:][:, ::-1].reshape(2 * most, blocks)])
    norm = left.sum(axis=0)
    return out | {"border": left / norm, "gain": scale + np.log(norm)}


def _behind(model: DurationModel, emit: np.ndarray, weights: np.ndarray, border: np.ndarray, last: np.ndarray) -> dict:
    """From the back, by sites of blocks: after (all that follows a site without change), follow (all that follows a domain's end), begun (a domain begins here, and all that follows), their scale; rest at the first site; border and gain as _ahead(). last: the segment's last site, or -1."""
    size, blocks, most = emit.shape[1], emit.shape[2], model.longest
    into = _into(model)[:, None]
    held = np.zeros((2, size + most, blocks))  # weights of the domains that go on, by the site that they end at
    held[:, size:] = border[1:].reshape(2, most, blocks)
    same, begun = border[0], np.stack([weights[s] @ held[s, size:] for s in (0, 1)])
    out = {"after": np.empty((size, blocks)), "scale": np.empty((size, blocks)), "follow": np.empty((size, blocks)), "begun": np.empty((2, size, blocks))}
    scale = np.zeros(blocks)
    for t in range(size - 1, -1, -1):
        if t < size - 1 and t % 8 == 7:
            norm = same + held[:, t + 1 : t + 1 + most].sum(axis=(0, 1))
            same, begun, scale = same / norm, begun / norm, scale + np.log(norm)
            held[:, t + 1 : t + 1 + most] /= norm
        follow, after = same, same * (1 - model.leave) + (into * begun).sum(axis=0)
        ends = last == t
        if ends.any():
            follow, after, scale = np.where(ends, 1.0, follow), np.where(ends, 1.0, after), np.where(ends, 0.0, scale)
            held[:, t + 1 :, ends] = 0.0
        held[:, t] = follow
        begun = np.empty((2, blocks))
        for s, state in ((0, GAIN), (1, LOSS)):
            window = held[s, t : t + most]
            window *= emit[state, t]
            begun[s] = weights[s] @ window
        same = emit[SAME, t] * after
        out["after"][t], out["scale"][t], out["follow"][t], out["begun"][:, t] = after, scale, follow, begun
    out["rest"] = held[:, :most].copy()
    left = np.concatenate([same[None], held[:, :most].reshape(2 * most, blocks)])
    norm = left.sum(axis=0)
    return out | {"border": left / norm, "gain": scale + np.log(norm)}


def _by_logs(model: DurationModel, x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """posteriors() site by site. The sums over lengths are along the arrays of one site."""
    x = np.clip(np.asarray(x, float), NEAR, 1 - NEAR)
    n, most = len(x), model.longest
    emit = np.stack([kernels.log_density("beta", x, a, b) for a, b in model.emission])
    total = np.concatenate([np.zeros((3, 1)), np.cumsum(emit, axis=1)], axis=1)
    sizes = dict(zip((GAIN, LOSS), model.log_lengths()))
    with np.errstate(divide="ignore"):
        begin, stay = np.log(model.start), np.log(1 - model.leave)
        into = {GAIN: np.log(model.leave * model.up), LOSS: np.log(model.leave * (1 - model.up))}
    same = np.empty(n)
    ended = {GAIN: np.empty(n), LOSS: np.empty(n)}
    # of a domain that begins at a site: ln of all before it, less what its values up to there add
    entry = {s: np.empty(n) for s in ended}
    for t in range(n):
        low = max(0, t + 1 - most)
        for s in ended:
            entry[s][t] = (begin[s] if t == 0 else same[t - 1] + into[s]) - total[s, t]
            ended[s][t] = total[s, t + 1] + _log_sum(entry[s][low : t + 1] + sizes[s][: t + 1 - low][::-1])
        same[t] = emit[SAME, t] + (begin[SAME] if t == 0 else _log_sum(np.array([ended[GAIN][t - 1], ended[LOSS][t - 1], same[t - 1] + stay])))
    front = _log_sum(np.array([ended[GAIN][-1], same[-1], ended[LOSS][-1]]))
    after = {s: np.zeros(n) for s in (GAIN, SAME, LOSS)}  # ln of all that follows a site where the state ends, or of same, goes on
    for t in range(n - 2, -1, -1):
        next_ = emit[SAME, t + 1] + after[SAME][t + 1]
        after[GAIN][t] = after[LOSS][t] = next_
        ways = [np.array([stay + next_])]
        high = min(n, t + 1 + most)
        for s in ended:
            ways.append(into[s] + total[s, t + 2 : high + 1] - total[s, t + 1] + sizes[s][: high - t - 1] + after[s][t + 1 : high])
        after[SAME][t] = _log_sum(np.concatenate(ways))
    first = [np.array([begin[SAME] + emit[SAME, 0] + after[SAME][0]])]
    high = min(n, most)
    first += [begin[s] + total[s, 1 : high + 1] + sizes[s][:high] + after[s][:high] for s in ended]
    back = _log_sum(np.concatenate(first))
    post = np.zeros((n, 3))
    post[:, SAME] = np.exp(same + after[SAME] - front)
    for s in ended:
        for t in range(n):
            high = min(n, t + most)
            # of the domains that begin here, those which end at a site or later
            ways = np.exp(entry[s][t] + total[s, t + 1 : high + 1] + sizes[s][: high - t] + after[s][t:high] - front)
            post[t:high, s] += np.cumsum(ways[::-1])[::-1]
    return post / post.sum(axis=1, keepdims=True), front, back


def states_of(post: np.ndarray) -> np.ndarray:
    """Gain or loss where it is likelier than both others, else same."""
    out = np.full(len(post), SAME)
    out[(post[:, GAIN] > post[:, SAME]) & (post[:, GAIN] > post[:, LOSS])] = GAIN
    out[(post[:, LOSS] > post[:, SAME]) & (post[:, LOSS] > post[:, GAIN])] = LOSS
    return out


def _segments(rows: DataFrame, gap: int) -> DataFrame:
    """chrom, segment and its sites in order, as arrays."""
    t = segment_by_gap(rows.select("chrom", "pos", "value"), gap)
    t = t.groupBy("chrom", "segment").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("s"))
    return t.select("chrom", "segment", F.col("s.pos").alias("pos"), F.col("s.value").alias("value"))


def _values(batch: pa.RecordBatch):
    for values in batch["value"]:
        yield values.values.to_numpy(zero_copy_only=False).astype(float)


def train(rows: DataFrame, model: DurationModel | None = None, gap: int = 1000, iterations: int = 20, tolerance: float = 1e-10) -> tuple[DurationModel, float]:
    """Fits the model to values (chrom, pos, value) by expectation and maximisation; returns it with the log-likelihood that it was found at.

    Emissions are fitted to the states' probabilities; lengths to those of the runs of likeliest states that end within their segment. Stops, with the
    parameters before, when the log-likelihood gains less than the tolerance of itself. A round's sums are one row for each state and length.
    """
    model, before = model or DurationModel(), -np.inf
    segments = _segments(rows, gap).persist()

    def tell(batches):
        names = ["kind", "state", "length", "a", "b", "c"]
        for batch in batches:
            out = []
            for x in _values(batch):
                post, score, _ = posteriors(now, x)
                x = np.clip(x, NEAR, 1 - NEAR)
                out.append(("score", 0, 0, score, 0.0, 0.0))
                out += [("beta", s, 0, float(p.sum()), float(p @ np.log(x)), float(p @ np.log1p(-x))) for s, p in enumerate(post.T)]
                states = states_of(post)
                ends = np.flatnonzero(states[1:] != states[:-1])
                out += [("length", int(states[e]), int(k), 1.0, 0.0, 0.0) for e, k in zip(ends, np.diff(ends, prepend=-1))]
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=names)

    try:
        for _ in range(iterations):
            now = model
            found = segments.mapInArrow(tell, "kind string, state int, length long, a double, b double, c double").groupBy("kind", "state", "length").agg(*[F.sum(c).alias(c) for c in "abc"]).collect()
            score = sum(r.a for r in found if r.kind == "score")
            if not found or (score - before) / abs(score) < tolerance:
                break
            before = score
            model = _fitted(now, [r for r in found if r.kind == "beta"], [r for r in found if r.kind == "length"])
        else:
            now = model
    finally:
        segments.unpersist()
    return now, float(before)


def _fitted(model: DurationModel, sums: list, lengths: list) -> DurationModel:
    emission = list(model.emission)
    for r in sums:
        emission[r.state] = kernels.fit_beta(r.a, r.b, r.c)

    def fit(state: int, old: tuple) -> tuple:
        some = [(r.length, r.a) for r in lengths if r.state == state]
        if not some:
            return old
        n, w = map(np.array, zip(*some))
        mean = float((n * w).sum() / w.sum())
        return mean, max(1e-6, kernels.fit_overdispersion(n, np.ones(len(n)), w, mean))

    count = [sum(r.a for r in lengths if r.state == s) for s in range(3)]
    held = sum(r.length * r.a for r in lengths if r.state == SAME)
    leave = min(count[SAME] / held, 1 - 1e-6) if held else model.leave
    domains_ = count[GAIN] + count[LOSS]
    up = min(max(count[GAIN] / domains_, 1e-6), 1 - 1e-6) if domains_ else model.up
    return replace(model, emission=tuple(emission), gain=fit(GAIN, model.gain), loss=fit(LOSS, model.loss), leave=leave, up=up)


def decode(rows: DataFrame, model: DurationModel, gap: int = 1000) -> DataFrame:
    """chrom, segment, pos, value, state (0 gain, 1 same, 2 loss) and the probabilities gain, same and loss of every site."""
    names = ["chrom", "segment", "pos", "value", "state", "gain", "same", "loss"]

    def run(batches):
        for batch in batches:
            for k, x in enumerate(_values(batch)):
                post = posteriors(model, x)[0]
                n = len(x)
                head = [pa.array([batch["chrom"][k].as_py()] * n, pa.string()), pa.array([batch["segment"][k].as_py()] * n, pa.int64())]
                yield pa.RecordBatch.from_arrays([*head, batch["pos"][k].values.cast(pa.int64()), pa.array(x), pa.array(states_of(post)), *map(pa.array, np.ascontiguousarray(post.T))], names=names)

    return _segments(rows, gap).mapInArrow(run, "chrom string, segment long, pos long, value double, state long, gain double, same double, loss double")


def changed_domains(decoded: DataFrame, sites: DataFrame) -> DataFrame:
    """Runs of gain or loss within segments: chrom, start, end, state, n, score (sum of level B less level A over sites with reads in both), post (sum of the state's probability).

    sites: chrom, pos, meth_a, unmeth_a, meth_b, unmeth_b.
    """
    level = lambda x: F.try_divide(F.col(f"meth_{x}").cast("double"), F.col(f"meth_{x}") + F.col(f"unmeth_{x}"))
    t = decoded.join(sites.select("chrom", "pos", (level("b") - level("a")).alias("__d")), ["chrom", "pos"], "left")
    out = None
    for state, name in ((GAIN, "gain"), (LOSS, "loss")):
        run = islands(t, F.col("state") == state, ("chrom", "segment"))
        sums = F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("__d", F.lit(0.0))).alias("score"), F.sum(name).alias("post")
        one = run.groupBy("chrom", "segment", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), *sums).drop("segment", "island").withColumn("state", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# -- scores of domains ---------------------------------------------------------------------------------------------


def stepwise_cutoff(rows: DataFrame, fdr: float, p: str = "p") -> float | None:
    """The p-value at which the sorted ones stop to rise slower than fdr * rank / n: the first whose successor is not below fdr * its rank / n. None without rows."""
    if fdr < 0:
        return 0.0
    if fdr > 1:
        return 1.0
    r = _ranks(rows.where(F.col(p).isNotNull()), p)
    bar = lambda rank: fdr * rank / F.col("rows")
    before = F.col("rank") - F.col("n")
    stop = F.min(F.when((before > 0) & (F.col(p) >= bar(before)), F.col(p))).alias("stop")
    tie = F.min(F.when((F.col("n") > 1) & (F.col(p) >= bar(before + 1)), F.col(p))).alias("tie")
    told = r.agg(stop, tie, F.max(p).alias("top")).first()
    if told.top is None:
        return None
    last = told.top if told.stop is None else r.where(F.col(p) < told.stop).agg(F.max(p)).first()[0]
    return last if told.tie is None else min(told.tie, last)


def window_scores(sites: DataFrame, sizes: DataFrame, draws: int = 50_000, seed: int = 1) -> DataFrame:
    """size, score: for each size, `draws` windows of so many consecutive sites, drawn by a seed, with the absolute sum of level B less level A. Sites stand by chromosome and place; sizes above their number have none.

    Sums come from running sums over all sites, which meet the windows' ends in two joins by place in the order: no window is collected.
    """
    level = lambda x: F.try_divide(F.col(f"meth_{x}").cast("double"), F.col(f"meth_{x}") + F.col(f"unmeth_{x}"))
    t = blocked(sites.select("chrom", "pos", F.coalesce(level("b") - level("a"), F.lit(0.0)).alias("d")))
    parts = t.groupBy("chrom", "__b").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("sum"))
    up = Window.orderBy("chrom", "__b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("chrom", "__b", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("n"), F.coalesce(F.sum("sum").over(up), F.lit(0.0)).alias("sum"))
    inside = Window.partitionBy("chrom", "__b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({"k": F.row_number().over(inside), "s": F.sum("d").over(inside)}).join(parts, ["chrom", "__b"])
    sums = t.select((F.col("n") + F.col("k")).cast("long").alias("k"), (F.col("sum") + F.col("s")).alias("s"))
    total = sites.count()
    drawn = sizes.select(F.col("size").cast("long").alias("size")).distinct().where(F.col("size") < total)
    first = F.pmod(F.xxhash64(F.lit(seed), "size", "draw"), F.lit(total) - F.col("size"))
    drawn = drawn.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).select("size", first.alias("low"))
    low = sums.select(F.col("k").alias("low"), F.col("s").alias("before"))
    high = sums.select(F.col("k").alias("high"), F.col("s").alias("upto"))
    met = drawn.withColumn("high", F.col("low") + F.col("size")).join(high, "high").join(low, "low", "left")
    return met.select("size", F.abs(F.col("upto") - F.coalesce("before", F.lit(0.0))).alias("score"))


def empirical_p_by(observed: DataFrame, null: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Adds p to the rows: the share of the null scores of the row's key that are greater; 0 where it has none. Counts go over buckets of scores and their sums."""
    counts = lambda t, n: t.groupBy(key, score).agg(n.alias("n"))
    both = counts(observed, F.sum(F.lit(0))).unionByName(counts(null, F.count(F.lit(1)))).groupBy(key, score).agg(F.sum("n").alias("n"))
    part = both.withColumn("bucket", F.floor(F.col(score) * 16))
    sums = part.groupBy(key, "bucket").agg(F.sum("n").alias("held"))
    higher = Window.partitionBy(key).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "bucket", F.coalesce(F.sum("held").over(higher), F.lit(0)).alias("above"), F.sum("held").over(Window.partitionBy(key)).alias("all"))
    inside = Window.partitionBy(key, "bucket").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    done = part.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, [key, "bucket"])
    p = F.coalesce(F.try_divide((F.col("above") + F.col("within")).cast("double"), "all"), F.lit(0.0))
    return observed.join(done.select(key, score, p.alias("p")), [key, score])


def scored_by_windows(found: DataFrame, sites: DataFrame, draws: int = 50_000, seed: int = 1) -> DataFrame:
    """Domains with p: the share of random windows of as many sites whose levels differ more than the domain's."""
    rows = found.withColumns({"size": F.col("n"), "__score": F.abs("score")})
    null = window_scores(sites, rows.select("size"), draws, seed).withColumnRenamed("score", "__score")
    return empirical_p_by(rows, null, "size", "__score").drop("size", "__score")


def scored_by_ranks(found: DataFrame, sites: DataFrame) -> DataFrame:
    """Domains with p: the one-sided signed-rank test of the levels at their sites, B above A in gain, A above B in loss."""
    keys = ["chrom", "start", "end"]
    level = lambda x: F.try_divide(F.col(f"meth_{x}").cast("double"), F.col(f"meth_{x}") + F.col(f"unmeth_{x}"))
    inside = points_in(sites.select("chrom", "pos", level("a").alias("a"), level("b").alias("b")), found.select(*keys))
    tests = paired_tests(inside, keys, "b", "a").select(*keys, "p_greater", "p_less")
    out = found.join(tests, keys, "left")
    return out.withColumn("p", F.coalesce(F.when(F.col("state") == "gain", F.col("p_greater")).otherwise(F.col("p_less")), F.lit(1.0))).drop("p_greater", "p_less")


def significant(scored: DataFrame, fdr: float = 0.05) -> DataFrame:
    """The domains whose p is no greater than the cutoff of stepwise_cutoff()."""
    cutoff = stepwise_cutoff(scored, fdr)
    return scored.where(F.col("p") <= F.lit(cutoff)) if cutoff is not None else scored
