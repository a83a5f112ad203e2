import math
import random

import numpy as np

import corpus_pipeline
from cytolake.llm import jaccard, shared
from cytolake.llm.simhash import pivot_table


def _set(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if w and len(w) <= 5 else zip(*(w[k:] for k in range(5))))


def _brute(texts):
    """Smallest id of each document's component over all pairs with Jaccard 0.8 or more."""
    sets, root = {k: _set(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in texts}


def _texts():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}"
    line = " ".join(word() for _ in range(14))  # very common
    out = [None, "", " \t", "one two", "One  two", "one two three"]
    for n in [7, 12, 30, 60, 120, 300] * 3:
        text = [word() for _ in range(n)]
        out.append(" ".join(text))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            out.append(" ".join(word() if rng.random() < share else w for w in text))
        out += [" ".join(text[: n * 4 // 5 + k]) for k in range(6)] + [" ".join(text) + " " + line]
    base = [word() for _ in range(80)]  # a crowded key
    for _ in range(70):
        copy = list(base)
        copy[rng.randrange(80)] = word()
        out.append(" ".join(copy))
    return {k: t for k, t in enumerate(out)}


def test_components_are_those_of_all_pairs(spark):
    texts = _texts()
    got = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == _brute(texts)


def test_stage_keeps_one_of_each_component(spark):
    texts = _texts()
    docs = spark.createDataFrame([(k, t, "s") for k, t in texts.items()], "doc_id long, text string, source string")
    got = [r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()]
    assert sorted(got) == sorted(set(_brute(texts).values()))


def test_fingerprints_are_majorities():
    rng = np.random.default_rng(8)
    sizes = [0, 1, 2, 5, 254, 255, 256, 700, 0, 9000, 3]
    own, of = rng.integers(0, 2**64, sum(sizes), np.uint64), np.repeat(np.arange(len(sizes)), sizes)
    got = jaccard.sketches(own, of, len(sizes))
    salts = [(k + 1) * 0x9E3779B97F4A7C15 % 2**64 for k in range(jaccard.SKETCH)]
    for k, n in enumerate(sizes):
        hashes = np.stack([shared.mixed(own[of == k] + np.uint64(s)) for s in salts], axis=1)
        for bit in (0, 1, 63, 64, 100, 511):
            ones = int((hashes[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).sum())
            assert int(got[k, bit // 64]) >> bit % 64 & 1 == (2 * ones > n)


def _differs(n, m):
    """The probability that a bit differs between majorities of n and of m shingles, as few as 4/5 allows in common."""
    both = -(-4 * (n + m) // 9)
    p = lambda size, k: math.comb(size, k) / 2**size
    over = lambda size, k, held: sum(p(size - both, i) for i in range(size - both + 1) if 2 * (k + i) > size)
    out = 0.0
    for k in range(both + 1):
        a, b = over(n, k, both), over(m, k, both)
        out += p(both, k) * (a * (1 - b) + b * (1 - a))
    return out


def test_the_radius_holds_similar_pairs():
    worst = max(_differs(n, m) for n in range(1, 41) for m in range(n, n * 5 // 4 + 1) if -(-4 * (n + m) // 9) <= n)
    worst = max(worst, math.acos(8 / 9) / math.pi)  # of large sets
    bits = 64 * jaccard.SKETCH
    tail = sum(math.comb(bits, k) * worst**k * (1 - worst) ** (bits - k) for k in range(jaccard.RADIUS + 1, bits + 1))
    assert worst < 0.19 and tail < 1e-28, (worst, tail)
    assert sum(math.comb(bits, k) for k in range(jaccard.RADIUS + 1)) / 2**bits < 2e-5  # of unrelated pairs
    rng = np.random.default_rng(9)
    one = rng.integers(0, 2**64, 900, np.uint64)
    sets = [one, np.append(one[:800], rng.integers(0, 2**64, 100, np.uint64)), rng.integers(0, 2**64, 900, np.uint64)]
    marks = jaccard.sketches(np.concatenate(sets), np.repeat(np.arange(3), 900), 3)
    got = jaccard.may_be_similar(np.array([900] * 3), pivot_table(marks), marks, np.array([0, 0]), np.array([1, 2]))
    assert got.tolist() == [True, False]
