"""Periodic runs of words by divide and conquer: what crosses a midpoint comes from Z-functions on both sides of it.

The words of a text are interned to ids. A node is a stretch of the text; for each period q, the Z-function of what
follows its midpoint says how far the words agree with those q further on, and the Z-function of what precedes it,
reversed, how far they do so backwards. Both together are the stretch with period q around the midpoint. A stretch that
goes on beyond its node is part of one that the midpoint of an ancestor finds whole, so only those that no neighbour
extends are kept; of one interval the smallest period stays.

A run agrees with itself, a period on, over at least half of `least` words. So a node in which no stretch of that length
comes twice has no run, nor have its parts, and is left out; that takes sorted hashes, of which equal ones only cost time.

A text is one task's work and takes time in its length times its logarithm, whatever its words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, as_bytes, mixed

#: Fewest words of a run.
LEAST = 12
RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def z_function(s: list[int]) -> list[int]:
    """For each place, how many of the numbers from there on are the first ones again."""
    n = len(s)
    out = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = out[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        out[0] = n
    return out


def _again(ids: np.ndarray, size: int) -> np.ndarray:
    """For each stretch of `size` ids, where the next one with its hash begins; far beyond the end if none does."""
    n = len(ids) - size + 1
    hashes = np.zeros(n, np.uint64)
    for k in range(size):
        hashes = mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64))
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    out = np.full(n, 1 << 60, np.int64)
    out[order[same]] = order[same + 1]
    return out


def _crossing(ids: list[int], low: int, middle: int, high: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts, ends and periods of the stretches around the midpoint that lie within the node and are long enough."""
    node, left, right = ids[low:high], ids[low:middle], ids[middle:high]
    # the period's second half stands after the midpoint: right[0] against right[q], left[-1] against right[q - 1]
    onward = np.array(z_function(right + [-1] + node))
    backward = np.array(z_function(left[::-1] + [-1] + node[::-1]))
    q = np.arange(1, len(right) + 1)
    ahead = np.append(onward[1 : len(right)], 0)
    behind = backward[len(left) + 1 + (high - middle - q)]
    yield from _long_enough(middle - behind, middle + q + ahead, q, least)
    # the period's first half stands before the midpoint: left[-1] against left[-1 - q], right[0] against left[-q]
    q = np.arange(1, len(left) + 1)
    behind = np.append(backward[1 : len(left)], 0)
    ahead = onward[len(right) + 1 + (middle - low - q)]
    yield from _long_enough(middle - q - behind, middle + ahead, q, least)


def _long_enough(starts, ends, periods, least):
    good = ends - starts >= np.maximum(least, 2 * periods)
    if good.any():
        yield starts[good], ends[good], periods[good]


def find_runs(ids: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run, by start, then period.

    A run is a stretch with a period of at most half its length, at least `least` long, that no neighbour extends.
    """
    n, half = len(ids), max(1, least // 2)
    if n < max(2, least):
        return []
    whole = np.array(ids, np.int64)
    again = _again(whole, half)
    nodes, found = [(0, n)], {}
    while nodes:
        low, high = nodes.pop()
        if high - low < max(2, least) or again[low : high - half + 1].min() > high - half:
            continue
        middle = (low + high) // 2
        nodes += [(low, middle), (middle, high)]
        for starts, ends, periods in _crossing(ids, low, middle, high, least):
            more_before = (starts > 0) & (whole[starts - 1] == whole[starts - 1 + periods])
            after = np.minimum(ends, n - 1)
            more_after = (ends < n) & (whole[after] == whole[after - periods])
            kept = ~(more_before | more_after)
            for s, e, q in zip(starts[kept].tolist(), ends[kept].tolist(), periods[kept].tolist()):
                found[s, e] = min(q, found.get((s, e), q))
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repeats_of(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words are in some run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def collapse_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the text without the repeats of its runs, its words joined by one space.

    Null, empty and blank texts: no words, no runs, an empty collapsed text. Repeated rows, and several texts under one
    doc_id: a row each. A null doc_id stays null. Other columns are neither read nor returned.
    No shuffle: a row is worked on where it is read.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    schema = f"doc_id long, n_words long, runs {RUNS}, collapsed string"

    def one(raw: bytes) -> tuple[int, list[tuple[int, int, int]], bytes]:
        """How many words, the runs, and the words that stay."""
        numbers: dict[bytes, int] = {}
        ids = [numbers.setdefault(w, len(numbers)) for w in raw.split()]  # bytes.split() splits at the six ASCII spaces
        runs, n, names = find_runs(ids, least), len(ids), list(numbers)
        if runs:
            ids = np.array(ids)[~repeats_of(runs, n)].tolist()
        return n, runs, b" ".join([names[i] for i in ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, runs, texts = [], [], []
            for raw in batch["data"]:
                n, found, text = one(raw.as_py())
                n_words.append(n)
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(text)
            arrays = [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("data")).mapInArrow(run, schema)


def run_columns(found: DataFrame) -> DataFrame:
    """From collapse_runs(): doc_id, n_runs, the longest run's start, length, period and exponent_milli (ties: least start, then period; null without a run), and digests of all runs and of what is left."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("often"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.expr("-longest.back").alias("start"),
        F.col("longest.length").alias("length"),
        F.expr("-longest.often").alias("period"),
        F.expr("1000 * longest.length div -longest.often").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_loops(docs: DataFrame) -> DataFrame:
    """The rows with looping tails in some texts: runs that are known beforehand.

    Where h, the checksum of doc_id in decimal, is a multiple of ten and there are n > 0 words, with g = h div 10 the words from
    a = g mod n on repeat the first p = 1 + (n - a) div (3 + g mod 8) of them. A null doc_id has no checksum: its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(0))
    steps = {
        "__h": h,
        "__words": F.when(F.col("__h") % 10 == 0, words),
        "__n": F.size("__words"),
        "__a": F.expr("__h div 10 % __n"),
        "__p": F.expr("1 + (__n - __a) div (3 + __h div 10 % 8)"),
    }
    told = docs
    for name, column in steps.items():
        told = told.withColumn(name, column)
    looped = F.expr("array_join(transform(sequence(0, __n - 1), i -> __words[if(i < __a, i, __a + (i - __a) % __p)]), ' ')")
    return told.withColumn("text", F.when(F.col("__n") > 0, looped).otherwise(F.col("text"))).drop(*steps)
