"""SimHash near-duplicates with pivot distance tables.

Each distinct fingerprint gets a row of a table: its Hamming distances to PIVOTS fixed reference fingerprints. If two
fingerprints differ in at most `radius` bits, no coordinate of their rows differs by more (triangle inequality), so a
pair is discarded by its largest coordinate difference and only survivors are compared bit by bit.

A pivot table alone would still have to look at all pairs. Which pairs to look at comes from exact pigeonhole blocks:
with 6 blocks of bits, two fingerprints within 3 bits agree on some 3 of the blocks, so each fingerprint goes to 20
keys. A key with more than SMALL fingerprints is split again, without loss: the 32 or so bits outside it are cut into 8
parts, of which two such fingerprints agree on at least 5, so a subkey's fingerprints differ in about 12 bits at most and
cannot be more than some 4096. So the work of a task is bounded however many near copies there are, and no link is lost.
In a key only the links to the smallest member of each local group are emitted, not all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import as_bytes, chunks, scratch, written

PIVOTS, SMALL, RADIUS = 16, 64, 3
_BLOCKS = [11, 11, 11, 11, 10, 10]


def _masks() -> list[int]:
    at, blocks = 0, []
    for width in _BLOCKS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [sum(c) for c in combinations(blocks, len(blocks) - RADIUS)]


def _submasks(mask: int) -> list[int]:
    """Of the bits outside a mask: 8 parts, and each choice of 5 of them."""
    free = [1 << i for i in range(64) if not mask >> i & 1]
    parts = [sum(free[k::8]) for k in range(8)]
    return [sum(c) for c in combinations(parts, 8 - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (long): bit i is set if it is set in over half of the shingles' XXH64. Null and blank texts: 0."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = []
            for _, _, data, offsets in chunks(batch["data"]):
                data = data.tobytes()
                for at, end in zip(offsets.tolist(), offsets[1:].tolist()):
                    words = data[at:end].lower().split()
                    if len(words) <= shingle:
                        grams = [b" ".join(words)] if words else []
                    else:
                        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
                    hashes = np.fromiter((digest(g, 42) for g in grams), np.uint64)
                    ones = np.zeros(64, np.int64)
                    for k in range(0, len(hashes), 1 << 16):  # 4 MB of bits at once
                        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                        ones += bits.sum(axis=0, dtype=np.int64)
                    out.append(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.array(out, np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("data")).mapInArrow(run, "doc_id long, fp long")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot. Fingerprints of several 64-bit words are rows."""
    fps = fps.reshape(len(fps), -1)
    pivots = np.random.default_rng(64).integers(0, 2**64, (PIVOTS, fps.shape[1]), dtype=np.uint64)
    return sum(np.bitwise_count(fps[:, k, None] ^ pivots[None, :, k]).astype(np.int16) for k in range(fps.shape[1]))


def _links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: links within a key, as stars around the smallest row of each linked group."""
    n = len(fps)
    table, label = pivot_table(fps), np.arange(n)
    same = np.flatnonzero(keys[1:] == keys[:-1])  # rows with a next row of the same key
    lag, held, pending = 1, same, []

    def settle():
        if not pending:
            return
        i, j = (np.concatenate(x) for x in zip(*pending))
        pending.clear()
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label[:] = label[label]
            if (before == label).all():
                break

    while len(held):
        other = held + lag
        near = (np.abs(table[held] - table[other]).max(axis=1) <= radius).nonzero()[0]
        i, j = held[near], other[near]
        sure = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        pending.append((i[sure], j[sure]))
        if sum(len(p[0]) for p in pending) > 1_000_000:
            settle()
        lag += 1
        held = held[held + lag < n]
        held = held[keys[held] == keys[held + lag]]
    settle()
    linked = np.flatnonzero(label != np.arange(n))
    return fps[linked], fps[label[linked]]


def _merged(one: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join whose sides are both sorted, none sent to the driver: both grow with the rows, and Spark takes a table to be as small after an explode as before."""
    return one.hint("merge").join(other.hint("merge"), on, how)


def _within(keyed: DataFrame, radius: int) -> DataFrame:
    """Links a, b among rows (key, fp) that share a key. The rows of a key are bounded by how keys are made."""

    def run(batches):
        held = None

        def out(t):
            keys = t["key"].to_numpy(zero_copy_only=False)
            a, b = _links(keys, t["fp"].to_numpy(zero_copy_only=False).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            batch = pa.Table.from_batches([batch]).combine_chunks()
            held = batch if held is None else pa.concat_tables([held, batch])
            keys = held["key"].to_numpy()
            if len(keys) and keys[0] != keys[-1]:  # all but the last key, which may go on
                cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
                yield out(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and len(held):
            yield out(held.combine_chunks())

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _key(number, bits):
    """The number of a choice of blocks and the chosen bits, as one number; equal pairs only are to share it, so it is checked bit by bit later."""
    return F.xxhash64(number, bits)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b of linked distinct fingerprints (column fp: long), so that linked groups are the same as with all links."""
    if radius > RADIUS:
        raise ValueError(f"blocks are laid out for at most {RADIUS} bits")
    root = scratch(fps.sparkSession, "simhash")
    masks = _masks()
    chosen = F.array(*(F.struct(F.lit(k).cast("tinyint").alias("c"), _key(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("key")) for k, m in enumerate(masks)))
    keyed = fps.select("fp", F.explode(chosen).alias("e")).select("fp", "e.c", "e.key")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(_merged(keyed, counts, "key"), f"{root}/shared")
    few = _within(shared.where(F.col("n") <= SMALL).select("key", "fp"), radius)
    crowded = shared.where(F.col("n") > SMALL)
    subs = F.lit(None)
    for k, m in enumerate(masks):
        subs = F.when(F.col("c") == k, F.array(*(_key(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(s)))) for i, s in enumerate(_submasks(m))))).otherwise(subs)
    finer = crowded.select("fp", F.col("key").alias("outer"), F.explode(subs).alias("sub")).select("fp", F.xxhash64("outer", "sub").alias("key"))
    counts = finer.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    many = _within(_merged(finer, counts, "key").select("key", "fp"), radius)
    return written(few.unionByName(many).distinct(), f"{root}/links")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id reachable over links.

    Equal fingerprints are one node, so copies cost nothing. Null and blank texts have fingerprint 0 and are linked like
    any other. A null doc_id takes part with its text; a component of null doc_ids only has component_id null. Repeated
    rows come back as often. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    root = scratch(spark, "fingerprints")
    marked = written(fingerprints(docs, shingle), f"{root}/documents")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("doc")), f"{root}/distinct")
    roots = components(links(distinct.select("fp"), radius))
    named = _merged(distinct, roots, F.col("fp") == F.col("node"), "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"), F.count(F.lit(1)).alias("n"))
    linked = _merged(named.select("fp", "root"), least.where("n > 1"), "root").select("fp", "component_id")
    alone = distinct.select("fp", "doc")
    of = _merged(alone, linked, "fp", "left").select("fp", F.coalesce("component_id", "doc").alias("component_id"))
    return _merged(marked, of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
