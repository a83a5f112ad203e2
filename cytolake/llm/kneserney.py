"""An interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers.

Counting takes two passes over the training texts. The first counts words: tasks send sorted runs of word hashes with
counts, dealt by leading bits, and each bucket stores its hashes as a sorted array. A word's id is its place in these
arrays. The second counts pairs of ids in the same way; each bucket stores sorted keys and counts, and sends per context
how many tokens follow and how many followers occur once, twice and more, and per word after how many contexts
it comes. These go to arrays by id. Scoring maps the arrays of the shared folder into memory and looks up the sorted
distinct keys of a chunk of text. Nothing but a few totals comes to the driver.

The order is 2. A third order would hold about 2.5 times as many keys, and more than the disk that a pass may use.
The end of a text is a token, and also the context of a first word. Hashes have 64 bits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import RUN, Opened, Rolling, as_bytes, bucket_of, buckets, chunks, get_array, lean, lower, merged, mixed, pack, pack_counts, put_array, scratch, small_batches, unpack, unpack_counts, words, written

RANGE = 1 << 18
_SENT = "b int, keys binary, counts binary"


def _sent(keys, counts, of, n):
    """Runs by bucket: `of` gives the bucket of each key."""
    order = np.argsort(of, kind="stable")  # within a bucket keys stay sorted
    keys, counts, of = keys[order], counts[order], of[order]
    cuts = np.searchsorted(of, np.arange(n + 1))
    rows = [(b, pack(keys[i:j]), pack_counts(counts[i:j])) for b, i, j in zip(range(n), cuts, cuts[1:]) if i < j]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.int32(), pa.binary(), pa.binary()))], names=["b", "keys", "counts"])


def _gathered(batches, keys="keys", counts="counts"):
    """The runs of a bucket, merged as they come."""
    parts, size, whole = [], 0, 0
    for batch in batches:
        for k, c in zip(batch[keys].to_pylist(), batch[counts].to_pylist()):
            parts.append((unpack(k), unpack_counts(c)))
            size += len(parts[-1][0])
            if size > max(RUN // 4, whole):
                parts = [merged(parts)]
                size, whole = 0, len(parts[0][0])
    return merged(parts)


def _tokens(column):
    """Per chunk: first row, end row, word hashes, words per document."""
    for i, j, data, offsets in chunks(column):
        data = lower(data)
        starts, ends, n = words(data, offsets)
        yield i, j, Rolling(data, 3).of(starts, ends), n


class _Words:
    """Ids of word hashes, and their counts."""

    def __init__(self, path: str, n: int):
        self.n, self.open = n, Opened(path)
        self.offsets = get_array(f"{path}/offsets.npy")

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted distinct hashes: ids, -1 for unknown words, and training counts."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(bucket_of(hashes, self.n), np.arange(self.n + 1))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            if self.offsets[b] == self.offsets[b + 1]:
                continue
            known, count = self.open(f"words-{b}"), self.open(f"counts-{b}")
            asked = hashes[cuts[b] : cuts[b + 1]]
            at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            hit = known[at] == asked
            ids[cuts[b] : cuts[b + 1]][hit] = at[hit] + self.offsets[b]
            counts[cuts[b] : cuts[b + 1]][hit] = count[at[hit]]
        return ids, counts


def _sequences(hashes, n, store, end):
    """Ids of a chunk's tokens with an end after each document, the ids before them, training counts of the words, and where documents start."""
    distinct, which = np.unique(hashes, return_inverse=True)
    ids, counts = store(distinct)
    starts = np.concatenate([[0], np.cumsum(n + 1)])
    is_end = np.zeros(starts[-1], bool)
    is_end[starts[1:] - 1] = True
    out, seen = np.full(starts[-1], end, np.int64), np.zeros(starts[-1], np.int64)
    out[~is_end], seen[~is_end] = ids[which], counts[which]
    before = np.empty_like(out)
    before[1:], before[starts[:-1]] = out[:-1], end
    return out, before, seen, is_end, starts


def _pair(before, ids):
    return before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


class _Pairs:
    """Counts of pairs of ids."""

    def __init__(self, path: str, n: int):
        self.n, self.open = n, Opened(path)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        of = bucket_of(mixed(keys), self.n)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(self.n + 1))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            known, count = self.open(f"pairs-{b}"), self.open(f"pair-counts-{b}")
            at_rows = order[cuts[b] : cuts[b + 1]]
            if known is not None and len(known):
                asked = keys[at_rows]
                at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                out[at_rows] = np.where(known[at] == asked, count[at], 0)
        return out


class _ById:
    """Rows of numbers by id."""

    def __init__(self, path: str, name: str, width: int):
        self.name, self.width, self.open = name, width, Opened(path)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        """Of sorted ids."""
        out = np.zeros((len(ids), self.width), np.int64)
        for r in np.unique(ids // RANGE).tolist():
            rows = self.open(f"{self.name}-{r}")
            at = slice(*np.searchsorted(ids, [r * RANGE, (r + 1) * RANGE]))
            if rows is not None:
                out[at] = rows[ids[at] - r * RANGE]
        return out


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of counts of 0, 1, 2 and more, from how many keys have counts of 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05 * (k > 0)), k * 0.95) for k, d in enumerate(raw)]


class Model:
    """Where the arrays are, and the totals."""

    def __init__(self, path: str, n: int, totals: dict):
        self.path, self.n, self.totals = path, n, totals


def train(docs: DataFrame) -> Model:
    """Counts the texts. Null and empty texts count one end each."""
    spark = docs.sparkSession
    path, n = scratch(spark, "kneser-ney"), buckets(docs)
    texts = docs.select(as_bytes().alias("data"))

    def count_words(batches):
        parts, size, documents = [], 0, 0
        for batch in batches:
            documents += len(batch)
            for _, _, hashes, _ in _tokens(batch["data"]):
                parts.append(np.unique(hashes, return_counts=True))
                size += len(parts[-1][0])
                if size > RUN:
                    keys, counts = merged(parts)
                    yield _sent(keys, counts, bucket_of(keys, n), n)
                    parts, size = [], 0
        keys, counts = merged(parts)
        yield _sent(keys, counts, bucket_of(keys, n), n)
        if documents:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([str(documents).encode()], pa.binary())], names=["b", "keys", "counts"])

    def store_words(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = key[0].as_py()
        if b < 0:
            distinct, total = 0, sum(int(c) for batch in batches for c in batch["counts"].to_pylist())
        else:
            keys, counts = _gathered(batches)
            put_array(f"{path}/words-{b}.npy", keys)
            put_array(f"{path}/counts-{b}.npy", lean(counts))
            distinct, total = len(keys), int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([distinct], pa.int64()), pa.array([total], pa.int64())], names=["b", "n", "total"])

    with small_batches(spark):
        found = texts.mapInArrow(count_words, _SENT).groupBy("b").applyInArrow(store_words, "b int, n long, total long").collect()
    sizes = np.zeros(n, np.int64)
    for r in found:
        if r.b >= 0:
            sizes[r.b] = r.n
    documents = sum(r.total for r in found if r.b < 0)
    end = int(sizes.sum())
    if end >= (1 << 32) - 1:
        raise ValueError("ids of more than 2^32 words do not fit a pair's 64 bits")
    put_array(f"{path}/offsets.npy", np.concatenate([[0], np.cumsum(sizes)]))

    def count_pairs(batches):
        store, parts, size = _Words(path, n), [], 0
        for batch in batches:
            for _, _, hashes, per in _tokens(batch["data"]):
                ids, before, _, _, _ = _sequences(hashes, per, store, end)
                parts.append(np.unique(_pair(before, ids), return_counts=True))
                size += len(parts[-1][0])
                if size > RUN:
                    keys, counts = merged(parts)
                    yield _sent(keys, counts, bucket_of(mixed(keys), n), n)
                    parts, size = [], 0
        keys, counts = merged(parts)
        yield _sent(keys, counts, bucket_of(mixed(keys), n), n)

    def store_pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = key[0].as_py()
        keys, counts = _gathered(batches)
        put_array(f"{path}/pairs-{b}.npy", keys)
        put_array(f"{path}/pair-counts-{b}.npy", lean(counts))
        rows = [(0, 0, b"", pack_counts(np.bincount(np.minimum(counts, 5), minlength=6)))]
        before, first = np.unique(keys >> np.uint64(32), return_index=True)
        facts = [np.add.reduceat(x, first) if len(first) else x for x in (counts, counts == 1, counts == 2, counts >= 3)]
        after, times = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        for kind, ids, values in ((1, before, facts), (2, after, [times])):
            for r in np.unique(ids // np.uint64(RANGE)).tolist():
                i, j = np.searchsorted(ids, np.array([r * RANGE, (r + 1) * RANGE], np.uint64))
                rows.append((kind, r, pack(ids[i:j]), pack_counts(np.concatenate([v[i:j].astype(np.int64) for v in values]))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["kind", "r", "ids", "facts"])

    facts = written(texts.mapInArrow(count_pairs, _SENT).groupBy("b").applyInArrow(store_pairs, "kind int, r int, ids binary, facts binary"), f"{path}/facts")

    def store_facts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, r = key[0].as_py(), key[1].as_py()
        width = {0: 6, 1: 4, 2: 1}[kind]
        table = np.zeros((RANGE if kind else 1, width), np.int64)
        for batch in batches:
            for ids, values in zip(batch["ids"].to_pylist(), batch["facts"].to_pylist()):
                values = unpack_counts(values)
                if kind:
                    table[(unpack(ids) - np.uint64(r * RANGE)).astype(np.int64)] += values.reshape(width, -1).T
                else:
                    table[0] += values
        if kind:
            put_array(f"{path}/{'contexts' if kind == 1 else 'after'}-{r}.npy", table.astype(np.uint32 if table.max() < 1 << 32 else np.int64))
        summed = table[0] if kind == 0 else np.bincount(np.minimum(table[:, 0], 5), minlength=6)
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([int(table[:, 0].sum())], pa.int64()), pa.array([summed.tolist()], pa.list_(pa.int64()))], names=["kind", "total", "levels"])

    levels, total = {0: np.zeros(6, np.int64), 1: np.zeros(6, np.int64), 2: np.zeros(6, np.int64)}, {}
    for row in facts.groupBy("kind", "r").applyInArrow(store_facts, "kind int, total long, levels array<long>").collect():  # a row for each 262,144 words
        levels[row.kind] = levels[row.kind] + np.array(row.levels)
        total[row.kind] = total.get(row.kind, 0) + row.total
    tokens = sum(r.total for r in found)
    pair_discounts, word_discounts = _discounts(*levels[0][1:5].tolist()), _discounts(*levels[2][1:5].tolist())
    pairs = total.get(2, 0)
    many = levels[2][3:].sum()
    spread = sum(d * m for d, m in zip(word_discounts[1:], (levels[2][1], levels[2][2], many))) / pairs if pairs else 1.0
    return Model(path, n, {"tokens": tokens, "end": end, "end_count": documents, "vocabulary": end + (documents > 0), "pairs": pairs, "pair_discounts": pair_discounts, "word_discounts": word_discounts, "spread": float(spread)})


def score(docs: DataFrame, model: Model, extra: list[Column] = ()) -> DataFrame:
    """doc_id, the extra columns (booleans), n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    Null and empty texts are an end only. Unknown words get the lowest order's share for one word not seen. A model of no
    training text gives every token probability 1 / (V + 1) = 1. Repeated rows: a row each.
    """
    path, n, totals = model.path, model.n, json.loads(json.dumps(model.totals))
    names = [f"extra{k}" for k in range(len(extra))]

    def run(batches):
        store, pairs, contexts, after = _Words(path, n), _Pairs(path, n), _ById(path, "contexts", 4), _ById(path, "after", 1)
        big_n, v, end = totals["tokens"], totals["vocabulary"], totals["end"]
        d1, d2 = np.array(totals["word_discounts"]), np.array(totals["pair_discounts"])

        def facts(of, ids):
            distinct, which = np.unique(ids, return_inverse=True)
            return of(np.maximum(distinct, 0))[which] * (ids >= 0)[:, None]

        for batch in batches:
            columns = [[] for _ in range(4)]
            for _, _, hashes, per in _tokens(batch["data"]):
                ids, before, seen, is_end, starts = _sequences(hashes, per, store, end)
                seen[is_end] = totals["end_count"]
                if not totals["end_count"]:
                    ids[:], before[:] = -1, -1
                base = np.log10((seen + 1) / (big_n + v + 1))
                times = facts(after, ids)[:, 0]
                p = np.full(len(ids), totals["spread"] / (v + 1))
                if totals["pairs"]:
                    p += np.maximum(times - d1[np.minimum(times, 3)], 0) / totals["pairs"]
                has = facts(contexts, before)
                follows = has[:, 0] > 0
                both = follows & (ids >= 0)
                keys, which = np.unique(_pair(before[both], ids[both]), return_inverse=True)
                c = np.zeros(len(ids), np.int64)
                c[both] = pairs(keys)[which]
                whole = np.maximum(has[:, 0], 1)
                left = (has[:, 1:] * d2[1:]).sum(axis=1) / whole
                p = np.where(follows, np.maximum(c - d2[np.minimum(c, 3)], 0) / whole + left * p, p)
                for out, x in zip(columns, (np.diff(starts), np.add.reduceat((seen > 0).astype(np.int64), starts[:-1]), np.add.reduceat(base, starts[:-1]), np.add.reduceat(np.log10(p), starts[:-1]))):
                    out.append(x)
            a, b, c, d = (np.concatenate(x) if x else np.zeros(0) for x in columns)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(batch[k] for k in names), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(np.full(len(a), big_n, np.int64)), pa.array(c.astype(np.float64)), pa.array(d.astype(np.float64))],
                names=["doc_id", *names, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("data"), *(c.alias(k) for c, k in zip(extra, names)))
    return rows.mapInArrow(run, "doc_id long, " + "".join(f"{k} boolean, " for k in names) + "n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(rest: int = 2, of: int = 7) -> Column:
    """Whether a document is left out of training: by the CRC-32 of its id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of == rest


def score_documents(docs: DataFrame) -> DataFrame:
    """Trains on the documents that are not held out and scores all."""
    model = train(docs.where(~held_out()))
    return written(score(docs, model, [held_out()]).withColumnRenamed("extra0", "held_out"), f"{model.path}/scores")
