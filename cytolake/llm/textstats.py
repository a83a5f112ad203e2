"""Counts of every whole text that the quality rules and the quality classifier learn from, made in one pass."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Rolling, as_bytes, chunks, lower, mixed, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent short words of four languages.
FREQUENT = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei de la le et les des en un du une que est pour qui dans par plus pas sur au el los del se las por con una su para es al lo como"
STATS = ["n_bytes", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_stops", "n_other", "n_distinct", "n_frequent", "n_short_lines", "n_bangs", "longest_word"]


def _class(characters: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(characters)] = 1
    return table


_LEADS = (np.arange(256) & 0xC0) != 0x80
_CLASSES = {
    "n_symbols": _class(SYMBOLS.encode()),
    "n_upper": _class(bytes(range(65, 91))),
    "n_lower": _class(bytes(range(97, 123))),
    "n_digits": _class(b"0123456789"),
    "n_stops": _class(b".,;:?"),
    "n_bangs": _class(b"!"),
    "n_other": _class(bytes(range(128, 256))) * _LEADS.astype(np.uint8),
}


def _per(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums over the documents of a chunk."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated_words(hashes: np.ndarray, per: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each document in windows of words that its text holds twice or more."""
    owner = np.repeat(np.arange(len(per)), per)
    n = len(hashes) - window + 1
    marks = np.zeros(len(hashes) + 1, np.int64)
    if n > 0:
        grams = np.zeros(n, np.uint64)
        for k in range(window):
            grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n + k])
        inside = np.flatnonzero(owner[:n] == owner[window - 1 :])
        keys = mixed(grams[inside] ^ mixed(owner[inside].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        at = inside[twice]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + window, -1)
    covered = np.cumsum(marks[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(per))


def _chunk_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, per = words(data, offsets)
    owner = np.repeat(np.arange(len(per)), per)
    out = {"n_bytes": np.diff(offsets), "n_words": per}
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    out["word_chars"] = _per(_LEADS[data] & (np.cumsum(inside[:-1], dtype=np.int8) > 0), offsets)
    for name, table in _CLASSES.items():
        out[name] = _per(table[data], offsets)
    hashes = Rolling(data, 3).of(starts, ends)
    out["n_repeat_words"] = repeated_words(hashes, per)
    longest = np.zeros(len(per), np.int64)
    np.maximum.at(longest, owner, ends - starts)
    out["longest_word"] = longest
    small = Rolling(lower(data), 3).of(starts, ends)
    keys = np.unique(mixed(small ^ mixed(owner.astype(np.uint64) + np.uint64(1))) if len(small) else small, return_index=True)[1]
    out["n_distinct"] = np.bincount(owner[keys], minlength=len(per))
    out["n_frequent"] = np.bincount(owner[np.isin(small, _frequent())], minlength=len(per))
    lines, dups, short = [], [], []
    raw = data.tobytes()
    for at, end in zip(offsets.tolist(), offsets[1:].tolist()):
        with_words = [x for x in raw[at:end].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        lines.append(len(with_words))
        dups.append(len(with_words) - len(set(with_words)))
        short.append(sum(len(x) < 20 for x in with_words))
    return out | {"n_lines": np.array(lines), "n_dup_lines": np.array(dups), "n_short_lines": np.array(short)}


def _frequent() -> np.ndarray:
    known = [np.frombuffer(w.encode(), np.uint8) for w in sorted(set(FREQUENT.split()))]
    return np.array([Rolling(w, 3).of(np.array([0]), np.array([len(w)]))[0] for w in known])


def text_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep and STATS (long) of every row. Null texts count nothing."""

    def run(batches):
        for batch in batches:
            parts = [_chunk_stats(data, offsets) for _, _, data, offsets in chunks(batch["__data"])]
            columns = [np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in STATS]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *map(pa.array, columns)], names=[*keep, *STATS])

    rows = docs.select(*[F.col(c).cast("long").alias(c) for c in keep], as_bytes().alias("__data"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in (*keep, *STATS)))


def _share(a: str, b: str) -> str:
    """Of doubles; 0 where there is nothing to divide by."""
    return f"coalesce(try_divide(cast({a} as double), cast({b} as double)), 0D)"


#: What is learned from, as SQL expressions over STATS.
FEATURES = {
    "symbols_per_word": _share("n_symbols", "n_words"),
    "dup_lines_share": _share("n_dup_lines", "n_lines"),
    "repeats_share": _share("n_repeat_words", "n_words"),
    "chars_per_word": _share("word_chars", "n_words"),
    "upper_share": _share("n_upper", "word_chars"),
    "lower_share": _share("n_lower", "word_chars"),
    "digits_share": _share("n_digits", "word_chars"),
    "stops_per_word": _share("n_stops", "n_words"),
    "bangs_per_word": _share("n_bangs", "n_words"),
    "other_share": _share("n_other", "word_chars"),
    "distinct_share": _share("n_distinct", "n_words"),
    "frequent_share": _share("n_frequent", "n_words"),
    "words_per_line": _share("n_words", "n_lines"),
    "short_lines_share": _share("n_short_lines", "n_lines"),
    "log_words": "log1p(cast(n_words as double))",
    "log_longest": "log1p(cast(longest_word as double))",
}
