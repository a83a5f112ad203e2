"""Token ids as length-delimited binary records in shards, with an offset index for reads in any order.

A shard is a sequence of frames: the payload's length (8 bytes), the length's masked checksum (4), the payload, and the
payload's masked checksum (4); all little-endian. The frame is that of the TFRecord format, but its checksum is CRC-32 (zlib's) instead
of CRC-32C; it is masked likewise, rotated by 15 bits and added to a constant, as a checksum of bytes that hold checksums is weak.
A payload is doc_id (8 bytes, signed), whether there is one (1 byte), the bytes of an id (1 byte: 2 or 4), and the ids.

Rows are dealt to tasks by ranges of doc_id, so shards in their order hold ascending documents. A shard is written as a
stream and belongs to one attempt of a task; only those of the attempts that are kept are named by the index. The index is
a table beside the shards: where each record is, and how many ids all records before it hold.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import as_bytes, buckets, chunks, dropped, mixed, scratch, written

#: The id after each document, by the contract.
END = 0
#: Bytes of frames after which a task begins another shard.
SHARD = 256 << 20
#: Bytes, about, of the stretches of text that a worker remembers.
PIECES = 160 << 20
_MASK = 0xA282EAD8
_HEAD, _FOOT, _DOC = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<q?B")


# -- frames --------------------------------------------------------------------------------------------------------


def masked(data: bytes) -> int:
    """The checksum of bytes, rotated and shifted."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return size + _FOOT.pack(masked(size)) + payload + _FOOT.pack(masked(payload))


def unframe(data: bytes) -> bytes:
    """The payload of one whole frame. A frame that is cut, has other bytes behind it or fails a checksum raises ValueError."""
    if len(data) < _HEAD.size + _FOOT.size:
        raise ValueError("a record is cut")
    size, check = _HEAD.unpack_from(data)
    if masked(data[:8]) != check:
        raise ValueError("a record's length is damaged")
    if size != len(data) - _HEAD.size - _FOOT.size:
        raise ValueError("a record has another length than its frame says")
    payload = data[_HEAD.size : _HEAD.size + size]
    if masked(payload) != _FOOT.unpack_from(data, _HEAD.size + size)[0]:
        raise ValueError("a record's payload is damaged")
    return payload


def frames(stream) -> Iterator[bytes]:
    """The payloads of a shard that is read from its beginning, one in memory at a time; it needs no index."""
    while head := stream.read(_HEAD.size):
        if len(head) < _HEAD.size:
            raise ValueError("a record is cut")
        size, check = _HEAD.unpack(head)
        if masked(head[:8]) != check:
            raise ValueError("a record's length is damaged")
        yield unframe(head + stream.read(size + _FOOT.size))


def to_payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """ids: packed, `width` bytes each."""
    return _DOC.pack(doc_id or 0, doc_id is not None, width) + ids


def from_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id, and the ids as little-endian unsigned 32-bit integers."""
    doc_id, there, width = _DOC.unpack_from(payload)
    return (doc_id if there else None), np.frombuffer(payload, f"<u{width}", offset=_DOC.size).astype("<u4")


# -- shards --------------------------------------------------------------------------------------------------------


class _Shards:
    """The shards of one attempt of a task, in the order of their names."""

    def __init__(self, path: str, size: int):
        self.path, self.size, self.name, self.made = path, size, f"{TaskContext.get().partitionId():08d}", 0
        self.attempt = uuid.uuid4().hex
        self.system, self.at = fs.FileSystem.from_uri(path)
        self.system.create_dir(self.at, recursive=True)
        self.out, self.offset = None, 0

    def add(self, data: bytes) -> tuple[str, int]:
        """The shard and the offset that the bytes went to."""
        if self.out is None or self.offset and self.offset + len(data) > self.size:
            self.close()
            self.shard = f"{self.name}-{self.made:06d}-{self.attempt}.rec"
            self.made += 1
            self.out, self.offset = self.system.open_output_stream(f"{self.at}/{self.shard}"), 0
        self.out.write(data)
        self.offset += len(data)
        return self.shard, self.offset - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class _Reader:
    """Range reads; keeps a few shards open."""

    def __init__(self, path: str, most: int = 16):
        (self.system, self.at), self.most, self.open = fs.FileSystem.from_uri(path), most, OrderedDict()

    def __call__(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self.open:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            self.open[shard] = self.system.open_input_file(f"{self.at}/{shard}")
        self.open.move_to_end(shard)
        return self.open[shard].read_at(length, offset)


#: Characters that some library or other takes for white space.
_BLANK = "\\s\u180e\u200b-\u200f\ufeff"


def cuttable(path: str) -> bool:
    """Whether a text may be cut before a space that follows something else than white space, without a change of its ids: byte-level merges within the matches of the usual pattern, and no added token that has spaces or takes those around it."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    split, model = made.get("pre_tokenizer") or {}, made["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    own = model.get("type") == "BPE" and not model.get("dropout") and not any(made.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
    return plain and own and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(f"[{_BLANK}]", a["content"]) for a in made["added_tokens"])


#: Of a byte: 1 letter, 2 digit, 3 other sign, 0 what is not printable ASCII or is a space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
#: The lowest k bytes of a number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def cuts(data: np.ndarray) -> np.ndarray:
    """Where UTF-8 text may be cut, as a mask of the bytes before which no match of the usual pattern goes on.

    These are: a space or line end after something that is not white space; what follows a line end that is the only white space; and
    a letter, digit or other sign after one of another kind, all ASCII, but for letters after an apostrophe.
    """
    kind, line = _CLASS[data], data == 0x0A
    solid = kind > 0  # a character ends here that no library takes for white space; of others than ASCII, some are left out
    high = np.flatnonzero(data >= 0x80)
    one, two, three = (data[np.maximum(high - k, 0)] for k in range(3))
    dash = (two == 0x80) & ((one >= 0x90) & (one <= 0xA7) | (one >= 0xB0) & (one <= 0xBE))
    solid[high] = (two >= 0xC3) & (two <= 0xDF) | (two >= 0x80) & (two < 0xC0) & ((three >= 0xE4) & (three <= 0xEE) | (three == 0xE3) & (two != 0x80) | (three == 0xE2) & dash)
    out = np.zeros(len(data), bool)
    out[1:] = solid[:-1] & (line | (data == 0x20))[1:]
    out[2:] |= line[1:-1] & solid[:-2] & (kind[2:] > 0)
    out[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & ~((data[:-1] == 0x27) & (kind[1:] == 1))
    return out


class _Known:
    """Ids of stretches of text. Those of up to 23 bytes are found in an open table by these bytes themselves, all of a chunk at once."""

    def __init__(self, kind: str):
        self.kind = kind
        self.forget()

    def forget(self) -> None:
        self.slots, self.keys = np.full(1 << 16, -1, np.int32), np.zeros((1 << 15, 3), np.uint64)
        self.at, self.count, self.pool = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64), np.zeros(1 << 17, self.kind)
        self.rows, self.used, self.size, self.long = 0, 0, 0, {}

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return mixed(keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[:, 2] * np.uint64(0x165667B19E3779F9)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rows of keys, -1 for unknown ones."""
        out, left, mask = np.full(len(keys), -1, np.int64), np.arange(len(keys)), len(self.slots) - 1
        at = self.slot(keys) & mask
        while len(left):
            row = self.slots[at]
            there = np.flatnonzero(row >= 0)
            left, at, row = left[there], at[there], row[there]
            same = (self.keys[row] == keys[left]).all(axis=1)
            out[left[same]] = row[same]
            left, at = left[~same], at[~same] + 1 & mask
        return out

    def place(self, rows: np.ndarray) -> None:
        """Enters rows, whose keys are new, into the table."""
        mask = len(self.slots) - 1
        at = self.slot(self.keys[rows]) & mask
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]
            lost = self.slots[at] != rows
            rows, at = rows[lost], at[lost] + 1 & mask

    def add(self, keys: np.ndarray, stretches: list[bytes], ids: list[list[int]]) -> None:
        """Makes stretches known; those without a key (its last number is 0) by their bytes."""
        n, sizes = len(ids), np.array([len(i) for i in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), self.kind, int(sizes.sum()))
        while self.rows + n > len(self.at):
            self.keys, self.at, self.count = np.concatenate([self.keys, np.zeros_like(self.keys)]), np.tile(self.at, 2), np.tile(self.count, 2)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.tile(self.pool, 2)
        rows = np.arange(self.rows, self.rows + n)
        self.keys[rows], self.count[rows], self.at[rows] = keys, sizes, self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(flat)] = flat
        self.rows, self.used, self.size = self.rows + n, self.used + len(flat), self.size + 64 * n + 2 * len(flat)
        brief = keys[:, 2] > 0
        for k in np.flatnonzero(~brief).tolist():
            self.long[stretches[k]] = int(rows[k])
        if 2 * self.rows > len(self.slots):
            self.slots, rows = np.full(4 * len(self.slots), -1, np.int32), np.arange(self.rows)
            brief = self.keys[rows, 2] > 0
        self.place(rows[brief])


class Encoder:
    """Texts to packed ids by a file of the tokenizers library: 2 bytes an id where the vocabulary allows it, else 4."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are what runs side by side
        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.cuts = cuttable(path)
        self.added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known(f"<u{self.width}")

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def whole(self, texts: list[str]) -> list[bytes]:
        """As the library has them."""
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Where the tokenizer lets texts be cut, what stands between two cuts is encoded once."""
        if not self.cuts:
            return self.whole(texts)
        special = [any(a in text for a in self.added) for text in texts]
        out = []
        for _, _, data, offsets in chunks(pa.array([b"" if s else text.encode() for s, text in zip(special, texts)], pa.large_binary())):
            out += self.put_together(data, offsets)
        for k, s in enumerate(special):
            if s:
                out[k] = self.whole([texts[k]])[0]
        return out

    def put_together(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The packed ids of a chunk of texts."""
        if not len(data):
            return [b""] * (len(offsets) - 1)
        if self.known.size > PIECES:
            self.known.forget()
        mask = cuts(data)
        mask[offsets[offsets < len(data)]] = True
        starts = np.flatnonzero(mask)
        sizes = np.diff(starts, append=len(data))
        padded = np.append(data, np.zeros(24, np.uint8))
        number = np.ndarray((len(data) + 17,), "<u8", padded, strides=(1,))
        brief = sizes < 24
        keys = np.stack([number[np.minimum(starts + k, len(data))] & _LOW[np.clip(sizes - k, 0, 8)] for k in (0, 8, 16)], axis=1)
        keys[:, 2] |= sizes.astype(np.uint64) << np.uint64(56)
        keys[~brief] = 0
        row = np.full(len(starts), -1, np.int64)
        row[brief] = self.known.find(keys[brief])
        raw = data.tobytes()
        lost = np.flatnonzero(row < 0)
        if len(lost):
            stretches = [raw[a : a + n] for a, n in zip(starts[lost].tolist(), sizes[lost].tolist())]
            new = {s: k for s, k in zip(stretches, lost.tolist()) if s not in self.known.long}
            if new:
                self.known.add(keys[list(new.values())], list(new), [e.ids for e in self.tokenizer.encode_batch_fast([s.decode() for s in new], add_special_tokens=False)])
            some = brief[lost]
            row[lost[some]] = self.known.find(keys[lost[some]])
            row[lost[~some]] = [self.known.long[s] for s, short in zip(stretches, some.tolist()) if not short]
        count = self.known.count[row]
        ends = np.append(0, np.cumsum(count))
        ids = self.known.pool[np.repeat(self.known.at[row] - ends[:-1], count) + np.arange(ends[-1])].tobytes()
        bounds = (ends[np.searchsorted(starts, offsets)] * self.width).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_WRITTEN = pa.schema([("doc_id", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("ids", pa.int64())])


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, end: int | None = END, shard: int = SHARD) -> DataFrame:
    """Writes the ids of every text, each followed by `end` unless it is None, as shards under path/shards. Returns the index, stored under path/index.

    The index: doc_id, shard, offset, length (of the frame, in bytes), ids (how many) and start (the ids of all records before).
    Records ascend by doc_id, null first, then by a hash of the text. Null and empty texts have no ids but `end`. Repeated
    rows are records of their own. Other columns are neither read nor written. An empty table has an empty index.
    """
    spark = docs.sparkSession
    tokenizer, shards = tokenizer or default_tokenizer(), f"{path}/shards"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = Encoder.of(tokenizer), _Shards(shards, shard)
        last = b"" if end is None else encode.pack([end])
        try:
            for batch in batches:
                rows = []
                texts = [raw.as_py().decode("utf-8", "replace") for raw in batch["data"]]
                for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(texts)):
                    data = frame(to_payload(doc_id, ids + last, encode.width))
                    rows.append((doc_id, *out.add(data), len(data), len(ids + last) // encode.width))
                yield _batch(rows, _WRITTEN)
        finally:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("data"))
    rows = rows.withColumns({"hash": F.xxhash64("data"), "row": F.monotonically_increasing_id()})  # row: so that equal rows are no one task's
    keys = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    tasks = buckets(docs, each=32 << 20, least=int(spark.conf.get("spark.sql.shuffle.partitions")), most=1 << 30)
    ranges = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).select("doc_id", "data")
    places = written(ranges.mapInArrow(write, "doc_id long, shard string, offset long, length long, ids long"), f"{path}/places")
    # a shard's records in their order, and the shards' in theirs: no task orders more than a shard's or one row of each shard
    sums = places.groupBy("shard").agg(F.sum("ids").alias("held"))
    before = sums.select("shard", F.coalesce(F.sum("held").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("ids").over(Window.partitionBy("shard").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = written(places.withColumn("start", within).join(before, "shard").select(*_WRITTEN.names, (F.col("before") + F.col("start")).alias("start")), f"{path}/index")
    dropped(f"{path}/places")
    return index


def stored_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of what write_records() left under a path."""
    return spark.read.parquet(f"{path}/index")


_READ = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]


def read_records(index: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, and with keep_ids the ids, of the index's records, in its order and partitions; all but start from the records themselves.

    A damaged record fails. The checksum is that of the ids as little-endian unsigned 32-bit integers.
    """
    schema = pa.schema(_READ + ([("ids", pa.list_(pa.int64()))] if keep_ids else []))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _Reader(f"{path}/shards")
        for batch in batches:
            rows = []
            for shard, offset, length, start in zip(*(batch[c].to_pylist() for c in ("shard", "offset", "length", "start"))):
                doc_id, ids = from_payload(unframe(at(shard, offset, length)))
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), *([ids] if keep_ids else [])))
            yield _batch(rows, schema)

    return index.select("shard", "offset", "length", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else ""))


def in_file_order(index: DataFrame) -> DataFrame:
    """The index by ranges of shard and offset, so that each task reads its shards forward."""
    return index.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")


def shuffled(index: DataFrame, seed: int) -> DataFrame:
    """The index in an order that the seed gives: only places are sorted, no records."""
    mixed = F.xxhash64(F.lit(seed).cast("long"), "shard", "offset")
    return index.repartitionByRange(mixed).sortWithinPartitions(mixed)


def token_records(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the records that were written. The shards and the index are left under `path`."""
    path = path or scratch(docs.sparkSession, "records")
    return written(read_records(in_file_order(write_records(docs, path, tokenizer)), path), f"{path}/read")
