"""What the training-data operators share: the shared folder, text buffers, hashing of byte ranges."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the vectorised kernels take at once. A longer document is a chunk of its own.
CHUNK = 1 << 19


# -- the shared folder -------------------------------------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; where it is unset, one is made for a local master, and others fail."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            base = made.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base if ":" in base.split("/")[0] else "file://" + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20):
    """While this lasts, Arrow batches are bounded by rows and by bytes, so that a worker holds little whatever the texts' lengths. The caller's settings come back."""
    mine = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k, None) for k in mine}
    try:
        for k, v in mine.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """The rows as a table in the shared folder: it cuts the lineage and outlives lost executors. Workers get small batches."""
    with small_batches(df.sparkSession):
        df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def summed(df: DataFrame, *columns: str) -> list[int]:
    """Sums of number columns of all rows; for jobs whose rows are a few for each bucket."""
    with small_batches(df.sparkSession):
        row = df.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in columns]).first()
    return list(row)


def dropped(path: str) -> None:
    """Removes a folder of scratch(), once nothing reads it any more."""
    system, at = fs.FileSystem.from_uri(path)
    if system.get_file_info(at).type != fs.FileType.NotFound:
        system.delete_dir(at)


def put(path: str, data) -> None:
    """Writes a file of the shared folder whole: under another name first, so a task that is run again or lost harms nothing."""
    system, at = fs.FileSystem.from_uri(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    other = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(other) as out:
        out.write(data)
    system.move(other, at)


def put_array(path: str, array: np.ndarray) -> None:
    out = io.BytesIO()
    np.save(out, array)
    put(path, out.getbuffer())


def get_array(path: str) -> np.ndarray:
    """Maps an array of put_array() into memory; a store without local files is read instead."""
    system, at = fs.FileSystem.from_uri(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.load(at, mmap_mode="r")
    with system.open_input_file(at) as f:
        return np.load(io.BytesIO(f.read()))


class Opened:
    """Arrays of the shared folder by name, opened when first asked for. At most `most` stay open: the one asked for longest ago goes first."""

    def __init__(self, path: str, most: int = 256):
        self.path, self.most, self.open = path, most, OrderedDict()

    def __call__(self, name: str) -> np.ndarray | None:
        """None where there is no such array."""
        if name not in self.open:
            while len(self.open) >= self.most:
                self.open.popitem(last=False)
            try:
                self.open[name] = get_array(f"{self.path}/{name}.npy")
            except FileNotFoundError:
                self.open[name] = None
        self.open.move_to_end(name)
        return self.open[name]


class Stored:
    """Rows of longs that stored() wrote, the first of them a key, sorted by key within buckets of the key's leading bits."""

    def __init__(self, path: str, n: int, names: tuple[str, ...] = ("key",), most: int = 256):
        self.n, self.at, self.opened = n, {c: k for k, c in enumerate(names)}, Opened(path, most)

    def find(self, keys: np.ndarray, same: dict[str, np.ndarray] | None = None, value: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked rows (keys: uint64) are there with the same numbers in all named columns, and their value."""
        hit, out = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        order = np.argsort(keys)
        cuts = np.searchsorted(bucket_of(keys[order], self.n), np.arange(self.n + 1))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            rows = self.opened(str(b))
            if rows is None or not rows.shape[1]:
                continue
            known, mine = rows[0].view(np.uint64), order[cuts[b] : cuts[b + 1]]
            at = np.searchsorted(known, keys[mine])
            while len(mine):  # rows of one key stand together
                there = np.flatnonzero(at < len(known))
                mine, at = mine[there], at[there]
                equal = known[at] == keys[mine]
                mine, at = mine[equal], at[equal]
                good = np.ones(len(mine), bool)
                for c, asked in (same or {}).items():
                    good &= rows[self.at[c]][at] == asked[mine]
                hit[mine[good]] = True
                if value:
                    out[mine[good]] = rows[self.at[value]][at[good]]
                mine, at = mine[~good], at[~good] + 1
        return hit, out

    def of(self, key: np.uint64) -> np.ndarray:
        """All rows of one key, a column for each row."""
        rows = self.opened(str(int(bucket_of(np.array([key], np.uint64), self.n)[0])))
        if rows is None:
            return np.zeros((len(self.at), 0), np.int64)
        known = rows[0].view(np.uint64)
        return rows[:, np.searchsorted(known, key) : np.searchsorted(known, key, side="right")]


def bucket_column(key, n: int):
    """bucket_of() as a column."""
    return F.shiftrightunsigned(F.shiftrightunsigned(key, 32) * F.lit(n).cast("long"), 32).cast("int")


def stored(rows: DataFrame, n: int, path: str) -> None:
    """Stores rows of longs, the first column their key, for Stored: a file for each bucket that holds some."""
    names = rows.columns

    def store(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        order = np.argsort(table[names[0]].to_numpy().view(np.uint64), kind="stable")
        put_array(f"{path}/{key[0].as_py()}.npy", np.stack([table[c].to_numpy()[order] for c in names]))
        yield pa.RecordBatch.from_arrays([pa.array([len(order)], pa.int64())], names=["n"])

    summed(rows.withColumn("__bucket", bucket_column(F.col(names[0]), n)).groupBy("__bucket").applyInArrow(store, "n long"), "n")


def buckets(df: DataFrame, each: int = 16 << 20, least: int = 64, most: int = 1 << 16) -> int:
    """How many buckets to deal an input into, by the bytes that Spark's statistics give its files: a bucket's share stays the same up to `most` buckets, a terabyte."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(most, max(least, min(size, 1 << 50) // each))


# -- texts as buffers ----------------------------------------------------------------------------------------


def as_bytes(column: str = "text"):
    """The UTF-8 bytes of a text column; null is empty."""
    return F.expr(f"coalesce(cast(`{column}` as binary), X'')")


def chunks(column: pa.Array, limit: int = CHUNK):
    """Yields (first row, end row, bytes, offsets) over a binary column, without copies; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32


def pieces(column: pa.Array, overlap: int, limit: int = CHUNK):
    """chunks() whose long documents come in pieces, each with the `overlap` bytes that follow it. Yields also where in its document a piece begins."""
    for first, end, data, offsets in chunks(column, limit):
        if len(data) <= 2 * limit:
            yield first, end, 0, data, offsets
            continue
        for at in range(0, max(1, len(data) - overlap), limit):
            part = data[at : at + limit + overlap]
            yield first, end, at, part, np.array([0, len(part)])


def words(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the words of a chunk, and how many each document has."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~SPACES[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = inside[cuts]  # a document's first byte begins a word, whatever stands before it
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return _low[data]


class Rolling:
    """64-bit hashes of any byte range of a chunk, from one running sum of table values times powers of an odd base."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int):
        table = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = self._of(len(data) + 1, seed)
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(table[data] * self.up[: len(data)], out=sums[1:])
        self.sums = sums

    @classmethod
    def _of(cls, n: int, seed: int):
        have = cls._powers.get(seed)
        if have is None or len(have[0]) < n:
            n = max(n, CHUNK + 2)
            base = ((0x9E3779B97F4A7C15 + 0xD1342543DE82EF94 * seed) | 1) & 0xFFFFFFFFFFFFFFFF
            with np.errstate(over="ignore"):
                up = np.full(n, base, np.uint64)
                up[0] = 1
                down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
                down[0] = 1
                have = np.multiply.accumulate(up), np.multiply.accumulate(down)
            if n <= CHUNK + 2:
                cls._powers[seed] = have
        return have

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# -- sorted runs ---------------------------------------------------------------------------------------------

#: Keys that a task gathers before it sends them on.
RUN = 2_000_000


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers as their compressed differences."""
    import zstandard

    gaps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Numbers that are mostly small."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets by the leading bits, so that sorted hashes are sorted by bucket."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def lean(counts: np.ndarray) -> np.ndarray:
    """In the smallest type that holds them."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def repeated(rows: DataFrame, hashes, n: int, path: str, run: int = 400_000) -> None:
    """Stores for Stored the numbers that come more than once in all that hashes(batch) yields (arrays of uint64).

    Tasks send what they have in compressed sorted runs of about `run` numbers, dealt by leading bits.
    """

    def parse(batches):
        def sent(parts):
            keys, counts = merged(parts)
            cuts = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
            out = [(b, pack(keys[i:j]), np.packbits(counts[i:j] > 1).tobytes()) for b, i, j in zip(range(n), cuts, cuts[1:]) if i < j]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 3, (pa.int32(), pa.binary(), pa.binary()))], names=["b", "hashes", "twice"])

        parts, size = [], 0
        for batch in batches:
            for some in hashes(batch):
                parts.append(np.unique(some, return_counts=True))
                size += len(parts[-1][0])
                if size > run:
                    yield sent(parts)
                    parts, size = [], 0
        yield sent(parts)

    def store(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.uint64), [], 0

        def settle():
            nonlocal seen, again, waiting, size
            both = np.sort(np.concatenate([seen, *(h for h, _ in waiting)]))
            again = np.unique(np.concatenate([again, both[1:][both[1:] == both[:-1]], *(h[t] for h, t in waiting)]))
            seen, waiting, size = np.unique(both), [], 0

        for batch in batches:
            for packed, twice in zip(batch["hashes"], batch["twice"]):
                keys = unpack(packed.as_py())
                waiting.append((keys, np.unpackbits(np.frombuffer(twice.as_py(), np.uint8), count=len(keys)).astype(bool)))
                size += len(keys)
                if size > max(1 << 18, len(seen) // 2):
                    settle()
        settle()
        put_array(f"{path}/{key[0].as_py()}.npy", again[None, :].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([len(again)], pa.int64())], names=["n"])

    summed(rows.mapInArrow(parse, "b int, hashes binary, twice binary").groupBy("b").applyInArrow(store, "n long"), "n")


# -- rows by name --------------------------------------------------------------------------------------------


def name_of(docs: DataFrame) -> list:
    """key, id and sub, which name a row: a null doc_id comes after all others, by a hash of the text; sub tells texts under one doc_id apart; key is a hash of both."""
    sub = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    late = F.lit(1 << 62) + sub.bitwiseAND(F.lit((1 << 61) - 1))
    id_ = F.coalesce(F.col("doc_id").cast("long"), late)
    return [F.xxhash64(id_, sub).alias("key"), id_.alias("id"), sub.alias("sub")]


def looked_up(docs: DataFrame, n: int, path: str):
    """A column: what stored() has under path for a row's name (key, id, sub and a number), 0 where it has nothing.

    Only names go to the workers; texts stay where they are.
    """

    @F.pandas_udf(LongType())
    def number(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = Stored(path, n, ("key", "id", "sub", "number"))
        for key, id_, sub in parts:
            _, found = known.find(key.to_numpy().view(np.uint64), {"id": id_.to_numpy(), "sub": sub.to_numpy()}, "number")
            yield pd.Series(found)

    return number(*name_of(docs))
