"""Media columns: payloads in tar shards, addressed by content; rows carry digest, offset and length.

Each task packs its texts as 8-bit greyscale PNG images, WIDTH samples wide, into tar shards of the shared folder; a
payload that the task has met already is not packed again. Of the places of one digest, the first by shard and offset is
the one that all rows point to. Metadata columns come from range reads of the image headers only; the samples are read
back from the shards once for each distinct digest.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import tarfile
import zlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, buckets, scratch, written

WIDTH, SHARD = 192, 128 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature, and the header chunk with its length, name and checksum.
HEADER = 8 + 12 + 13


def padded(data: bytes) -> bytes:
    """Spaces up to a positive multiple of WIDTH."""
    return data + b" " * (-len(data) % WIDTH or WIDTH * (not data))


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def to_image(payload: bytes) -> bytes:
    """A PNG whose samples are the payload."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row has filter type 0 in front
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 2)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample, from the first HEADER bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not an image's header")
    return struct.unpack(">IIB", data[16:25])


def samples(image: bytes) -> bytes:
    """The samples of an image of to_image()."""
    width, height, bits = header(image[:HEADER])
    at, body = 8, []
    while at < len(image):
        size, name = struct.unpack(">I4s", image[at : at + 8])
        if name == b"IDAT":
            body.append(image[at + 8 : at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if bits != 8 or rows[:, 0].any():
        raise ValueError("only unfiltered 8-bit samples are read")
    return rows[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """Mean and deviation of the samples, and which of 64 cells of the image are lighter than the mean."""
    x = np.frombuffer(data, np.uint8)
    cells = [c.mean() if len(c) else 0 for c in np.array_split(x, 64)]
    light = np.packbits(np.array(cells) > x.mean()).tobytes().hex()
    return f"{x.mean():.4f}/{x.std():.4f}/{light}"


class _Shards:
    """Tar shards of one task. A task that is run again writes shards of its own; rows only name those of the task that is kept."""

    def __init__(self, path: str):
        task = TaskContext.get()
        self.path, self.name, self.made = path, f"{task.partitionId()}-{task.taskAttemptId()}", 0
        self.system, self.at = fs.FileSystem.from_uri(path)
        self.system.create_dir(self.at, recursive=True)
        self.out = None

    def add(self, name: str, data: bytes) -> tuple[str, int, int]:
        """Shard, offset and length of the member's data."""
        if self.out is None or self.tar.offset + len(data) > SHARD and self.tar.offset:
            self.close()
            self.shard = f"{self.name}-{self.made}.tar"
            self.made += 1
            self.out = self.system.open_output_stream(f"{self.at}/{self.shard}")
            self.tar = tarfile.open(fileobj=self.out, mode="w|", format=tarfile.USTAR_FORMAT)
        info = tarfile.TarInfo(name)
        info.size = len(data)
        at = self.tar.offset + tarfile.BLOCKSIZE
        self.tar.addfile(info, io.BytesIO(data))
        return self.shard, at, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.tar.close()
            self.out.close()
            self.out = None


class _Reader:
    """Range reads of shards; keeps a few files open."""

    def __init__(self, path: str):
        self.system, self.at = fs.FileSystem.from_uri(path)
        self.open = OrderedDict()

    def __call__(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self.open:
            if len(self.open) >= 16:
                self.open.popitem(last=False)[1].close()
            self.open[shard] = self.system.open_input_file(f"{self.at}/{shard}")
        self.open.move_to_end(shard)
        return self.open[shard].read_at(length, offset)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def pack(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length: every row's payload in the shards under path."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]

    def run(batches):
        shards, met = _Shards(path), {}
        try:
            for batch in batches:
                rows = []
                for doc, raw in zip(batch["doc_id"].to_pylist(), batch["data"]):
                    raw = raw.as_py()
                    payload = padded(raw)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in met:
                        if len(met) > 200_000:
                            met.clear()
                        met[digest] = shards.add(digest.hex() + ".png", to_image(payload))
                    rows.append((doc, len(raw), digest.hex(), *met[digest]))
                yield _batch(rows, fields)
        finally:
            shards.close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("data")).mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")


def probe(places: DataFrame, path: str) -> DataFrame:
    """Adds width, height and bits to rows (digest, shard, offset, length), from the headers alone."""
    fields = [("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("bits", pa.int64())]

    def run(batches):
        read = _Reader(path)
        for batch in batches:
            rows = list(zip(*(batch[n].to_pylist() for n, _ in fields[:4])))
            yield _batch([(*r, *header(read(r[1], r[2], HEADER))) for r in rows], fields)

    return places.mapInArrow(run, "digest string, shard string, offset long, length long, width long, height long, bits long")


def features(places: DataFrame, path: str) -> DataFrame:
    """Per digest: what reading the stored bytes back gives."""
    fields = [("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    fields += [("width", pa.int64()), ("height", pa.int64())]

    def run(batches):
        read = _Reader(path)
        for batch in batches:
            rows = []
            for digest, shard, offset, length, width, height in zip(*(batch[n].to_pylist() for n in ("digest", "shard", "offset", "length", "width", "height"))):
                image = read(shard, offset, length)
                data = samples(image)
                rows.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(data), width, height))
            yield _batch(rows, fields)

    return places.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long")


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height, digest, shard, offset, length.

    Null and empty texts: one row of spaces. Equal payloads are stored once for a task at least and pointed to as one.
    Repeated rows: a row each. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    root = scratch(spark, "media")
    shards = f"{root}/shards"
    rows = written(pack(docs, shards), f"{root}/rows")
    places = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.shard", "at.offset", "at.length")
    probed = written(probe(places, shards), f"{root}/places")
    # a task for each few megabytes of media, however small the rows that name them
    tasks = buckets(docs, each=8 << 20, least=int(spark.conf.get("spark.sql.shuffle.partitions")))
    told = written(features(probed.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset"), shards), f"{root}/features")
    known = told.join(probed.select("digest", "shard", "offset", "length"), "digest")
    return rows.select("doc_id", "n_bytes", "digest").join(known, "digest")


def members(path: str) -> list[str]:
    """Names in the shards under a local path; for a look at small outputs."""
    at = fs.FileSystem.from_uri(path)[1]
    return [m.name for f in sorted(os.listdir(at)) for m in tarfile.open(f"{at}/{f}").getmembers()]
