"""FASTA, FASTQ and numbered lines as Python data sources that read a file by byte ranges, many tasks a file.

Each range gives what belongs to it: a FASTA header to the range that holds its >, bases to the range that holds their bytes,
a FASTQ record or a line to the range that holds its first byte. What a range cannot know, how many bases, records or lines stand before it, comes from
a first pass that only counts (a row for each range and header), summed up by windows over these rows.
Compressed files (.gz, .zst, .bz2) cannot be entered in the middle: each is one range, read as a stream.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, of one read, bases of a row, and the longest header.
RANGE, BLOCK, ROW, LINE = 64 << 20, 4 << 20, 1 << 16, 1 << 16
_PACKED = (".gz", ".zst", ".bz2")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, of a path or a URI."""
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else os.path.abspath(path))


def files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """Name and size of the file at path, or of the files in that folder that end with suffix (or that and a packed form's)."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    inside = [i for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File]
    fits = lambda name: not name.startswith((".", "_")) and name.endswith(tuple(suffix + p for p in ("", *_PACKED)))
    return sorted((i.path, i.size) for i in inside if fits(i.base_name))


@dataclass
class ByteRange(InputPartition):
    file: str
    number: int
    low: int
    high: int


class _Bytes:
    """A file's bytes from a place on, in blocks."""

    def __init__(self, system: fs.FileSystem, r: ByteRange):
        self.packed = r.file.endswith(_PACKED)
        self.file = system.open_input_stream(r.file, compression="detect") if self.packed else system.open_input_file(r.file)

    def blocks(self, at: int, size: int = BLOCK) -> Iterator[bytes]:
        if not self.packed:
            self.file.seek(at)
        while data := self.file.read(size):
            yield data

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


class _Reader(DataSourceReader):
    """Plans ranges; counting readers leave out the contents."""

    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.size = int(options.get("range", RANGE))
        self.counting = options.get("counting", "false") == "true"

    def partitions(self) -> list[ByteRange]:
        out = []
        for name, size in files(self.path, self.suffix):
            step = max(size, 1) if name.endswith(_PACKED) else self.size
            out += [ByteRange(name, k, low, min(size, low + step)) for k, low in enumerate(range(0, size, step))]
        return out or [ByteRange("", 0, 0, 0)]

    def read(self, r: ByteRange) -> Iterator[pa.RecordBatch]:
        if r.file:
            with _Bytes(opened(self.path)[0], r) as data:
                yield from self.rows(data, r)


# -- FASTA ---------------------------------------------------------------------------------------------------------


class FastaReader(_Reader):
    """file, range, part, name, at, n, seq: a row with the name for each header, part by part of the range, and the bases in rows of ROW, `at` bases into the part.

    Counting: a row for each part, with the name (null where the part goes on) and how many bases it has in the range.
    """

    def rows(self, data: _Bytes, r: ByteRange) -> Iterator[pa.RecordBatch]:
        part, at, name = 0, 0, None
        out = []
        for kind, value in self.pieces(data, r):
            if kind == "name":
                if self.counting:
                    yield self.batch(r, [(part, name, 0, at, None)])
                part, at, name = part + 1, 0, value
                if not self.counting:
                    out.append((part, name, 0, 0, None))
            elif self.counting:
                at += len(value)
            else:
                for k in range(0, len(value), ROW):
                    some = value[k : k + ROW]
                    out.append((part, None, at, len(some), some))
                    at += len(some)
                yield self.batch(r, out)
                out = []
        if self.counting:
            yield self.batch(r, [(part, name, 0, at, None)])
        elif out:
            yield self.batch(r, out)

    def batch(self, r: ByteRange, rows: list[tuple]) -> pa.RecordBatch:
        part, name, at, n, seq = zip(*rows)
        arrays = [pa.array([r.file] * len(rows)), pa.array([r.number] * len(rows), pa.int64()), pa.array(part, pa.int64()), pa.array(name, pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(seq, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "range", "part", "name", "at", "n", "seq"])

    def pieces(self, data: _Bytes, r: ByteRange) -> Iterator[tuple[str, str | bytes]]:
        """("name", a header's name) and ("seq", bases) of a range."""
        begins, head = True, b""  # whether a line begins; the header line that is being read
        if r.low and not data.packed:
            begins, inside = self.before(data, r)
            head = b">" if inside else b""
        mine = not head  # a header that another range has begun is only read to its end
        at = r.low
        for block in data.blocks(r.low):
            k = 0
            while k < len(block):
                past = not data.packed and at + k >= r.high
                if head:
                    end = block.find(b"\n", k)
                    head += block[k : end if end >= 0 else len(block)]
                    if len(head) > LINE:
                        raise ValueError(f"a header of {r.file} is longer than {LINE} bytes")
                    k = end + 1 if end >= 0 else len(block)
                    if end >= 0:
                        if mine:
                            yield "name", self.name(head)
                        head, begins, mine = b"", True, True
                    continue
                if past:
                    return
                if begins and block[k : k + 1] == b">":
                    head = b">"
                    k += 1
                    continue
                next_ = block.find(b"\n>", k)
                end = len(block) if next_ < 0 else next_ + 1
                if not data.packed:
                    end = min(end, r.high - at)
                some = block[k:end]
                bases = some.translate(None, b" \t\r\n\v\f")
                if bases:
                    yield "seq", bases
                begins, k = some.endswith(b"\n"), end
            at += len(block)
            if not data.packed and at >= r.high and not head:
                return
        if head and mine:
            yield "name", self.name(head)

    def before(self, data: _Bytes, r: ByteRange) -> tuple[bool, bool]:
        """Whether the range begins with a line, and whether it begins within a header. A line of bases may be as long as it likes."""
        low = max(0, r.low - LINE - 1)
        data.file.seek(low)
        tail = data.file.read(r.low - low)
        line = tail[tail.rfind(b"\n") + 1 :]
        whole = b"\n" in tail or low == 0
        return whole and not line, whole and line.startswith(b">")

    def name(self, head: bytes) -> str:
        return re.split(r"\s", head[1:].decode(), maxsplit=1)[0]


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return "file string, range long, part long, name string, at long, n long, seq binary"

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


def _source(spark: SparkSession, kind: type[DataSource], path: str, **options: str) -> DataFrame:
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).options(path=path, **options).load()


def _fail(bad: Column, message: Column) -> Column:
    return F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))


def _parts(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """file, range, part, chrom and start: which chromosome each part is of, and how many of its bases stand before. Names that come twice, and bases without one, fail."""
    counts = _source(spark, FastaSource, path, counting="true", **options).select("file", "range", "part", "name", "n")
    order = Window.partitionBy("file").orderBy("range", "part")
    named = counts.withColumn("record", F.count("name").over(order)).withColumn("chrom", F.last("name", ignorenulls=True).over(order))
    inside = Window.partitionBy("file", "record").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    t = named.withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0))).where("n > 0 or name is not null")
    t = t.withColumn("times", F.count("name").over(Window.partitionBy("chrom")))
    t = t.where(_fail(F.col("chrom").isNull(), F.concat(F.lit("bases before the first header of "), "file")))
    t = t.where(_fail(F.col("times") > 1, F.concat(F.lit("several sequences are named "), "chrom")))
    return t.select("file", "range", "part", "chrom", "start")


def genome_chunks(spark: SparkSession, path: str, suffix: str = "", size: int = RANGE) -> DataFrame:
    """chrom, start, seq (binary): the bases of FASTA files in rows of at most ROW, each with its place. Sequences without bases have no row."""
    options = {"suffix": suffix, "range": str(size)}
    rows = _source(spark, FastaSource, path, **options).where("seq is not null")
    return rows.join(_parts(spark, path, options), ["file", "range", "part"]).select("chrom", (F.col("start") + F.col("at")).alias("start"), "seq")


def read_genome(spark: SparkSession, path: str, suffix: str = "", size: int = RANGE) -> DataFrame:
    """A genome of FASTA files as pieces (chrom, piece, before, seq), the form that the operators on genomes take: no row holds a chromosome.

    path: a file, or a folder whose files end with suffix. A name ends at the first white space; names that come twice fail,
    and so do bases before the first header. Letters become capitals. A piece's bases come from few chunks and meet by its number.
    """
    from ..operators.reads import PIECE

    c = genome_chunks(spark, path, suffix, size).withColumn("end", F.col("start") + F.octet_length("seq"))
    # each chunk's share of the pieces that it reaches, with two bases more on either side
    touched = F.sequence(F.expr(f"greatest(0, start - 2) div {PIECE}"), F.expr(f"(end + 1) div {PIECE}"))
    t = c.withColumn("piece", F.explode(touched))
    low, high = F.greatest(F.col("start"), F.col("piece") * PIECE - 2), F.least(F.col("end"), (F.col("piece") + 1) * PIECE + 2)
    t = t.select("chrom", "piece", low.alias("low"), high.alias("high"), F.substring(F.col("seq"), (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).cast("string").alias("s"))
    t = t.groupBy("chrom", "piece").agg(F.array_sort(F.collect_list(F.struct("low", "s"))).alias("parts"), F.max("high").alias("high"))
    whole = F.upper(F.array_join("parts.s", "")).cast("binary")
    return t.where(F.col("high") > F.col("piece") * PIECE).select("chrom", F.col("piece").cast("int").alias("piece"), F.when(F.col("piece") > 0, 2).otherwise(0).alias("before"), whole.alias("seq"))


def chromosome_sizes(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """chrom, size of the sequences of FASTA files, by a pass that only counts; those without bases too."""
    options = {"suffix": suffix}
    counts = _source(spark, FastaSource, path, counting="true", **options).select("file", "range", "part", "n")
    return counts.join(_parts(spark, path, options), ["file", "range", "part"]).groupBy("chrom").agg(F.sum("n").alias("size"))


# -- lines and FASTQ -------------------------------------------------------------------------------------------------


def _lines(data: _Bytes, at: int) -> Iterator[tuple[int, bytes]]:
    """Lines with where they begin, from a place on."""
    rest = b""
    for block in data.blocks(at):
        *some, rest = (rest + block).split(b"\n")
        for line in some:
            yield at, line.removesuffix(b"\r")
            at += len(line) + 1
    if rest:
        yield at, rest.removesuffix(b"\r")


def _lines_after(data: _Bytes, r: ByteRange) -> Iterator[tuple[int, bytes]]:
    """The lines that begin in a range or later."""
    if not r.low or data.packed:
        return _lines(data, 0)
    lines = _lines(data, r.low - 1)
    next(lines, None)  # the rest of the line that holds the byte before
    return lines


class _Counted(_Reader):
    """file, range, k and columns: what begins in the range, k of which stand before. Counting: one row, with how many there are as k."""

    columns: tuple[str, ...]

    def found(self, data: _Bytes, r: ByteRange) -> Iterator[tuple]:
        raise NotImplementedError

    def rows(self, data: _Bytes, r: ByteRange) -> Iterator[pa.RecordBatch]:
        rows, size, k = [], 0, 0
        for one in self.found(data, r):
            k += 1
            if not self.counting:
                rows.append((k - 1, *one))
                size += sum(map(len, one))
                if size > BLOCK or len(rows) >= 10_000:
                    yield self.batch(r, rows)
                    rows, size = [], 0
        yield self.batch(r, [(k, *[None] * len(self.columns))] if self.counting else rows)

    def batch(self, r: ByteRange, rows: list[tuple]) -> pa.RecordBatch:
        k, *values = zip(*rows) if rows else [()] * (1 + len(self.columns))
        arrays = [pa.array([r.file] * len(rows), pa.string()), pa.array([r.number] * len(rows), pa.int64()), pa.array(k, pa.int64()), *[pa.array(v, pa.string()) for v in values]]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "range", "k", *self.columns])


class LineReader(_Counted):
    columns = ("value",)

    def found(self, data: _Bytes, r: ByteRange) -> Iterator[tuple[str]]:
        for at, line in _lines_after(data, r):
            if not data.packed and at >= r.high:
                return
            yield (line.decode(),)


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return "file string, range long, k long, value string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)


class FastqReader(_Counted):
    """A record has four lines: @ and a name, bases, + and qualities.

    No bases begin with +, so a line with @ whose next but one has + is a record's first, whatever its qualities are.
    """

    columns = ("name", "seq", "qual")

    def found(self, data: _Bytes, r: ByteRange) -> Iterator[tuple[str, str, str]]:
        """Name, bases and qualities of the records that begin in the range."""
        lines, ahead = _lines_after(data, r), []
        if r.low and not data.packed:
            # one of the next four lines is a record's first, and six show which
            ahead = [x for _, x in zip(range(6), lines)]
            first = next((k for k in range(len(ahead) - 2) if ahead[k][1].startswith(b"@") and ahead[k + 2][1].startswith(b"+")), None)
            if first is None:
                if len(ahead) == 6:
                    raise ValueError(f"no record begins after byte {r.low} of {r.file}")
                return  # what is left of the last record
            ahead = ahead[first:]
        source = chain(ahead, lines)
        for at, head in source:
            if not data.packed and at >= r.high:
                return
            rest = [x[1] for _, x in zip(range(3), source)]
            if not head and not any(rest):
                return  # empty lines at the end
            if not head.startswith(b"@"):
                raise ValueError(f"no @ at a record's start in {r.file}: {head[:80]!r}")
            if len(rest) < 3:
                raise ValueError(f"the last record of {r.file} is cut")
            yield re.split(r"\s", head[1:].decode(), maxsplit=1)[0], rest[0].decode(), rest[2].decode()


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq_ranges"

    def schema(self) -> str:
        return "file string, range long, k long, name string, seq string, qual string"

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def _placed(spark: SparkSession, kind: type[DataSource], path: str, suffix: str, size: int, into: str) -> DataFrame:
    """Rows of a counted source with their place in their file instead of that in their range."""
    options = {"suffix": suffix, "range": str(size)}
    counts = _source(spark, kind, path, counting="true", **options).select("file", "range", F.col("k").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = _source(spark, kind, path, **options)
    other = [c for c in rows.columns if c not in ("file", "range", "k")]
    return rows.join(counts.select("file", "range", before.alias("before")), ["file", "range"]).select("file", (F.col("before") + F.col("k")).alias(into), *other)


def numbered_lines(spark: SparkSession, path: str, suffix: str = "", size: int = RANGE) -> DataFrame:
    """file, line, value: each file's lines with their numbers from 0. What follows the last line end is a line if it is not empty."""
    return _placed(spark, LineSource, path, suffix, size, "line")


def fastq_records(spark: SparkSession, path: str, suffix: str = "", size: int = RANGE) -> DataFrame:
    """file, idx, name, seq, qual: records of four lines and their place in their file; a name ends at the first white space. A record without @ or a cut one fails."""
    return _placed(spark, FastqSource, path, suffix, size, "idx")


# -- lines by sampling ---------------------------------------------------------------------------------------------


def _estimate(path: str, name: str, total: int, samples: int, size: int) -> float:
    """Lines of one file from evenly spaced reads; each read also stands for half a line that it cuts."""
    size = size or min((1 << 20) // 10, total // samples)
    with opened(path)[0].open_input_file(name) as f:
        ends = lambda at, n: int((np.frombuffer(f.read_at(n, at), np.uint8) == 10).sum())
        if samples < 2 or not size or total <= samples * size:
            return float(sum(ends(at, BLOCK) for at in range(0, total, BLOCK)))
        step = (total - samples * size) // (samples - 1) + size
        return sum(ends(k * step, size) + 0.5 for k in range(samples)) / (samples * size) * total


def approximate_lines(spark: SparkSession, path: str, suffix: str = "", samples: int = 100, size: int = 0) -> DataFrame:
    """file, bytes, lines: an estimate for each plain text file, from `samples` reads of `size` bytes (0: a tenth of a megabyte, or less in small files).

    Only the samples are read. A file that is no longer than its samples is counted; packed files are refused.
    """
    known = files(path, suffix)
    if any(name.endswith(_PACKED) for name, _ in known):
        raise ValueError("packed files have no places to sample")
    told = lambda t: pd.DataFrame({"file": t["file"], "bytes": t["bytes"], "lines": [_estimate(path, n, b, samples, size) for n, b in zip(t["file"], t["bytes"])]})
    rows = spark.createDataFrame(known, "file string, bytes long").repartition(max(1, min(len(known), 10_000)))
    return rows.mapInPandas(lambda batches: map(told, batches), "file string, bytes long, lines double")
