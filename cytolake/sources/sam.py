"""SAM text with its header: records in and out, in the order of the rows.

The sink is a Python data source. Each task writes its lines to a file of its own in a hidden folder beside the output; the commit
puts the header and the parts that the job kept in their places, so a failed task or job leaves nothing that a reader would see.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .ranges import BLOCK, opened

FIELDS = "qname string, flag int, rname string, pos bigint, mapq int, cigar string, rnext string, pnext bigint, tlen bigint, seq string, qual string"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of SAM text, unmapped ones too, with the columns of the format (pos is 1-based) and tags, an array. Header lines are left out; a line with fewer than 11 columns fails."""
    p = F.split("value", "\t")
    t = spark.read.text(path).where(~F.col("value").startswith("@"))
    t = t.where(F.when(F.size(p) < len(_NAMES), F.raise_error(F.concat(F.lit("a record is cut: "), "value")).cast("boolean")).otherwise(F.lit(True)))
    fields = [p[k].cast(f.split()[1]).alias(f.split()[0]) for k, f in enumerate(FIELDS.split(", "))]
    return t.select(*fields, F.slice(p, len(_NAMES) + 1, F.greatest(F.lit(0), F.size(p) - len(_NAMES))).alias("tags"))


def read_header(path: str) -> list[str]:
    """The header lines of a SAM file, or of the first file of a folder. Only they are read."""
    system, at = opened(path)
    if system.get_file_info(at).type == fs.FileType.Directory:
        at = min(i.path for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))
    out, rest = [], b""
    with system.open_input_stream(at, compression="detect") as f:
        while block := f.read(BLOCK):
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                if not line.startswith(b"@"):
                    return out
                out.append(line.decode())
            if rest and not rest.startswith(b"@"):
                return out
    return out + [rest.decode()] * rest.startswith(b"@")


def header_of(sizes: DataFrame, order: str | None = None) -> list[str]:
    """A header for chromosomes (chrom, size), by name: one line for each, on the driver, as in every SAM file."""
    first = "@HD\tVN:1.6" + (f"\tSO:{order}" if order else "")
    return [first, *(f"@SQ\tSN:{r.chrom}\tLN:{r.size}" for r in sizes.orderBy("chrom").toLocalIterator())]


def with_program(header: Iterable[str], name: str, command: str = "", version: str = "") -> list[str]:
    """The header with a @PG line at its end: its id is the name, or the name and a number where that is taken, and it follows the last program."""
    lines = list(header)
    ids = [f[3:] for line in lines if line.startswith("@PG\t") for f in line.split("\t") if f.startswith("ID:")]
    own = next(c for k in range(len(ids) + 1) if (c := f"{name}.{k}" if k else name) not in ids)
    fields = [f"ID:{own}", f"PN:{name}", *([f"PP:{ids[-1]}"] if ids else []), *([f"VN:{version}"] if version else []), *([f"CL:{' '.join(command.split())}"] if command else [])]
    return [*lines, "\t".join(["@PG", *fields])]


def lines_of(records: DataFrame) -> DataFrame:
    """value: SAM lines of records. Columns that are missing or null get the format's value for unknown; tags may be missing."""
    unknown = {"flag": "0", "pos": "0", "mapq": "255", "pnext": "0", "tlen": "0"}
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(unknown.get(c, "*"))) if c in records.columns else F.lit(unknown.get(c, "*"))
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in records.columns else F.array().cast("array<string>")
    return records.select(F.concat_ws("\t", *map(cell, _NAMES), tags).alias("value"))


@dataclass
class _Part(WriterCommitMessage):
    task: int
    file: str


class SamWriter(DataSourceArrowWriter):
    """Lines to parts; see the module."""

    def __init__(self, options, overwrite: bool):
        self.path, self.header, self.overwrite = options["path"].rstrip("/"), options.get("header", ""), overwrite
        self.one = options.get("one_file", "false") == "true"
        self.hidden = f"{self.path}.writing-{uuid.uuid4().hex}"
        system, at = opened(self.hidden)
        system.create_dir(at, recursive=True)  # here and not by tasks, so that one which outlives the job finds no place to write to

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        system, at = opened(self.hidden)
        task = TaskContext.get()
        name = f"{at}/{task.partitionId():08d}-{task.taskAttemptId()}"
        with system.open_output_stream(name) as out:
            for batch in iterator:
                for line in batch.column(0).to_pylist():
                    out.write(line.encode() + b"\n")
        return _Part(task.partitionId(), name)

    def commit(self, messages: list[_Part | None]) -> None:
        system, at = opened(self.path)
        hidden = opened(self.hidden)[1]
        parts = [m.file for m in sorted((m for m in messages if m), key=lambda m: m.task)]
        head = f"{hidden}/header"
        with system.open_output_stream(head) as out:
            out.write(self.header.encode())
        made = f"{hidden}/made"
        if self.one:
            with system.open_output_stream(made) as out:
                for part in [head, *parts]:
                    with system.open_input_stream(part) as f:
                        while block := f.read(BLOCK):
                            out.write(block)
        else:
            system.create_dir(made)
            for k, part in enumerate([head, *parts]):
                system.move(part, f"{made}/part-{k:08d}.sam")
        there = system.get_file_info(at).type
        if there != fs.FileType.NotFound:
            (system.delete_dir if there == fs.FileType.Directory else system.delete_file)(at)
        system.move(made, at)
        system.delete_dir(hidden)

    def abort(self, messages: list[_Part | None]) -> None:
        system, hidden = opened(self.hidden)
        if system.get_file_info(hidden).type != fs.FileType.NotFound:
            system.delete_dir(hidden)


class SamSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sam_with_header"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> SamWriter:
        return SamWriter(self.options, overwrite)


def write_sam(records: DataFrame, path: str, header: Iterable[str] = (), one_file: bool = False, overwrite: bool = False) -> None:
    """Writes records as SAM text with a header, in the order of the rows and partitions.

    path becomes a folder of parts, the header first, which together, by name, are one SAM file; parts are only moved into it. With
    one_file it becomes a single file, which the driver puts together block by block: for what one reader takes. A path that
    is there fails unless it may be overwritten. A header line that does not begin with @ fails.
    """
    header = list(header)
    if any(not line.startswith("@") or "\n" in line for line in header):
        raise ValueError("a header line begins with @ and ends there")
    system, at = opened(path)
    if not overwrite and system.get_file_info(at).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    records.sparkSession.dataSource.register(SamSink)
    options = {"path": path, "header": "".join(line + "\n" for line in header), "one_file": str(one_file).lower()}
    lines_of(records).write.format(SamSink.name()).mode("overwrite").options(**options).save()
