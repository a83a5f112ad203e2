"""Readers by byte ranges against plain parsers, for ranges of any size."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from cytolake.operators import reads
from cytolake.sources import files, ranges


def _parsed(text):
    out = {}
    for line in text.splitlines():
        if line.startswith(">"):
            name = line[1:].split()[0] if line[1:].split() else ""
            out[name] = ""
        else:
            out[name] += "".join(line.split())
    return out


def _fasta(seed, count=9, width=60, end="\n"):
    r = random.Random(seed)
    parts = []
    for k in range(count):
        seq = "".join(r.choice("ACGTacgtN") for _ in range(r.choice([0, 1, 59, 60, 61, 5000, 9000])))
        parts.append(f">c{k} about {'x' * r.randint(0, 90)}{end}" + "".join(seq[i : i + width] + end for i in range(0, len(seq), width)))
    return "".join(parts)


def _read(reader, **options):
    """All rows of a reader, range by range, as the tasks would give them."""
    one = reader(options | {"path": options["path"]})
    return [row for p in one.partitions() for b in one.read(p) for row in b.to_pylist()]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000, 10**9])
@pytest.mark.parametrize("text", [_fasta(1), _fasta(2, width=10**6), _fasta(3, end="\r\n"), _fasta(4).rstrip("\n"), ">a", ">a\n>b\n>c\n", ">a\n\n\nAC\n\nGT\n", ""])
def test_fasta_ranges(tmp_path, text, size):
    if size < 64 and len(text) > 2000:
        text = text[:2000]
    p = tmp_path / "g.fa"
    p.write_text(text)
    rows = _read(ranges.FastaReader, path=str(p), range=str(size))
    seqs, parts, name = {}, {}, None
    for r in rows:
        key = (r["range"], r["part"])
        if r["name"] is not None:
            name = r["name"]
            seqs.setdefault(name, "")
        elif r["seq"]:
            assert r["at"] == parts.get(key, 0)
            parts[key] = r["at"] + r["n"]
            seqs[name] += r["seq"].decode()
    assert seqs == _parsed(text)
    counted = _read(ranges.FastaReader, path=str(p), range=str(size), counting="true")
    assert {(r["range"], r["part"]): r["n"] for r in counted if r["n"]} == parts
    assert [r["name"] for r in counted if r["name"] is not None] == list(_parsed(text))


def test_header_longer_than_allowed(tmp_path):
    p = tmp_path / "g.fa"
    p.write_text(">a" + "x" * ranges.LINE + "\nAC\n")
    with pytest.raises(ValueError, match="longer"):
        _read(ranges.FastaReader, path=str(p))


@pytest.mark.parametrize("size", [1000, 5000, 10**9])
def test_genome_is_that_of_whole_sequences(spark, tmp_path, size):
    texts = {"a.fa": _fasta(5), "b.fa": _fasta(6, 3, width=10**6).replace(">c", ">d"), "c.fa.gz": _fasta(7, 2).replace(">c", ">e"), "d.txt": ">no\nACGT\n"}
    texts["a.fa"] += ">whole\n" + "ACGTN" * 4096 + "\n"  # the last piece is full
    for name, text in texts.items():
        (tmp_path / name).write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    want = {k: v for n, t in texts.items() if n != "d.txt" for k, v in _parsed(t).items()}
    whole = spark.createDataFrame([(k, v) for k, v in want.items()], "chrom string, seq string")
    rows = lambda t: sorted((r.chrom, r.piece, r.before, bytes(r.seq)) for r in t.collect())
    got = files.read_genome(spark, str(tmp_path), "fa", size)
    assert rows(got) == rows(reads.pieces(whole))
    assert got.agg(F.max(F.octet_length("seq"))).first()[0] <= reads.PIECE + 4
    assert {r.chrom: r.seq for r in files.read_fasta(spark, str(tmp_path), "fa").collect()} == {k: v for k, v in want.items() if v}
    assert {r.chrom: r.size for r in files.chromosome_sizes(spark, str(tmp_path), "fa").collect()} == {k: len(v) for k, v in want.items()}
    sites = lambda t: sorted(map(tuple, reads.cytosines(t).collect()))
    assert sites(got) == sites(whole)


@pytest.mark.parametrize("text, message", [(">a\nAC\n>b\nA\n>a\nGT\n", "several sequences are named a"), ("ACGT\n>a\nAC\n", "before the first header")])
def test_genomes_that_fail(spark, tmp_path, text, message):
    (tmp_path / "g.fa").write_text(text)
    with pytest.raises(Exception, match=message):
        files.read_genome(spark, str(tmp_path / "g.fa"), size=5).collect()


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    p = tmp_path / "g.fa"
    p.write_text(">a\n" + "ACGT" * 50_000 + "\n")
    source = ranges._source(spark, ranges.FastaSource, str(p), range="10000")
    assert source.where("seq is not null").select(F.spark_partition_id()).distinct().count() == 21
    chunks = files.genome_chunks(spark, str(p), size=10_000)
    assert chunks.agg(F.sum(F.octet_length("seq"))).first()[0] == 200_000


def _fastq(seed, n=60, end="\n"):
    """Records whose qualities look like the beginnings of other lines."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        m = r.choice([0, 1, 2, 30])
        rows.append((f"r{k}", "".join(r.choice("ACGTN") for _ in range(m)), r.choice("@+>I") * m))
    return rows, "".join(f"@{a} x{end}{b}{end}+{r.choice(['', a])}{end}{c}{end}" for a, b, c in rows)


@pytest.mark.parametrize("size", [1, 3, 10, 50, 333, 10**9])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_ranges(tmp_path, size, end):
    for seed in range(4):
        rows, text = _fastq(seed, end=end)
        p = tmp_path / "r.fastq"
        p.write_bytes((text if seed % 2 else text.rstrip(end) if rows[-1][2] else text + end + end).encode())
        got = _read(ranges.FastqReader, path=str(p), range=str(size))
        assert [(r["name"], r["seq"], r["qual"]) for r in got] == rows
        counted = _read(ranges.FastqReader, path=str(p), range=str(size), counting="true")
        assert sum(r["k"] for r in counted) == len(rows)


def test_fastq_and_lines_keep_their_places(spark, tmp_path):
    rows, text = _fastq(9, 300)
    (tmp_path / "r.fastq").write_text(text)
    got = ranges.fastq_records(spark, str(tmp_path / "r.fastq"), size=100).orderBy("idx").collect()
    assert [(r.name, r.seq, r.qual) for r in got] == rows and [r.idx for r in got] == list(range(300))
    lines = ranges.numbered_lines(spark, str(tmp_path / "r.fastq"), size=64).orderBy("line").collect()
    assert [r.value for r in lines] == text.split("\n")[:-1] and [r.line for r in lines] == list(range(1200))
    (tmp_path / "s.fastq.gz").write_bytes(gzip.compress(text.replace("@r", "@s").encode()))
    pairs = files.read_fastq_pairs(spark, str(tmp_path / "r.fastq"), str(tmp_path / "s.fastq.gz"), suffix=9)
    assert pairs.count() == 300
    with pytest.raises(Exception, match="names differ"):
        files.read_fastq_pairs(spark, str(tmp_path / "r.fastq"), str(tmp_path / "s.fastq.gz"), suffix=0).collect()


@pytest.mark.parametrize("text, message", [("@a\nAC\n+\nII\nb\nAC\n+\nII\n", "no @"), ("@a\nAC\n+\nII\n@b\nAC\n+\n", "is cut")])
def test_fastq_that_fails(spark, tmp_path, text, message):
    (tmp_path / "r.fastq").write_text(text)
    with pytest.raises(Exception, match=message):
        files.read_fastq(spark, str(tmp_path / "r.fastq")).collect()


def test_approximate_lines(spark, tmp_path):
    r = random.Random(1)
    long_ = "".join("x" * r.randint(1, 120) + "\n" for _ in range(60_000))
    (tmp_path / "long.txt").write_text(long_)
    (tmp_path / "short.txt").write_text("a\nb\nc")
    (tmp_path / "empty.txt").write_text("")
    got = {x.file.rsplit("/", 1)[1]: (x.bytes, x.lines) for x in files.approximate_lines(spark, str(tmp_path), samples=100, size=2000).collect()}
    assert got["empty.txt"] == (0, 0) and got["short.txt"] == (5, 2)
    assert got["long.txt"][0] == len(long_) and abs(got["long.txt"][1] - 60_000) < 2500
    # by hand: reads of 3 bytes at 0, 4 and 8 of 12, with 1, 2 and 0 line ends
    (tmp_path / "hand").mkdir()
    (tmp_path / "hand" / "x").write_text("ab\nc\nd\nefghi")
    (one,) = files.approximate_lines(spark, str(tmp_path / "hand"), samples=3, size=3).collect()
    assert one.lines == pytest.approx((1.5 + 2.5 + 0.5) / 9 * 12)
