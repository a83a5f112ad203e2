"""SAM records out and in again."""

import os

import pytest
from pyspark.sql import functions as F

from cytolake.operators import reads
from cytolake.plans import standins
from cytolake.sources import files, sam

D = "/root/testdata/sf0.001"
HEADER = ["@HD\tVN:1.6\tSO:unsorted", "@SQ\tSN:chr0\tLN:1000", "@PG\tID:mapper"]


@pytest.mark.parametrize("one_file", [False, True])
def test_round_trip(spark, tmp_path, one_file):
    records = standins.records(spark, D).repartition(7, "qname").withColumn("order", F.monotonically_increasing_id())
    path = str(tmp_path / "out.sam")
    sam.write_sam(records.drop("order"), path, sam.with_program(HEADER, "format", "format -f bsmap  in.sam"), one_file=one_file)
    back = sam.read_records(spark, path)
    key = lambda t: sorted(map(str, t.select(*records.drop("order").columns).collect()))
    assert key(back) == key(records)
    text = "".join(open(p).read() for p in ([path] if one_file else sorted(os.path.join(path, f) for f in os.listdir(path))))
    lines = text.splitlines()
    assert lines[:3] == HEADER and lines[3] == "@PG\tID:format\tPN:format\tPP:mapper\tCL:format -f bsmap in.sam"
    assert [line.split("\t")[0] for line in lines[4:]] == [r.qname for r in records.orderBy("order").collect()]
    assert sam.read_header(path) == lines[:4]
    assert sorted(os.listdir(tmp_path)) == ["out.sam"]
    assert files.read_sam(spark, path).count() == records.count()


def test_from_mapper_to_fragments(spark, tmp_path):
    """What operators make of records is the same after a file."""
    records = standins.records(spark, D)
    sam.write_sam(records, str(tmp_path / "a"), HEADER)
    fragments = lambda r: sorted(map(str, reads.merged_records(reads.standardized(r, "bismark"), suffix=0).collect()))
    assert fragments(sam.read_records(spark, str(tmp_path / "a"))) == fragments(records)
    merged = reads.merged_records(reads.standardized(records, "bismark"), suffix=0)
    sam.write_sam(merged, str(tmp_path / "b"), HEADER)
    back = sam.read_records(spark, str(tmp_path / "b"))
    assert back.count() == merged.count() and back.where("rnext = '*' and mapq = 255 and size(tags) > 0").count() == merged.count()


def test_nothing_is_left_of_what_fails(spark, tmp_path):
    records = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("string").alias("qname"))
    with pytest.raises(Exception, match="broken"):
        sam.write_sam(records, str(tmp_path / "x"), HEADER)
    assert os.listdir(tmp_path) == []
    good = records.where("qname < '2'")
    (tmp_path / "x").write_text("old")
    with pytest.raises(FileExistsError):
        sam.write_sam(good, str(tmp_path / "x"))
    with pytest.raises(Exception, match="broken"):
        sam.write_sam(records, str(tmp_path / "x"), overwrite=True)
    assert (tmp_path / "x").read_text() == "old"
    sam.write_sam(spark.range(3).select(F.col("id").cast("string").alias("qname")), str(tmp_path / "x"), HEADER, overwrite=True)
    assert sorted(r.qname for r in sam.read_records(spark, str(tmp_path / "x")).collect()) == ["0", "1", "2"]
    assert os.listdir(tmp_path) == ["x"]


def test_odd_records(spark, tmp_path):
    sam.write_sam(spark.createDataFrame([], "qname string"), str(tmp_path / "none"), HEADER)
    assert sam.read_records(spark, str(tmp_path / "none")).count() == 0 and sam.read_header(str(tmp_path / "none")) == HEADER
    sam.write_sam(spark.createDataFrame([(None, None, None)], "qname string, flag int, tags array<string>"), str(tmp_path / "null"))
    (r,) = sam.read_records(spark, str(tmp_path / "null")).collect()
    assert tuple(r) == ("*", 0, "*", 0, 255, "*", "*", 0, 0, "*", "*", [])
    with pytest.raises(ValueError):
        sam.write_sam(spark.range(1).selectExpr("'a' AS qname"), str(tmp_path / "bad"), ["no header"])
    (tmp_path / "cut.sam").write_text("@HD\na\t0\tchr1\n")
    with pytest.raises(Exception, match="cut"):
        sam.read_records(spark, str(tmp_path / "cut.sam")).collect()


def test_headers(spark):
    sizes = spark.createDataFrame([("b", 5), ("a", 7)], "chrom string, size long")
    assert sam.header_of(sizes, "coordinate") == ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:a\tLN:7", "@SQ\tSN:b\tLN:5"]
    twice = sam.with_program(sam.with_program(["@HD\tVN:1.6"], "x", version="2"), "x")
    assert twice == ["@HD\tVN:1.6", "@PG\tID:x\tPN:x\tVN:2", "@PG\tID:x.1\tPN:x\tPP:x"]
