"""Streams against the batch operators on the same rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from cytolake.operators import reads
from cytolake.plans import standins
from cytolake.streaming import mates, windows

D = "/root/testdata/sf0.001"
_RECORD = "qname string, flag int, rname string, pos long, cigar string, rnext string, pnext long, seq string, tags array<string>, ts timestamp"
_COLUMNS = [c.split()[0] for c in _RECORD.split(", ")][:-1]
_OTHER = ("last", 0, "none", 1, "1M", "*", 0, "A", [])
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, before)


def _stream(spark, batches, schema, tmp_path, make, mode="append"):
    """Rows of a query over the batches, a file and a micro-batch each."""
    source = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{k:03d}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    q = make(files).writeStream.format("memory").queryName("streamed").outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert not q.isActive and q.exception() is None
    return spark.table("streamed")


def _at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


@pytest.mark.parametrize("seed", [1, 2])
def test_mates_in_any_order(rocks, tmp_path, seed):
    r = random.Random(seed)
    standard = reads.standardized(standins.records(rocks, D).where("pmod(hash(qname), 8) = 0 or qname like 'r1%'"), "bismark").select(*_COLUMNS)
    rows = [tuple(x) for x in standard.collect()]
    rows += [rows[0], rows[4]]  # names with three records
    r.shuffle(rows)
    timed = [(*x, _at(k * 10 / len(rows))) for k, x in enumerate(rows)]
    flush = (*_OTHER, _at(10_000))
    batches = [timed[k : k + len(timed) // 3 + 1] for k in range(0, len(timed), len(timed) // 3 + 1)] + [[flush]]
    got = _stream(rocks, batches, _RECORD, tmp_path, lambda s: mates.streamed_mates(s, wait=20_000, late="1 hour" if seed == 1 else "30 seconds", suffix=0)).where("rname <> 'none'")
    want = reads.merged_records(rocks.createDataFrame(rows, _RECORD.rsplit(",", 1)[0]), suffix=0)
    key = lambda t: sorted(map(str, t.select(*want.columns).collect()))
    assert key(got) == key(want)
    assert got.where("kind <> 'single'").count() > 10 and got.where("kind = 'single'").count() > 3


def test_late_mates_are_single(rocks, tmp_path):
    standard = reads.standardized(standins.records(rocks, D), "bismark").where("qname = 'r1'").select(*_COLUMNS)
    two = [tuple(x) for x in standard.collect()]
    assert len(two) == 2 and reads.merged_records(standard, suffix=0).where("kind <> 'single'").count() == 1
    batches = [[(*two[0], _at(0))], [(*_OTHER, _at(100))], [(*_OTHER, _at(200))], [(*two[1], _at(201))], [(*_OTHER, _at(9000))]]
    got = _stream(rocks, batches, _RECORD, tmp_path, lambda s: mates.streamed_mates(s, wait=30_000, suffix=0)).where("rname <> 'none'").collect()
    assert [r.kind for r in got] == ["single", "single"] and {r.pos for r in got} == {x[3] for x in two}


def test_running_counts(spark, tmp_path):
    r = random.Random(3)
    rows = [("c", r.randint(0, 9), r.choice("+-"), r.choice("CTAG")) for _ in range(300)]
    schema = "chrom string, pos long, strand string, base string"
    got = _stream(spark, [rows[:100], rows[100:]], schema, tmp_path, windows.streaming_counts, "complete")
    n = lambda b: F.sum(F.col("base").isin(*b).cast("int"))
    want = spark.createDataFrame(rows, schema).groupBy("chrom", "pos", "strand").agg(n("CT").alias("n_reads"), n("C").alias("n_meth"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sessions_and_tumbling_levels(spark, tmp_path):
    events = [[(1, _at(0)), (1, _at(50)), (2, _at(10))], [(1, _at(200)), (1, _at(120))], [(3, _at(9000))]]
    got = _stream(spark, events, "user_id long, ts timestamp", tmp_path, lambda s: windows.sessions(s, "80 seconds", "100 seconds")).where("user_id < 3").orderBy("user_id", "start").collect()
    assert [(r.user_id, r.n) for r in got] == [(1, 4), (2, 1)]
    sites = [[(_at(0), "c", 4, 1), (_at(10), "c", 6, 2)], [(_at(3700), "c", 5, 5)], [(_at(90_000), "c", 1, 0)]]
    got = _stream(spark, sites, "ts timestamp, chrom string, n_reads long, n_meth long", tmp_path / "b", windows.tumbling_levels).orderBy("start").collect()
    assert [(r.n_reads, r.n_meth, r.level) for r in got] == [(10, 3, 0.3), (5, 5, 1.0)]
