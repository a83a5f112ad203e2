"""The manifest against a plain tree in memory, and its SQL."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from cytolake.llm import manifest, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree string, steps string"


def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(row, text):
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def _tree(nodes):
    """The top, and for each leaf its steps."""
    steps, groups = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, joined = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for j in range(len(run)):
                for k in groups[at + j]:
                    steps[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(_h("".join(run)))
            joined.append([k for g in groups[at : at + 16] for k in g])
        nodes, groups = up, joined
    return nodes[0], steps


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _expected(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r.source].append((r.doc_id is not None, r.doc_id or 0, _leaf(r, r.text), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [_tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names]
    root, above = _tree([t[0] for t in trees])
    out = []
    for s, (subroot, steps), rest in zip(names, trees, above):
        for (_, _, leaf, r), own in zip(sorted(sources[s], key=lambda x: x[:3]), steps):
            hit = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            h = _leaf(r, _lower(r.text)) if hit else leaf
            for left, right in own + rest:
                h = _h(left + h + right)
            out.append((r.doc_id, leaf, subroot, root, _h("".join(a + b for a, b in own + rest)), h, h == root))
    return sorted(map(str, out))


def _save(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    return str(path)


def _row(k, source, text="Some Text", **other):
    return (k, source, other.get("lang", "en"), other.get("n", 9), text, "d", "t", "s")


def _check(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = queries.op12_merkle_manifest(spark, folder)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = got.collect()
    assert sorted(str(tuple(r)) for r in got) == _expected(docs)
    return got


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 257, 16, 300], [2] * 18, [1] * 17])
def test_shapes(spark, tmp_path, sizes):
    rows = [_row(1000 * s + k, f"s{s}", f"Text {k} of é {s}") for s, n in enumerate(sizes) for k in range(n)]
    got = _check(spark, _save(spark, rows, tmp_path))
    assert len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == len(sizes)


def test_odd_rows(spark, tmp_path):
    long_ = "Ab " * 400_000
    rows = [_row(1, None, None, lang=None, n=None), _row(None, "s", None), _row(None, "s", "A"), _row(2, "", ""), _row(3, "é", "É"), _row(4, "s", "-"), _row(5, "s", long_), _row(-7, "=", "1:-")]
    rows += [_row(9, "s", "Twice")] * 40 + [_row(9, "s", "Other text")] + [_row(k, "\U0001f600" if k % 2 else "￿", "A" * k) for k in range(10, 60)] + [(None,) * 8]
    got = _check(spark, _save(spark, rows, tmp_path))
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_empty(spark, tmp_path):
    assert queries.op12_merkle_manifest(spark, _save(spark, [], tmp_path)).collect() == []


def test_store(spark, tmp_path):
    """Levels shrink to a sixteenth and are sorted; any claim can be held against the proofs."""
    docs = spark.createDataFrame([_row(k, "s" if k % 3 else "t") for k in range(900)], SCHEMA)
    path = f"file://{tmp_path}/store"
    found = manifest.with_proofs(docs, path, {"twice": F.col("doc_id") * 2}).collect()
    assert all(r.twice == 2 * r.doc_id for r in found) and len(found) == 900
    for level, want in enumerate((600, 38, 3, 1)):
        t = spark.read.parquet(f"{path}/sources/level={level}").where("tree = '=s'")
        assert t.select(F.sum(F.size("kids"))).first()[0] == want
    wrong = docs.withColumn("text", F.lit("another"))
    bad = manifest.with_proofs(docs, f"{path}2", {"claim": manifest.leaf(text=F.lit("another"))})
    assert wrong.count() == bad.where(manifest.folded(F.col("claim")) != F.col("root")).count()


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = c.execute(manifest.SQL)
    names = [x[0] for x in want.description]
    want = want.fetchall()
    df = queries.op12_merkle_manifest(spark, d)
    assert df.columns == names
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert sorted(map(str, want)) == _expected(spark.read.parquet(f"{d}/documents.parquet").collect())
