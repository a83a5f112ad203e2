"""Periodic runs against brute force: every period of every stretch."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cytolake.llm import periodic, queries


def _brute(words, least=12):
    """Stretches of words q apart that are equal, for every q; of one interval the smallest q."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = _brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id,
        len(runs),
        *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(2, 12))
def test_runs_of_few_words(ids, least):
    assert periodic.find_runs(ids, least) == _brute(ids, least)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=9), st.integers(1, 7)), max_size=12))
def test_nested_repeats(parts):
    ids = [i for part, times in parts for i in part * times]
    assert periodic.find_runs(ids) == _brute(ids)


def test_z_function():
    s = [1, 1, 2, 1, 1, 2, 1, 3]
    assert periodic.z_function(s) == [8, 1, 0, 4, 1, 0, 1, 0]
    assert periodic.z_function([]) == []


def test_hashes_that_all_collide(monkeypatch):
    """Equal hashes only cost time."""
    r = random.Random(2)
    ids = [r.randint(0, 2) for _ in range(300)]
    monkeypatch.setattr(periodic, "mixed", lambda x: x * 0)
    assert periodic.find_runs(ids) == _brute(ids)


def test_one_word_throughout():
    assert periodic.find_runs([7] * 60_000) == [(0, 60_000, 1)]


SCHEMA = "doc_id long, text string, runs string, collapsed string, data string, words string, __n int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    prose = lambda n: " ".join(f"w{r.randint(0, 60)}" for _ in range(n))
    texts = [None, "", " \t\n", "one", "a b " * 40, "a\x0bb\x0c" * 9, "é ü é ü " * 9, "x\x1fy " * 20, "ha " * 3000, prose(2500)]
    texts += [prose(r.randint(1, 200)) + " " + (prose(r.randint(1, 15)) + " ") * r.randint(1, 6) for _ in range(150)]
    rows = [(k, t, "r", "c", "d", "w", 1) for k, t in enumerate(texts)]
    rows += [rows[14], rows[14], (14, "other " * 13, *rows[0][2:]), (None, texts[16], *rows[0][2:]), (None,) * 7]
    rows += [(k, "a b c d e f g h i j k l m n o p q r s t " * 3, *rows[0][2:]) for k in (10**12, -5)]
    path = tmp_path_factory.mktemp("periodic")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = sorted(map(str, (_expected(d.doc_id, d.text) for d in docs)))
    df = queries.op11_periodic_runs(spark, folder)
    assert df.dtypes[1:6] == [(c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    assert sorted(str(tuple(r)) for r in df.collect()) == want
    assert sum(zlib.crc32(str(d.doc_id).encode()) % 10 == 0 for d in docs if d.doc_id is not None) > 5


def test_operator_itself(spark):
    docs = spark.createDataFrame([(1, "go " + "no way " * 8 + "out"), (2, None)], "doc_id long, text string")
    one, two = periodic.collapse_runs(docs).orderBy("doc_id").collect()
    assert one.collapsed == "go no way out" and [tuple(r) for r in one.runs] == [(1, 16, 2)] and one.n_words == 18
    assert two.collapsed == "" and two.runs == [] and two.n_words == 0
    assert periodic.collapse_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.collapse_runs(docs, least=1)


def test_test_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect() if len((r.text or "").split()) < 1500}
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, d).collect()}
    assert {k: got[k] for k in docs} == {k: _expected(k, t) for k, t in docs.items()}
