"""Records against the tokenizers library, damaged files, and reads in another order."""

import io
import json
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cytolake.llm import queries, records

SCHEMA = "doc_id long, text string, shard string, offset string, hash string, start string, row string"


def _expected(rows, end=True):
    tokenizer, at, out = Tokenizer.from_file(records.default_tokenizer()), 0, []
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0] * end
        out.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    prose = lambda n: " ".join("".join(r.choice("abcdeé \n") for _ in range(7)) for _ in range(n))
    texts = [None, "", " ", "a\x00b", "😀 é ﷽", "line\n\n\tline", prose(200_000), "x" * 3000] + [prose(r.randint(1, 90)) for _ in range(120)]
    rows = [(k * 7 - 40, t, "s", "o", "h", "9", "r") for k, t in enumerate(texts)]
    r.shuffle(rows)
    rows += [rows[3]] * 30
    path = tmp_path_factory.mktemp("records")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    df = queries.op13_token_records(spark, folder)
    assert df.dtypes == [(c, "bigint") for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
    assert sorted(str(tuple(r)) for r in df.collect()) == _expected(docs)


def test_null_ids_and_several_texts(spark):
    """Texts under one doc_id, or none, come in the order of a hash: their starts follow from the counts before."""
    docs = spark.createDataFrame([(None, "one"), (None, "two words"), (4, "a b c"), (4, "d"), (4, "d"), (None, None)], "doc_id long, text string")
    got = sorted(records.token_records(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 3 + [4] * 3
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(6)]
    assert sorted(r.n_tokens for r in got) == sorted([1, 2, 3, 4, 2, 2])
    assert records.token_records(docs.limit(0)).collect() == []


def test_test_tables(spark):
    d = "/root/testdata/sf0.001"
    got = sorted(str(tuple(r)) for r in queries.op13_token_records(spark, d).collect())
    assert got == _expected(spark.read.parquet(f"{d}/documents.parquet").collect())


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", " ", "  ", "\n", "\t", "\x1f", "\xa0", "\u3000", "\u200b", "\u180e", "\ufeff", "\u2028", "'s", "'", "1", "word", "<|endoftext|>", "ﷺ", "😀", "-", "\x85"]), max_size=30).map("".join))
def test_cut_texts(text):
    """A text in pieces has the ids of the whole text."""
    encode = records.Encoder.of(records.default_tokenizer())
    assert encode.cuts
    assert encode([text, text[1:]]) == encode.whole([text, text[1:]])


def test_forgotten_stretches(monkeypatch):
    """Generations that are full at once change nothing."""
    monkeypatch.setattr(records, "PIECES", 300)
    encode, r = records.Encoder(records.default_tokenizer()), random.Random(4)
    for _ in range(200):
        text = "".join(r.choice(["a", "b c", ", ", ".\n", " it's", " 12", "\n\n", "  "]) for _ in range(r.randint(0, 20)))
        assert encode([text]) == encode.whole([text])


def test_stretches_of_a_chunk_are_found_at_once():
    """Words and signs are cut apart on bytes, and what is known is neither encoded again nor asked for one by one."""
    text = "don't cut (this) a1b2,x_y \u201cquoted\u201d here\nand there  \u3042 \u3000 word" + "l" * 40
    data = np.frombuffer(text.encode(), np.uint8)
    at = [0, *np.flatnonzero(records.cuts(data)).tolist(), len(data)]
    parts = [data[a:b].tobytes().decode() for a, b in zip(at, at[1:])]
    assert parts[:14] == ["don", "'t", " cut", " (", "this", ")", " a", "1", "b", "2", ",", "x", "_", "y"] and "\n" in parts
    encode = records.Encoder(records.default_tokenizer())
    words = [f"w{k}x{'y' * (k % 40)}" for k in range(70_000)]  # the table grows
    texts = [" ".join(words[k : k + 700]) for k in range(0, len(words), 700)] + [text]
    want = encode.whole(texts)
    assert encode(texts) == want
    rows = encode.known.rows
    assert encode(texts[::-1]) == want[::-1] and encode.known.rows == rows


def test_tokenizers_that_take_no_cuts(tmp_path):
    """Others are given whole texts."""
    other = os.path.join(os.path.dirname(records.default_tokenizer()), "word_bpe_49k.json")
    assert not records.cuttable(other) and records.Encoder(other)(["Some Text"]) == records.Encoder(other).whole(["Some Text"])
    made = json.load(open(records.default_tokenizer()))
    for change in ({"pre_tokenizer": made["pre_tokenizer"] | {"add_prefix_space": True}}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [made["added_tokens"][0] | {"lstrip": True}]}):
        (tmp_path / "t.json").write_text(json.dumps(made | change))
        assert not records.cuttable(str(tmp_path / "t.json"))


def test_frames():
    payload = records.to_payload(-5, np.array([1, 2**32 - 1], "<u4").tobytes(), 4)
    whole = records.frame(payload)
    assert records.unframe(whole) == payload
    doc_id, ids = records.from_payload(payload)
    assert doc_id == -5 and ids.tolist() == [1, 2**32 - 1]
    doc_id, ids = records.from_payload(records.to_payload(None, b"\1\0\2\1", 2))
    assert doc_id is None and ids.tolist() == [1, 258] and ids.dtype == "<u4"
    for k in range(len(whole)):
        with pytest.raises(ValueError):
            records.unframe(whole[:k] + bytes([whole[k] ^ 4]) + whole[k + 1 :])
        with pytest.raises(ValueError):
            records.unframe(whole[:k])
        if k:
            with pytest.raises(ValueError):
                list(records.frames(io.BytesIO(whole + whole[:k])))
    assert list(records.frames(io.BytesIO(whole * 3))) == [payload] * 3


def test_shards_without_the_index_and_shuffled_reads(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = f"file://{tmp_path}/out"
    index = records.write_records(docs, path, end=None, shard=8_000)
    told = [tuple(r) for r in records.read_records(records.in_file_order(index), path, keep_ids=True).select("doc_id", "start", "n_tokens", "ids").orderBy("start", "n_tokens", "doc_id").collect()]
    assert [r[1] for r in told] == [sum(x[2] for x in told[:k]) for k in range(len(told))]
    assert sorted(str((r[0], r[1], r[2], zlib.crc32(np.array(r[3], "<u4").tobytes()))) for r in told if r[2]) == [x for x in _expected(docs.collect(), end=False) if ", 0, 0)" not in x]
    names = sorted(os.listdir(f"{tmp_path}/out/shards"))
    assert len(names) > 10
    flat = []
    for name in names:
        with open(f"{tmp_path}/out/shards/{name}", "rb") as f:
            flat += [records.from_payload(p)[0] for p in records.frames(f)]
    assert flat == sorted(r.doc_id for r in docs.collect())
    stored = records.stored_index(spark, path)
    orders = [[r.doc_id for r in records.read_records(records.shuffled(stored, seed), path).collect()] for seed in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[0]) == sorted(orders[2]) == flat


def test_damage_fails(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string")
    path = f"file://{tmp_path}/out"
    index = records.write_records(docs, path)
    name = index.orderBy("start").first().shard
    with open(f"{tmp_path}/out/shards/{name}", "r+b") as f:
        f.seek(20)
        f.write(b"\xff")
    with pytest.raises(Exception, match="damaged"):
        records.read_records(index, path).collect()
