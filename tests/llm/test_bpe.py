import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cytolake.llm import bpe

PATH, PATTERN = bpe.default_vocabulary()
CODEC = bpe.Codec(PATH, PATTERN)
PLAIN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODEC.transducer.ranks, special_tokens={})


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert ids(text) == PLAIN.encode_ordinary(text)
    assert "".join(CODEC.decode(ids(text), block=1)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="thein aoéñß\n!0'", max_size=80))
def test_text_of_few_letters(text):
    assert ids(text) == PLAIN.encode_ordinary(text)


def test_long_runs():
    for text in ("a" * 5000, " " * 3000 + "x", "=-" * 2000, "<|endoftext|>" * 5, "abcabcabd" * 500):
        assert ids(text) == PLAIN.encode_ordinary(text)


def test_small_tables(monkeypatch):
    for name in ("WORDS", "PAIRS", "EMIT"):
        monkeypatch.setattr(bpe, name, 5)
    t = bpe.Transducer(CODEC.transducer.ranks)
    for word in ("thereupon", "antidisestablishment" * 5, "Zürich", "thereupon", "aaaa" * 99, "=-" * 99):
        assert np.frombuffer(t.encode(word.encode()), "<u4").tolist() == PLAIN._encode_single_piece(word)


def test_documents(spark):
    rows = [(1, "Hello wörld 🎉", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z"), (None, "a\tb  c\n\n", None), (5, "lorem ipsum " * 20000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, data string")
    got = bpe.encode_documents(df).collect()
    want = []
    for doc, text, _ in rows:
        i = PLAIN.encode_ordinary(text or "")
        want.append((doc, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.encode_documents(df.limit(0)).collect() == []
