"""Long texts, stored rows, coreference and the class prior."""

import random
import re

import numpy as np

from cytolake.llm import pii, positive, shared, suffixes
from tests.llm.test_operators import _removed


def test_suffix_ranks_are_those_of_sorted_suffixes():
    rng = random.Random(1)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)), np.uint8)
    for span in (3, 8, 20, 33):
        raw = data.tobytes()
        heads = [raw[i : i + span] for i in range(len(raw) - span + 1)]
        order = {h: k for k, h in enumerate(sorted(set(heads)))}
        assert suffixes.suffix_ranks(data, span).tolist() == [order[h] for h in heads]


def test_repeats_in_a_long_document(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("etaoin shrdlu") for _ in range(700_000))
    rows = [(5, text + text[100_000:100_400] + "x" + text[523_000:524_500]), (2, text[262_100:262_300]), (9, text[:300])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, map(tuple, suffixes.remove_repeats(df).collect()))) == sorted(map(str, _removed(df)))


def test_rows_of_crowded_strings(spark, monkeypatch):
    """Near copies of one text, each with an edit of its own: a common string is a row a task, one with an edit is none."""
    rng = random.Random(5)
    base = "".join(rng.choice("etaoin shrdlu") for _ in range(500))
    rows = []
    for k in range(150):
        at = rng.randrange(500)
        rows.append((k, base[:at] + f"<{k}>" + base[at:]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept, stored = [], suffixes.stored

    def spied(table, n, path):
        if path.endswith("/ranks"):
            kept.append(table.count())
        stored(table, n, path)

    assert [x.tolist() for x in suffixes._first_places([tuple(np.array(x) for x in zip((1, 2, 9, 0, 4), (1, 2, 3, 9, 9))), tuple(np.array([x]) for x in (1, 2, 3, 8, 7))])] == [[1], [2], [3], [8], [7]]
    monkeypatch.setattr(suffixes, "stored", spied)
    got = suffixes.remove_repeats(df, crowded=2)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, _removed(df)))
    strings = sum(len(t) - 99 for _, t in rows)
    assert 0 < kept[0] < strings / 20, (kept[0], strings)


def test_stored_rows_with_few_open_files(spark):
    rng = random.Random(2)
    rows = [(rng.getrandbits(63) - (1 << 62), k, k % 7) for k in range(500)]
    rows += [(rows[3][0], 1000 + k, k) for k in range(5)]  # one key, several rows
    path = shared.scratch(spark, "test")
    shared.stored(spark.createDataFrame(rows, "key long, a long, b long").repartition(3), 64, path)
    table = shared.Stored(path, 64, ("key", "a", "b"), most=2)
    keys = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    hit, b = table.find(keys, {"a": np.array([r[1] for r in rows])}, "b")
    assert hit.all() and b.tolist() == [r[2] for r in rows] and len(table.opened.open) <= 2
    assert not table.find(keys, {"a": np.array([r[1] + 5000 for r in rows])})[0].any()
    assert sorted(table.of(keys[3])[1].tolist()) == [3, 1000, 1001, 1002, 1003, 1004]


def test_settings_come_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    shared.written(spark.range(3), shared.scratch(spark, "test"))
    assert spark.conf.get(key) == before


def test_one_person_keeps_one_surrogate(spark):
    rows = [
        (1, "Mrs. Anna Smith met Mrs Smith. Later Anna Smith wrote; Smithson stays. Dr. Smith too.", "k1", 5),
        (2, "Frau Anna Smith and Prof. Weber; tel 030 1234567 or +1 (017) 555-7713, +1-017-5557713", "k2", 6),
        (3, "a.b@mail.example.co.uk and A.B@MAIL.EXAMPLE.CO.UK, c@mail.example.co.uk", "k3", 7),
        (4, "a@b.cc" + ".cc" * 100_000 + " " + "1-" * 50_000 + "+1 22 " * 20_000 + "Mr. A " * 20_000, "k4", 8),
    ]
    got = {r.doc_id: r for r in pii.replace_private(spark.createDataFrame(rows, "doc_id long, text string, __found string, n_private int")).collect()}
    assert [got[k]["__found"] for k in (1, 2, 3, 4)] == ["k1", "k2", "k3", "k4"]
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mrs (\w+)\. Later (\w+) (\w+) wrote; Smithson stays\. Dr\. (\w+) too\.", got[1].text)
    assert m and m[1] == m[4] and len({m[2], m[3], m[5], m[6]}) == 1 and m[2] != "Smith" and m[1] != "Anna" and got[1].n_private == 4
    n = re.fullmatch(r"Frau (\w+) (\w+) and Prof\. (\w+); tel (\d{3}) (\d{7}) or \+1 \((\d{3})\) (\d{3})-(\d{4}), \+1-(\d{3})-(\d{7})", got[2].text)
    assert n and (n[1], n[2]) == (m[1], m[2]) and n[3] not in (m[2], "Weber") and n[9] + n[10] == n[6] + n[7] + n[8]
    a, b, c = re.fullmatch(r"(\S+) and (\S+), (\S+)", got[3].text).groups()
    assert b == a.upper() and re.fullmatch(r"[a-z]\.[a-z]@[a-z]{4}\.[a-z]{7}\.[a-z]{2}\.uk", a) and a.split("@")[1] == c.split("@")[1]
    assert got[4].n_private > 0


def test_prior_of_mixed_rows():
    rng = np.random.default_rng(4)
    of = lambda n, p: (rng.random((n, 6)) < p).astype(float)
    good, bad = np.array([0.9, 0.8, 0.8, 0.2, 0.1, 0.5]), np.array([0.1, 0.1, 0.2, 0.9, 0.9, 0.5])
    for share in (0.3, 0.7):
        n = int(6000 * share)
        mixed = rng.permutation(np.concatenate([of(n, good), of(6000 - n, bad)]))
        assert abs(positive.class_prior(of(3000, good), mixed) - share) < 0.06
    assert positive.class_prior(np.zeros((0, 6)), np.zeros((5, 6))) == 0.5
