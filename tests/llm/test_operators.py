"""The training-data operators against brute force on small tables with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from cytolake.llm import components, kneserney, media, mixing, pii, positive, rules, simhash, suffixes, textstats, tries

SCHEMA = "doc_id long, text string, source string, data string, part int"


def _texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("the ing on ea st").strip() or "x" for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() + str(r.randint(0, 9)) for _ in range(n))
    shared = prose(60)
    out = [None, "", " \n\t ", "short", "a" * 700, "ab" * 400, "x y " * 100, prose(3000)]
    for k in range(40):
        out.append(prose(r.randint(5, 80)) + (" " + shared if k % 3 == 0 else "") + "\n" + prose(r.randint(0, 50)))
    out += [out[10], out[11], out[10][:300] + " changed " + out[10][300:], out[12].upper(), "éü " * 60, shared[:99], shared[:100], shared[5:160]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    ids = list(range(len(texts)))
    random.Random(3).shuffle(ids)
    rows = [(i, t, None if k % 9 == 0 else f"s{k % 3}", "d", k) for k, (i, t) in enumerate(zip(ids, texts))]
    rows += [rows[12], rows[12], (None, texts[14], "s1", None, 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _removed(docs):
    """Per (doc_id, text): bytes covered by strings of 100 bytes that also start earlier."""
    keyed = sorted({(r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect()})
    first, out = {}, {}
    for key in keyed:
        raw = key[2].encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in first:
                gone[i : i + 100] = b"\1" * 100
            else:
                first[s] = key
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[key] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return [((None if (r.doc_id is None) else r.doc_id), *out[r.doc_id is None, r.doc_id or 0, r.text or ""]) for r in docs.collect()]


def test_suffixes(docs):
    got = [tuple(r) for r in suffixes.remove_repeats(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, _removed(docs)))
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = [tuple(r) for r in suffixes.remove_repeats(unique).collect()]
    assert sorted(map(str, got)) == sorted(map(str, _removed(unique)))
    assert sum(r[2] for r in got) > 2000
    few = [tuple(r) for r in suffixes.remove_repeats(unique, crowded=2).collect()]
    assert sorted(map(str, few)) == sorted(map(str, got))
    assert suffixes.remove_repeats(docs.limit(0)).collect() == []


def _fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(nodes, linked):
    root = {n: n for n in nodes}
    find = lambda n: n if root[n] == n else find(root[n])
    for a, b in linked:
        root[find(a)] = find(b)
    out = defaultdict(set)
    for n in nodes:
        out[find(n)].add(n)
    return list(out.values())


def test_simhash(docs):
    rows = [(r.doc_id, _fingerprint(r.text or "")) for r in docs.collect()]
    fps = {f for _, f in rows}
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    of = {}
    for group in _classes(fps, near):
        ids = [d for d, f in rows if f in group and d is not None]
        of |= {f: min(ids, default=None) for f in group}
    want = [(d, f"{f:016x}", of[f]) for d, f in rows]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_simhash_links_in_crowded_balls(spark, monkeypatch):
    r = random.Random(1)
    center = [r.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for c in center for _ in range(400)} | {r.getrandbits(64) for _ in range(200)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = {frozenset(map(signed, g)) for g in _classes(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])}
    got = defaultdict(set)
    for row in df.join(components.components(simhash.links(df)), df.fp == components.F.col("node"), "left").collect():
        got[row.fp if row.root is None else row.root].add(row.fp)
    assert {frozenset(g) for g in got.values()} == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 4), (3, 2)] + [(100 + k, 101 + k) for k in range(60)] + [(300, 300 + k) for k in range(1, 50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5} | {100 + k: 100 for k in range(61)} | {300 + k: 300 for k in range(50)}


def _plain_count(trie, text):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
    for i in range(1, len(text) + 1):
        ends = [(text[j:i], j) for j in range(i)]
        options = [(best[j][0] + trie.pieces[p], best[j][1] - 1) for p, j in ends if p in trie.pieces]
        if text[i - 1] not in trie.pieces:
            n = len(text[i - 1].encode())
            options.append((best[i - 1][0] + n * trie.byte, best[i - 1][1] - n))
        best[i] = max(options)
    return -best[-1][1], best[-1][0]


def test_tries(docs):
    trie = tries.load(tries.default_vocabulary())
    words = {"▁" + w for w in "therefore antidisestablishment naïve 🎉x thé a aa aab 漢字 the then thens".split()} | {"▁" + "z" * 300}
    got = trie.count(list(words))
    for w in words:
        n, s = _plain_count(trie, w)
        assert got[w][0] == n and abs(got[w][1] - s) < 1e-9, w
    rows = tries.token_counts(docs).collect()
    assert len(rows) == docs.count()
    want = {r.doc_id: sum(_plain_count(trie, "▁" + w)[0] for w in (r.text or "").split()) for r in docs.where("length(text) < 900 or text is null").collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id in want:
            assert r.n_tokens == want[r.doc_id]
    assert tries.token_counts(docs.limit(0)).collect() == []


def test_kneser_ney(docs):
    rows = docs.collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    split = lambda t: (t or "").encode().lower().split() + [None]
    train = [split(r.text) for r in rows if not held(r.doc_id)]
    count = Counter(w for t in train for w in t)
    pairs = Counter((a, b) for t in train for a, b in zip([None, *t[:-1]], t))
    n, v = sum(count.values()), len(count)
    after = Counter(b for _, b in pairs)
    follow = defaultdict(list)
    for (a, _), c in pairs.items():
        follow[a].append(c)
    d2 = kneserney._discounts(*(sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)))
    d1 = kneserney._discounts(*(sum(c == k for c in after.values()) for k in (1, 2, 3, 4)))
    low = lambda w: max(after[w] - d1[min(after[w], 3)], 0) / len(pairs) + sum(d1[min(c, 3)] for c in after.values()) / len(pairs) / (v + 1)

    def p(a, b):
        if a not in follow:
            return low(b)
        s = sum(follow[a])
        return max(pairs[a, b] - d2[min(pairs[a, b], 3)], 0) / s + sum(d2[min(c, 3)] for c in follow[a]) / s * low(b)

    assert abs(sum(p(b"x", w) for w in count) + p(b"x", b"?") - 1) < 1e-9
    want = sorted((str(r.doc_id), held(r.doc_id), len(t := split(r.text)), sum(w in count for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 6), round(sum(math.log10(p(a, b)) for a, b in zip([None, *t[:-1]], t)), 6)) for r in rows)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in kneserney.score_documents(docs).collect())
    assert got == want
    assert kneserney.score_documents(docs.limit(0)).collect() == []


def test_media(docs):
    got = sorted(map(str, map(tuple, media.media_columns(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "width", "height").collect())))
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        pay = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want.append(str((r.doc_id, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]), 192, len(pay) // 192)))
    assert got == sorted(want)
    for data in (b"", b"x" * 192, bytes(range(192)) * 3):
        assert media.samples(media.to_image(media.padded(data))) == media.padded(data)
    with pytest.raises(ValueError):
        media.header(b"\0" * media.HEADER)
    assert media.media_columns(docs.limit(0)).collect() == []


def _counts(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_text_stats_and_rules(spark, docs):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = docs.unionByName(spark.createDataFrame([(7001, "a b\n\na b\n \nc #|<\n" * 3, "s", "d", 1), (7002, "p q r s t u v w " * 2 + "z", "s", "d", 1)], SCHEMA))
    got = sorted(map(str, map(tuple, textstats.text_stats(more).select(*names).collect())))
    assert got == sorted(str((r.doc_id, *_counts(r.text))) for r in more.collect())
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(200)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame([(k, " ".join(f"word{(k * 7 + i * 13) % 977}{'###' if k % 4 == 0 else ''}" for i in range(40)), "s") for k in range(200)], "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in rules.quality_rules(table, labels).collect()}
    assert kept == {k: k % 4 != 0 for k in range(200)}
    base = rules.quality_rules(more, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in base)
    assert {r.doc_id: r.base_failed for r in base if r.doc_id in (7001, 7002)} == {7001: True, 7002: True}
    assert rules.quality_rules(docs.limit(0), labels).collect() == []


def test_positive_unlabelled(spark, docs):
    bad = lambda k: k % 5 == 0
    labels = spark.createDataFrame([(k, int(not bad(k)), 0) for k in range(600) if k % 3], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame([(k, " ".join(f"{'WORD!!' if bad(k) else 'word'}{(k * 7 + i * 13) % 977}" for i in range(40)), "s") for k in range(600)], "doc_id long, text string, source string")
    rows = positive.classify(table, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.predicted == (not bad(r.doc_id)) for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len(positive.classify(docs, labels.limit(0)).collect()) == docs.count()
    assert positive.classify(docs.limit(0), labels).collect() == []


def _goals(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), {}
    while True:
        left = total - sum(capped.values())
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * size[s] for s in over}


def _mixed(docs, block, step):
    """(doc_id, text) to taken words, first slot and number of slots, slot by slot and word by word."""
    order = lambda s: (s is None, s or "")
    rows = mixing.sizes(docs).orderBy("source", "order").collect()
    circle, size = defaultdict(list), Counter()
    parts = {(r.s, r.part, r.order): r.start for r in mixing.laid_out(mixing.sizes(docs), mixing.targets(mixing.sizes(docs))).collect()}
    names = sorted({r.source for r in rows}, key=order)
    start = {(names[s], order_): at for (s, _, order_), at in parts.items()}
    for r in sorted(rows, key=lambda r: start[r.source, r.order]):
        circle[r.source] += [(r.doc_id, r.order)] * r["size"]
        size[r.source] += r["size"]
    goals = _goals({s: size[s] for s in names})
    total, shares, at = sum(goals.values()), [], 0.0
    for s in names:
        at += goals[s]
        shares.append((at / total, s))
    rank, taken, first, slots = Counter(), Counter(), {}, defaultdict(set)
    for k in range(round(total / block)):
        s = next((s for high, s in shares if k * step % 1 < high), shares[-1][1])
        for i in range(rank[s] * block, min((rank[s] + 1) * block, 3 * size[s])):
            doc = circle[s][i % size[s]]
            taken[doc] += 1
            first.setdefault(doc, k)
            slots[doc].add(k)
        rank[s] += 1
    return sorted(str((r.doc_id, r["size"], taken[r.doc_id, r.order], first.get((r.doc_id, r.order)), len(slots[r.doc_id, r.order]))) for r in rows), goals, size


@pytest.mark.parametrize("block, step", [(32, mixing.GOLDEN), (7, mixing.GOLDEN), (300, mixing.GOLDEN), (32, 0.5), (32, 0.123)])
def test_mixing_slot_by_slot(docs, block, step):
    docs = docs.distinct()  # equal rows may change places
    want = _mixed(docs, block, step)[0]
    got = mixing.mix(docs, block=block, step=step)
    assert sorted(str((r.doc_id, r["size"], r.taken, r.first_slot, r.n_slots)) for r in got.collect()) == want


def test_the_sequence_makes_the_mix(docs):
    one, two = (mixing.mix(docs, step=step).groupBy("source").sum("taken").collect() for step in (mixing.GOLDEN, 0.5))
    assert sorted(map(str, one)) != sorted(map(str, two))
    copies = lambda step: Counter(r.doc_id for r in mixing.repeated_documents(docs, step=step).collect())
    assert copies(mixing.GOLDEN) != copies(0.5)


def test_mixing(docs):
    rows = mixing.mix_documents(docs)
    got = rows.collect()
    size, of = Counter(), {}
    for r in docs.collect():
        size[r.source] += len((r.text or "").encode().split())
        of[r.doc_id] = r.source
    goals = _goals(dict(size))
    assert len(got) == docs.count()
    taken = Counter()
    for r in got:
        if r.doc_id is not None:
            s = of[r.doc_id]
            assert r.source_size == size[s] and abs(r.target - goals[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"] and (r.first_slot is None) == (r.taken == 0) == (r.n_slots == 0)
        taken[r.target] += r.taken
    for s in size:
        # a golden-ratio sequence is within a few points of any share
        assert abs(taken[next(t for t in taken if abs(t - goals[s]) < 1e-6)] - goals[s]) <= 3 * mixing.BLOCK
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(docs.repartition(2)).collect()))
    goal_rows = mixing.targets(mixing.sizes(docs))
    plan = mixing.ranked(mixing.schedule(goal_rows)).orderBy("slot").collect()
    assert [r.slot for r in plan] == list(range(round(sum(goals.values()) / mixing.BLOCK)))
    share = sum(goals.values())
    for s, name in enumerate(sorted(size, key=lambda s: (s is None, s or ""))):
        seen = sum(r.s == s for r in plan[: len(plan) // 2]) / (len(plan) // 2)
        assert abs(seen - goals[name] / share) < 0.15
        assert [r.rank for r in plan if r.s == s] == list(range(sum(r.s == s for r in plan)))
    assert mixing.mix_documents(docs.limit(0)).collect() == []


def test_pii(spark, docs):
    rows = [
        (1, "mail ann.34@mail7.example.com or +1 (017) 555-7713, ip 188.54.39.104.", "s", "d", 1),
        (2, "MAIL ANN.34@MAIL7.EXAMPLE.COM!! card 4111 1111 1111 1111 and 4757965300669737 v2.0.1 3.", "s", "d", 1),
        (3, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" Mrs. Anna Müller met Herr Schmidt. ip 188.54.39.104', "s", "d", 1),
        (4, 'again ann.34@mail7.example.com 123-45-6789 "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"###', "s", "d", 1),
        (5, "Господин Иванов и 2024-01-02 12:30, 1,000,000.00", "s", "d", 1),
        (6, " ".join(f"10.0.{k // 256}.{k % 256}" for k in range(1500)), "s", "d", 1),
    ]
    df = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    got = pii.replace_private(df)
    assert got.columns == [*df.columns, "n_private"]
    text = {r.doc_id: (r.text, r.n_private) for r in got.where("doc_id in (1,2,3,4,5,6) and data = 'd' and source = 's'").collect()}
    plain = {r.doc_id: r.text for r in df.collect()}
    out = sorted(str((r.doc_id, r.text)) for r in got.where("n_private = 0").collect())
    assert len(out) == docs.count() + 0 or len(out) >= docs.count() - 2
    assert all(r.text == plain[r.doc_id] for r in got.where("n_private = 0 and doc_id is not null").collect() if r.doc_id > 6)
    assert [text[k][1] for k in range(1, 7)] == [3, 3, 4, 3, 1, 1500], text
    for k in range(1, 6):
        for secret in ("ann.34", "ANN.34", "555-7713", "188.54.39.104", "4111 1111 1111 1111", "4757965300669737", "b44e15e09fd", "Müller", "Schmidt", "123-45-6789", "9233A8ECF7", "Иванов"):
            assert secret not in text[k][0], (secret, text[k][0])
    import re

    mail = re.search(r"mail (\S+@\S+)", text[1][0])[1]
    assert mail in text[4][0]
    ip = re.search(r"ip (\S+?)\.$", text[1][0])[1]
    assert ip in text[3][0]
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})", text[2][0])
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10
    assert luhn(card[1].replace(" ", "")) == 0 and luhn(card[2]) == luhn("4757965300669737")
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}, ip", text[1][0])
    assert re.search(r'"[0-9a-f]{40}" Mrs\. [A-Z]\w+ [A-Z]\w+ met Herr [A-Z]\w+\.', text[3][0])
    assert re.search(r"Господин [А-Я]\w+ и 2024-01-02 12:30, 1,000,000.00", text[5][0])
    ips = text[6][0].split(" ")
    assert len(set(ips)) == 1500 and not set(ips) & set(rows[5][1].split(" "))
    assert pii.replace_private(df.limit(0)).collect() == []
