from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from cytolake.llm import bpe, positive
from tests.llm.test_jaccard import _brute


def test_stages_by_hand(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.read.parquet(f"{d}/labels.parquet")
    predicted = Counter()
    for r in positive.classify(docs, labels).collect():
        predicted[r.doc_id] = max(predicted[r.doc_id], r.predicted)
    one = corpus_pipeline.quality_classifier(spark, docs, d).cache()
    assert one.columns == docs.columns
    assert {r.doc_id for r in one.collect()} == {k for k, v in predicted.items() if v}
    two = corpus_pipeline.simhash_near_dedup(spark, one, d).cache()
    near = _brute({r.doc_id if r.doc_id is not None else 10**6 + k: r.text for k, r in enumerate(one.collect())})
    assert sorted(r.doc_id for r in two.collect()) == sorted(set(near.values()))  # a null doc_id's text is another one's too
    three = corpus_pipeline.pii_surrogates(spark, two, d).cache()
    assert three.columns == docs.columns and three.count() == two.count()
    assert not three.where(r"text rlike '@mail\\d'").count()
    four = corpus_pipeline.source_mix(spark, three, d).cache()
    assert four.columns == docs.columns
    times = Counter(r.doc_id for r in four.collect())
    assert max(times.values()) <= 3
    words, before = Counter(), Counter()
    size = lambda t: len((t or "").encode().split())
    for r in three.collect():
        before[r.source] += size(r.text)
        words[r.source] += times[r.doc_id] * size(r.text)
    from tests.llm.test_operators import _goals

    longest = max(size(r.text) for r in three.collect())
    for s, goal in _goals(dict(before)).items():
        assert abs(words[s] - goal) <= longest + 1
    five = corpus_pipeline.byte_level_bpe(spark, four, d)
    assert sorted(map(str, five.collect())) == sorted(map(str, bpe.encode_documents(four).collect()))


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, id long"
    long_ = " ".join(f"w{k % 9973}x{k // 7}" for k in range(120_000))
    rows = [(1, None, None, None, None, "a", 1), (None, None, "en", "s", 0, None, None), (2, "", "en", "s", 0, "b", 2), (3, long_, "en", "s", 9, "c", 3), (4, long_ + " end", "en", "t", 9, "d", 4)]
    rows += [(5, "one two three four five six seven", "en", "s", 1, "e", 5)] * 3 + [(5, "quite another text under this very id", "en", "s", 1, "e", 5)]
    docs, d = spark.createDataFrame(rows, schema), "/root/testdata/sf0.001"
    two = corpus_pipeline.simhash_near_dedup(spark, docs, d)
    assert two.columns == docs.columns
    assert sorted((r.doc_id, len(r.text or "")) for r in two.collect()) == sorted([(1, 0), (3, len(long_)), (5, 33), (5, 37)])
    four = corpus_pipeline.source_mix(spark, docs, d).collect()
    assert {r.doc_id for r in four} <= {3, 4, 5} and max(Counter(four).values()) <= 9
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).collect() == []
        stage(spark, docs, d).collect()


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50
