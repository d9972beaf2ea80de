import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from fairlend.llm import toxicity
from fairlend.llm.toxicity import learn_toxicity, score_toxicity, toxicity_report, train, word_grams

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("toxic", T.StringType()), T.StructField("score", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()),
                       T.StructField("text", T.StringType())])


def made(n=600):
    rng = random.Random(1)
    plain = ["".join(rng.choice("abeinorst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        bad = i % 4 == 0
        if bad:
            for _ in range(max(1, len(words) // 25)):
                words.insert(rng.randrange(len(words)), "zugwak" + rng.choice(["", "ei", "ung", "ste", "x" * (i % 5)]))
        docs.append((i, " ".join(words), "9", "9"))
        labels.append((i, int(bad), "x"))
    return docs, labels


def test_held_out_accuracy_and_unseen_spellings(spark):
    docs, labels = made()
    extra = [(-1, "", None, None), (-2, None, None, None), (None, "a word", None, None), (-3, "abein " * 40_000, "", ""),
             (-4, "norst abe zugwakko nit zugwagk sor bei", "", ""), (5, docs[5][1], "", "")]
    df = spark.createDataFrame(docs + extra, DOCS).repartition(3)
    lab = spark.createDataFrame(labels + [(None, 1, ""), (1, None, ""), (2, 7, ""), (99_999, 1, "")], LABELS)
    got = toxicity_report(df, lab).collect()
    assert len(got) == len(docs) + len(extra) and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    by = {r.doc_id: r for r in got}
    for r in got:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    test = [(by[i].predicted, y) for i, y, _ in labels if by[i].held_out]
    assert np.mean([p == y for p, y in test]) > 0.95
    assert by[-4].predicted == 1 and by[-1].score == by[-2].score and by[-1].predicted == 0
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    again = {r.doc_id: r.score for r in toxicity_report(df.repartition(2), lab).collect()}
    assert again == pytest.approx({r.doc_id: r.score for r in got})


def test_held_out_labels_are_not_read(spark):
    docs, labels = made(120)
    df = spark.createDataFrame(docs, DOCS)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, y, t in labels]
    a, b = (learn_toxicity(df, spark.createDataFrame(x, LABELS)) for x in (labels, flipped))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_no_rows_one_label_and_grams(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert toxicity_report(none, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "", "")], DOCS)
    assert toxicity_report(one, labels).first().predicted == 0
    assert train(["x y"], [1]).bias > 0
    buckets, ends = word_grams(["abc", "...", "Abc!"])
    assert buckets[:ends[0]].tolist() == buckets[ends[1]:].tolist() and ends[0] == 3 + 2 + 1 + 1
    kept = score_toxicity(one, train([], []))
    assert kept.columns == ["doc_id", "text", "toxic", "score"]


def test_long_texts_and_repeated_labels_teach(spark, monkeypatch):
    docs, labels = made(200)
    docs = [(i, t + " " + " ".join(t.split() * (20_000 // len(t))), a, b) for i, t, a, b in docs]
    assert min(len(t) for _, t, *_ in docs) > 16_384
    df = spark.createDataFrame(docs, DOCS)
    once = learn_toxicity(df, spark.createDataFrame(labels, LABELS))
    by = {r.doc_id: r.score for r in score_toxicity(df.select("doc_id", "text"), once).collect()}
    assert np.mean([(by[i] >= 0.5) == bool(y) for i, y, _ in labels]) > 0.95
    monkeypatch.setattr(toxicity, "TOXIC_ROWS", 60)
    repeated = learn_toxicity(df, spark.createDataFrame([x for x in labels for _ in range(5)], LABELS))
    assert (repeated.weights == once.weights).all() and repeated.bias == once.bias
