import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from fairlend.llm import quality
from fairlend.llm.quality import KEEP, resample, top_k_flag
from fairlend.llm.repeats import gram_hashes

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("quality", T.StringType()), T.StructField("key", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                       T.StructField("text", T.StringType())])


def buckets(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    raw = np.array([b + 32 if 65 <= b <= 90 else b for b in raw.tolist()], np.uint8)
    return [int(gram_hashes(raw[i:i + 4], 4)[0] % np.uint64(quality.BUCKETS)) for i in range(len(raw) - 3)]


def made():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(200):
        good = i % 5 != 0
        w = [rng.choice(words) for _ in range(rng.randint(10, 60))]
        docs.append((i, " ".join(w if good else [x + "***" for x in w]), "x", "y"))
        if i % 2 == 0:
            labels.append((i, int(good), "z"))
    docs += [(500, None, "", ""), (501, "", "", ""), (502, "abc", "", ""), (None, "abcdefg", "", ""),
             (503, "ab " * 30_000, "", ""), (7, docs[7][1], "", "")]
    return docs, labels + [(None, 1, ""), (999, 1, ""), (3, None, "")]


def test_weights_sample_and_held_out(spark):
    docs, labels = made()
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    got = resample(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs) and sum(r.kept for r in got) == int(KEEP * len(docs))
    assert min(r.key for r in got if r.kept) >= max(r.key for r in got if not r.kept)
    ids = {i for i, q, _ in labels if q == 1 and i is not None and zlib.crc32(str(i).encode()) % 5}
    target, raw = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, t, *_ in docs:
        for b in buckets(t):
            raw[b] += 1
            target[b] += i in ids
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = sorted((i is None, i or 0, len(buckets(t)), sum(ratio[b] for b in buckets(t))) for i, t, *_ in docs)
    have = sorted((r.doc_id is None, r.doc_id or 0, r.n_grams, r.log_weight) for r in got)
    assert [w[:3] for w in want] == [h[:3] for h in have]
    assert [h[3] for h in have] == pytest.approx([w[3] for w in want])
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].kept for i in range(200) if i % 5]) > 0.9 > 0.5 > np.mean([by[i].kept for i in range(0, 200, 5)])
    again = resample(df.repartition(2), spark.createDataFrame(labels, LABELS))
    assert sorted((str(r.doc_id), r.kept) for r in again.collect()) == sorted((str(r.doc_id), r.kept) for r in got)


def test_gumbel_noise_is_standard(spark):
    u = spark.range(20_000).select(quality.gumbel(F.col("id"), F.lit(3)).alias("g")).agg(F.avg("g"), F.var_samp("g")).first()
    assert u[0] == pytest.approx(0.5772, abs=0.03) and u[1] == pytest.approx(math.pi ** 2 / 6, abs=0.07)


@pytest.mark.parametrize("at_cut,bins", [(10_000, 1_024), (3, 4), (1, 2)])
def test_top_k_flag(spark, monkeypatch, at_cut, bins):
    monkeypatch.setattr(quality, "AT_CUT", at_cut)
    monkeypatch.setattr(quality, "BINS", bins)
    rng = random.Random(5)
    rows = [(i, float(rng.choice([rng.random(), 1e6 * rng.random(), -3.0, 0.25]))) for i in range(120)] + [(None, 0.25)]
    df = spark.createDataFrame(rows, "doc_id long, key double").repartition(3)
    order = sorted(rows, key=lambda r: (-r[1], r[0] is not None, r[0] or 0))
    for k in (0, 1, 40, 77, 121):
        got = {r.doc_id for r in top_k_flag(df, "key", ["doc_id"], k, "kept").collect() if r.kept}
        assert got == {i for i, _ in order[:k]}


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert resample(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "text here", "", ""), (2, "more", "", "")], DOCS)
    assert [r.log_weight for r in resample(one, labels).collect()] == [0.0, 0.0]
