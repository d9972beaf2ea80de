import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from fairlend.llm import topk_search
from fairlend.llm.topk_search import ORACLE, top_k

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("label", T.IntegerType()), T.StructField("n", T.StringType()),
                       T.StructField("score", T.StringType())])


def brute(rows, k=5):
    whole = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = min(v, whole.get(i, v))
    whole = {i: [math.floor(256.0 * x) for x in v] for i, v in whole.items()}
    out = []
    for q, v in whole.items():
        if q % 50 == 0:
            hits = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -2**63), 2**63 - 1), c)
                          for c, w in whole.items() if c != q and len(w) == len(v))[:k]
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(hits, 1)]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    df = df.withColumnRenamed("embedding", "vector")
    return df, top_k(df.where("vec_id % 50 = 0"), df)


@pytest.mark.parametrize("sizes", [(32_768, 65_536, 1_024, 2_048, 16), (2, 40, 7, 3, 2)])
def test_brute_force_with_ties_nulls_and_repeats(spark, monkeypatch, sizes):
    for name, size in zip(("PANEL", "SHARD", "PACK", "TILE", "FAN_IN"), sizes):
        monkeypatch.setattr(topk_search, name, size)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(301)]  # many ties
    rows += [(400, [1.0, None, 0.0, 0.0]), (450, None), (None, [1.0] * 4), (500, [float("nan")] * 4), (550, []),
             (551, []), (600, [0.5, 0.25]), (601, [0.1, -0.1]), (50, rows[50][1]), (7, rows[7][1]), (8, [9.0] * 4)]
    rows += [(-50, [0.3, 0.2, 0.1, -0.7]), (700, [1e9] * 4), (701, [1e15, 1.0, 1.0, 1.0])]
    df, got = run(spark, rows)
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows))
    keep = [r for r in rows if r[0] is not None and r[0] < 700 and r[0] != 8]
    _, got = run(spark, keep)
    embeddings = spark.createDataFrame([(i, v, 0, "", "") for i, v in keep], SCHEMA).select(  # noqa: F841
        "vec_id", "embedding").distinct().toArrow()
    assert Counter(duckdb.connect().sql(ORACLE).fetchall()) == Counter(map(tuple, got.collect()))


def test_empty_tables_and_few_candidates(spark):
    assert run(spark, [])[1].count() == 0
    assert run(spark, [(50, [1.0])])[1].count() == 0
    assert run(spark, [(50, [1.0]), (1, [-1.0]), (2, [2.0])])[1].orderBy("rank").collect() == [
        (50, 1, 2, 2 * 65536), (50, 2, 1, -65536)]
    assert [f.dataType.simpleString() for f in run(spark, [(50, [1.0])])[1].schema] == ["bigint", "int", "bigint", "bigint"]
