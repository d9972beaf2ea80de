import math

import numpy as np
import pytest
from pyspark.sql import types as T

from fairlend.llm import embedding_dedup
from fairlend.llm.embedding_dedup import near_duplicates

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType())),
                       T.StructField("label", T.IntegerType()), T.StructField("rep", T.StringType()),
                       T.StructField("bucket", T.StringType())])


def brute(rows, least=0.93):
    good = [v is not None and i is not None and lab is not None and len(v) > 0
            and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    links, low = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                p, q = np.array(rows[a][1]), np.array(rows[b][1])
                p, q = p / np.abs(p).max(), q / np.abs(q).max()
                if p @ q / math.sqrt((p @ p) * (q @ q)) >= least:
                    links[a] += 1
                    links[b] += 1
                    low[root(a)] = root(b)
    first = {}
    for k, (i, *_ ) in enumerate(rows):
        if i is not None:
            first[root(k)] = min(i, first.get(root(k), i))
    return [(i, links[k], first.get(root(k)), None if i is None else i == first[root(k)])
            for k, (i, *_) in enumerate(rows)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def made(n=160, dim=16):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(n // 8, dim))
    rows = [(i, (centres[i % len(centres)] + rng.normal(size=dim) * 0.1).tolist(), i % 3) for i in range(n)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(40)]  # exact copies
    rows += [(2000 + i, (np.array(rows[6][1]) + rng.normal(size=dim) * 1e-4).tolist(), rows[6][2]) for i in range(60)]
    rows += [(3000, None, 1), (3001, [0.0] * dim, 1), (3002, [float("nan")] * dim, 1), (3003, [None] + [1.0] * 15, 1),
             (3004, [], 1), (3005, rows[0][1], None), (None, rows[0][1], 0), (3006, [1.0, 0.0], 0), (3007, [2.0, 0.1], 0),
             (3008, [1e300, 0.0], 0), (1, rows[1][1], 1), (2, rows[1][1], 1)]
    return rows


@pytest.mark.parametrize("cell", [1024, 9])
def test_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    rows = made()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = near_duplicates(df).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(11)
    dim, pairs = 64, 1500
    a = rng.normal(size=(pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=(pairs, dim))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.931, 0.98, size=(pairs, 1))
    b = cos * a + np.sqrt(1 - cos ** 2) * side
    rows = [(i, v.tolist(), 0, "", "") for i, v in enumerate(np.concatenate([a, b]))]
    linked = near_duplicates(spark.createDataFrame(rows, SCHEMA)).where("n_links > 0").count()
    assert linked >= 0.95 * 2 * pairs


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).columns == ["vec_id", "n_links", "component_id", "kept"] and near_duplicates(df).count() == 0
