"""Distributed order statistics against brute force on small fixtures."""

import random

import numpy as np
import pytest

from fairlend.functions.ordered import exact_quantiles, grouped_quantiles, prefix_sums, rank_sum_auc
from fairlend.operators import metrics


def _brute_auc(labels, scores):
    pos = [s for l, s in zip(labels, scores) if l == 1]
    neg = [s for l, s in zip(labels, scores) if l != 1]
    if not pos or not neg:
        return None
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_quantiles_match_numpy_with_heavy_value(spark):
    rnd = random.Random(7)
    # a third of all rows hold one value; the rest have ties and spread
    vals = [5.0] * 700 + [float(rnd.randint(0, 300)) for _ in range(1400)] + [rnd.random() for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,), (float("nan"),)], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, "x", probs, buckets=8).first()
    want = np.quantile(np.array(vals), probs)
    assert got["n"] == len(vals)
    for i, w in enumerate(want):
        assert abs(got[f"q_{i}"] - w) < 1e-9


def test_grouped_quantiles(spark):
    rows = [("a", float(i)) for i in range(11)] + [("b", float(i * i)) for i in range(6)]
    out = {r["g"]: r for r in grouped_quantiles(spark.createDataFrame(rows, "g string, x double"),
                                               "x", [0.5, 0.25], by=["g"], buckets=3).collect()}
    assert out["a"]["q_0"] == 5.0 and out["a"]["q_1"] == 2.5
    assert abs(out["b"]["q_0"] - np.quantile([0, 1, 4, 9, 16, 25], 0.5)) < 1e-12


def test_prefix_sums_match_cumsum(spark):
    rnd = random.Random(3)
    rows = [(float(v), rnd.randint(1, 5)) for v in rnd.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "v double, w long")
    got = {r.v: r.w_before for r in prefix_sums(df, "v", ["w"], buckets=7).collect()}
    acc = 0
    for v, w in sorted(rows):
        assert got[v] == acc
        acc += w


def test_auc_brute_force_ties(spark):
    rnd = random.Random(11)
    labels = [rnd.randint(0, 1) for _ in range(400)]
    scores = [float(rnd.randint(0, 20)) for _ in range(400)]
    df = spark.createDataFrame(list(zip(labels, scores)), "y int, s double")
    got = rank_sum_auc(df, "y", "s", buckets=5).first()["auc"]
    assert abs(got - _brute_auc(labels, scores)) < 1e-12


def test_auc_edge_cases(spark):
    all_tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5)], "y int, s double")
    assert rank_sum_auc(all_tied, "y", "s").first()["auc"] == 0.5
    perfect = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1)], "y int, s double")
    assert rank_sum_auc(perfect, "y", "s").first()["auc"] == 1.0
    one_class = spark.createDataFrame([(1, 0.9), (1, 0.8)], "y int, s double")
    assert rank_sum_auc(one_class, "y", "s").first()["auc"] is None


def test_auc_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rnd = random.Random(5)
    rows = [(float(rnd.randint(0, 1)), float(rnd.randint(0, 50)) / 10) for _ in range(500)]
    df = spark.createDataFrame(rows, "y double, s double")
    ev = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0)
    assert abs(ev.evaluate(df) - rank_sum_auc(df, "y", "s").first()["auc"]) < 1e-12


def test_regression_metrics(spark):
    rows = [(1.0, 1.5), (2.0, 1.5), (3.0, 3.5), (4.0, 3.5)]
    m = metrics.regression_metrics(spark.createDataFrame(rows, "y double, p double"), "y", "p").first()
    y = np.array([r[0] for r in rows]); p = np.array([r[1] for r in rows])
    sse = ((y - p) ** 2).sum()
    assert abs(m.r2 - (1 - sse / ((y - y.mean()) ** 2).sum())) < 1e-12
    assert abs(m.rmse - np.sqrt(sse / 4)) < 1e-12


def test_binary_accuracy(spark):
    rows = [(1, 0.9, 1), (0, 0.2, 1), (1, 0.4, 0), (0, 0.1, 0)]
    m = metrics.binary_metrics(spark.createDataFrame(rows, "y int, s double, p int"), "y", "s", "p").first()
    assert m.accuracy == 0.5 and m.auc == 1.0


def test_grouped_quantiles_many_buckets(spark):
    rnd = random.Random(19)
    rows = [("a", float(rnd.randint(0, 5000))) for _ in range(3000)] + \
           [("b", rnd.random()) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.1, 0.5, 0.99]
    got = {r["g"]: r for r in grouped_quantiles(df, "x", probs, by=["g"], buckets=70).collect()}
    for g in ("a", "b"):
        vals = np.array([x for k, x in rows if k == g])
        for i, w in enumerate(np.quantile(vals, probs)):
            assert abs(got[g][f"q_{i}"] - w) < 1e-9


def test_range_count_has_a_floor_and_no_maximum(spark):
    from fairlend.functions.ordered import MIN_RANGES, range_count
    assert range_count(spark.range(1)) >= MIN_RANGES == 8
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "100000")
        assert range_count(spark.range(1)) == 100_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("buckets", [1, 3, 40, None])
def test_nan_and_infinity_do_not_depend_on_the_ranges(spark, buckets):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1), (1, nan), (0, nan), (1, inf), (0, -inf), (1, -inf), (0, 0.7)] * 5
    ranked = [(y, inf if s != s else 1e300 if s == inf else s) for y, s in rows]
    df = spark.createDataFrame(rows, "y int, s double")
    got = rank_sum_auc(df, "y", "s", buckets=buckets).first()["auc"]
    assert abs(got - _brute_auc([y for y, _ in ranked], [s for _, s in ranked])) < 1e-12
    q = exact_quantiles(df, "s", [0.0, 0.1, 0.5, 1.0], buckets=buckets).first()
    vals = sorted(s for _, s in rows if s == s)
    assert (q.n, q.q_0, q.q_3) == (len(vals), -inf, inf) and q.q_1 == -inf
    assert q.q_2 == (vals[len(vals) // 2 - 1] + vals[len(vals) // 2]) / 2


def test_materialize_is_reliable_checkpoint(spark):
    import pathlib
    from fairlend.functions.lineage import materialize
    df = materialize(spark.range(100).selectExpr("id % 7 AS k").groupBy("k").count())
    assert df.count() == 7
    plan = df._jdf.queryExecution().logical().toString()
    assert "LogicalRDD" in plan  # lineage cut: reads the checkpoint files
    root = pathlib.Path(__file__).resolve().parents[1] / "fairlend"
    for f in root.rglob("*.py"):
        assert "localCheckpoint" not in f.read_text(), f


def test_ranges_by_default_exact(spark):
    rnd = random.Random(23)
    rows = [("a", float(rnd.randint(0, 10**6))) for _ in range(2000)] + \
           [("b", rnd.random()) for _ in range(800)] + [("tiny", 1.0), ("tiny", 2.0), ("tiny", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.25, 0.5, 0.9]
    got = {r["g"]: r for r in grouped_quantiles(df, "x", probs, by=["g"]).collect()}
    for g in ("a", "b", "tiny"):
        vals = np.array([x for k, x in rows if k == g])
        for i, w in enumerate(np.quantile(vals, probs)):
            assert abs(got[g][f"q_{i}"] - w) < 1e-9, (g, i)
    vals = np.array([x for k, x in rows if k == "a"])
    one = exact_quantiles(df.where("g = 'a'"), "x", probs).first()
    for i, w in enumerate(np.quantile(vals, probs)):
        assert abs(one[f"q_{i}"] - w) < 1e-9


def test_groups_exact_for_any_ranges(spark):
    from fairlend.functions import ordered
    rnd = random.Random(29)
    rows = [("a", float(rnd.randint(0, 10**6))) for _ in range(2000)] + \
           [("b", rnd.random()) for _ in range(1000)] + [("tiny", 3.0), ("tiny", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.33, 0.5, 0.999, 1.0]
    for buckets in (None, 1, 100):
        counts = ordered.value_counts_table(df, "x", ["g"], buckets)
        got = {r["g"]: r for r in ordered.quantiles_from_counts(counts, probs, ["g"]).collect()}
        for g in ("a", "b", "tiny"):
            vals = np.array([x for k, x in rows if k == g])
            for i, w in enumerate(np.quantile(vals, probs)):
                assert abs(got[g][f"q_{i}"] - w) < 1e-9, (buckets, g, i)
    pre = ordered.prefix_sums(counts, "v", ["c"], by=["g"]).collect()
    for g in ("a", "b"):
        acc = 0
        for r in sorted((r for r in pre if r.g == g), key=lambda r: r.v):
            assert r.c_before == acc
            acc += r.c
