"""Radix selection against numpy and the number's own bits."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlend.functions import lineage, radix
from fairlend.operators import describe, profile
from fairlend.plans import fixture as fx
from tests.conftest import SF001

INF, NAN = float("inf"), float("nan")


def bits(x):
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_order_key_is_the_number_s_bits(spark):
    rng = np.random.default_rng(4)
    xs = [s * m * 2.0 ** e for e in range(-1074, 1024) for s in (1.0, -1.0) for m in (1.0, 1.0 + 2.0 ** -52)]
    xs += [x * (1 - 2.0 ** -53) for x in xs] + [0.0, -0.0, INF, -INF, 5e-324, -5e-324, 1.7976931348623157e308, 0.1, 1e-310]
    raw = rng.integers(0, 2 ** 63, 20_000, dtype=np.int64)
    xs += [float(x) for x in raw.view(np.float64) if not np.isnan(x)]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = radix.with_order_key(df, "x", "k").collect()
    assert len(got) == len(xs) and [r.k for r in got] == [bits(r.x) for r in got]


def test_order_key_of_null_and_nan(spark):
    df = spark.createDataFrame([(None,), (NAN,)], "x double")
    assert [r.k for r in radix.with_order_key(df, "x", "k").collect()] == [None, None]


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("seed", range(4))
def test_summaries_equal_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(0, 10.0 ** (seed * 3 - 3), 500)
    b = np.concatenate([np.full(300, 7.5), rng.integers(-4, 5, 300) / 4, rng.lognormal(0, 40, 299)])  # 7.5: a third
    n = max(len(a), len(b))
    rows = [(float(a[i]) if i < len(a) else None, float(b[i]) if i < len(b) else NAN, "x") for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, m string").repartition(3)
    for x, s in zip((a, b), radix.summarize(df, ["a", "b"], PROBS)):
        assert (s.n, s.least, s.greatest) == (len(x), x.min(), x.max())
        np.testing.assert_allclose([s.mean, s.stddev], [x.mean(), x.std(ddof=1)], rtol=1e-9)
        np.testing.assert_allclose(s.quantiles, np.quantile(x, PROBS), rtol=1e-12)


def test_neighbouring_numbers_need_the_last_digit(spark):
    xs = [1.0 + k * 2.0 ** -52 for k in range(40)] + [-(1.0 + k * 2.0 ** -52) for k in range(41)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = radix.summarize(df, ["x"], [k / 80 for k in range(81)])[0]
    assert got.quantiles == sorted(xs)


def test_infinities_zeros_and_nan(spark):
    xs = [-INF, -INF, -0.0, 0.0, 0.0, 1.0, INF]
    df = spark.createDataFrame([(x,) for x in [*xs, NAN, None]], "x double")
    s = radix.summarize(df, ["x"], [0.0, 1 / 6, 1 / 3, 0.5, 5 / 6, 1.0])[0]
    assert s.quantiles == [-INF, -INF, 0.0, 0.0, 1.0, INF]
    assert s.n == 7 and np.isnan(s.mean) and np.isnan(s.stddev)
    assert str(s.quantiles[2]) == "0.0"


def test_one_value_none_and_no_rows(spark):
    df = spark.createDataFrame([(2.5, None)], "a double, b double")
    a, b = radix.summarize(df, ["a", "b"], [0.5])
    assert (a.n, a.mean, a.stddev, a.quantiles) == (1, 2.5, None, [2.5])
    assert (b.n, b.mean, b.quantiles) == (0, None, [None])
    assert radix.summarize(df.limit(0), ["a"], [0.5])[0].n == 0
    rows = profile.summary_long(df.limit(0), ["a"]).collect()
    assert [r.value for r in rows] == [0.0] + [None] * 7


def test_equal_values_end_after_one_pass(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(radix, "next_pass", lambda *a: passes.append(a))
    df = spark.range(1000).select(F.lit(3.25).alias("x"))
    assert radix.summarize(df, ["x"], [0.25, 0.5])[0].quantiles == [3.25, 3.25] and not passes


def test_passes_are_narrow(spark, monkeypatch):
    """One exchange of counters by hash a pass; no range exchange, no checkpoint."""
    def refused(*_):
        raise AssertionError("checkpoint")
    monkeypatch.setattr(lineage, "materialize", refused)
    monkeypatch.setattr("pyspark.sql.DataFrame.checkpoint", refused)
    long = radix._long(describe.add_loan_to_income(fx.applications(spark, SF001), None), ["income", "loan_to_income"])
    for df in (radix.first_pass(long), radix.next_pass(long, 1, {0: [16_400], 1: [16_401, 16_402]})):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "partial_count" in plan
        assert sum("Exchange hashpartitioning(m#" in line for line in plan.splitlines()) <= 2
    assert describe.summary_statistics(fx.applications(spark, SF001)).count() == 32
