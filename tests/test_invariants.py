"""Invariants of the study's saved outputs, checked on the sf0.01 fixture."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairlend.functions.ordered import exact_quantiles
from fairlend.operators import describe, gaps
from fairlend.plans import fixture as fx
from tests.conftest import SF01


@pytest.fixture(scope="module")
def apps(spark):
    return fx.applications(spark, SF01).cache()


def test_group_counts_sum_to_total(apps):
    total = apps.count()
    assert describe.approval_by_race(apps).agg(F.sum("applications")).first()[0] == total
    assert describe.loan_type_approval(apps).agg(F.sum("applications")).first()[0] == total


def test_sides_add_up_and_null_gaps_only_when_one_side_empty(apps):
    g = gaps.county_gaps(apps, min_n=0).collect()
    assert all(r.advantaged_n + r.disadvantaged_n == r.total_applications for r in g)
    nulls = [r for r in g if r.approval_disparity_gap is None]
    assert nulls and all(r.advantaged_n == 0 or r.disadvantaged_n == 0 for r in nulls)
    kept = gaps.county_gaps(apps).collect()
    assert kept and all(r.approval_disparity_gap is not None for r in kept)
    assert any(r.approval_disparity_gap < 0 for r in g if r.approval_disparity_gap is not None)


def test_top25_is_prefix_of_full_ordering(apps):
    full = gaps.county_gaps(apps)
    ordered = [(r.state_code, r.county_code) for r in full.orderBy(*gaps.gap_order()).collect()]
    top = [(r.state_code, r.county_code) for r in gaps.top_gaps(full).collect()]
    assert top == ordered[:25]


def test_rates_are_means_of_the_label(apps):
    by_year = {r.activity_year: r.approval_rate for r in describe.approval_over_time(apps).collect()}
    for y, rate in by_year.items():
        sub = apps.where(F.col("activity_year") == y)
        assert abs(rate - sub.agg(F.avg("approved")).first()[0]) < 1e-12


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=60),
       st.floats(min_value=0.0, max_value=1.0))
def test_exact_quantile_property(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = exact_quantiles(df, "x", [p]).first()["q_0"]
    assert abs(got - float(np.quantile(np.array(values, dtype=float), p))) < 1e-9
