"""Driver contract and physical-plan properties."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as E
from fairlend.plans import catalog
from tests.conftest import ROOT, SF001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["state_code", "county_code", "total_applications", "advantaged_n",
                          "disadvantaged_n", "advantaged_approval_rate",
                          "disadvantaged_approval_rate", "approval_disparity_gap"]


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 55


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, with_pipeline):
    """A copy without ``fairlend/llm`` (and without the pipeline) still offers every other query."""
    shutil.copytree(f"{ROOT}/fairlend", tmp_path / "fairlend", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if with_pipeline else [])]:
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    code = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()), sorted(E.queries()) == sorted(E.QUERIES))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)},
                         capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert run.stdout.split()[0] == str(len(catalog.QUERIES)) and run.stdout.split()[2] == "True"


def test_flagship_is_top_k_with_one_aggregate_exchange(spark):
    plan = _plan(catalog.county_gap_top25(spark, SF001))
    assert "TakeOrderedAndProject" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("Exchange hashpartitioning(state_code") == 1


def test_county_stats_partial_aggregation(spark):
    df = catalog.county_stats(spark, SF001)
    plan = _plan(df)
    assert "partial_count" in plan or "partial_sum" in plan


def test_no_cartesian_products_anywhere(spark):
    for name, fn in catalog.QUERIES.items():
        plan = _plan(fn(spark, SF001))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_regression_metrics_exchanges_no_rows_by_county(spark):
    df = catalog.regression_metrics(spark, SF001)
    df.collect()
    plan = _plan(df)
    assert "hashpartitioning(county_code" not in plan.split("== Initial Plan ==")[0]


def test_size_shuffles(spark):
    from fairlend.plans.session import size_shuffles
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_shuffles(spark, 10) == spark.sparkContext.defaultParallelism
        assert size_shuffles(spark, 100 * 1024 ** 4) == 100 * 1024 ** 4 // (128 * 1024 ** 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_county_stats_has_one_hash_exchange(spark):
    plan = _plan(catalog.county_stats(spark, SF001))
    assert plan.count("Exchange hashpartitioning") == 1


def test_county_map_join_becomes_broadcast_at_run_time(spark):
    df = catalog.county_left_join(spark, SF001)
    df.collect()  # AQE re-plans with the real sizes of both sides
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    final = plan.split("== Initial Plan ==")[0]
    joins = [ln for ln in final.splitlines() if "Join" in ln and "LeftOuter" in ln]
    assert joins and all("BroadcastHashJoin" in ln and "BuildRight" in ln for ln in joins), joins
