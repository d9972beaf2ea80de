"""The column profile against counting, and the describe and profile jobs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fairlend.operators import describe, profile
from fairlend.plans import fixture as fx
from fairlend.plans import jobs
from fairlend.plans.session import shared_dir
from fairlend.sources import sinks
from tests.conftest import SF001


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def brute(rows, names, share):
    out = []
    for i, c in enumerate(names):
        count = Counter(r[i] for r in rows)
        nulls = count.pop(None, 0)
        found = [(c, len(rows), nulls, v, n) for v, n in count.items() if n > share * len(rows)]
        out += found or [(c, len(rows), nulls, None, None)]
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [0.02, 0.2])
def test_profile_equals_counting(spark, share):
    """Many rare values beside a few frequent ones, in many partitions and orders."""
    rows = [(f"v{i % 3}" if i % 2 else f"rare{i}", str(i), None if i % 5 == 0 else "x" if i % 7 else "y", None)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, `b c` string, d string, e string").repartition(7)
    assert rows_of(profile.column_profile(df, share=share)) == brute(rows, ["a", "b c", "d", "e"], share)


def test_a_value_of_exactly_the_share_is_not_frequent(spark):
    df = spark.createDataFrame([("a",)] * 10 + [(f"r{i}",) for i in range(90)], "v string")
    assert rows_of(profile.column_profile(df, share=0.1)) == [("v", 100, 0, None, None)]
    assert rows_of(profile.column_profile(df, share=0.099)) == [("v", 100, 0, "a", 10)]


def test_types_nan_and_no_rows(spark):
    df = spark.createDataFrame([(1, float("nan"), True), (1, float("nan"), None), (2, 0.5, True)], "i int, x double, t boolean")
    assert rows_of(profile.column_profile(df, share=0.4)) == [
        ("i", 3, 0, "1", 2), ("t", 3, 1, "true", 2), ("x", 3, 0, "NaN", 2)]
    assert rows_of(profile.column_profile(df.limit(0))) == [(c, 0, 0, None, None) for c in "itx"]


def test_each_pass_scans_once(spark, tmp_out):
    sinks.write_parquet(fx.raw_applications(spark, SF001), tmp_out)
    plan = profile.column_profile(spark.read.parquet(tmp_out))._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    assert initial.count("FileScan parquet") == 2  # the counts, and the row count by a reused subplan of the same counts
    assert "CartesianProduct" not in plan


def test_describe_job_writes_the_tables(spark):
    apps, out = fx.applications(spark, SF001), shared_dir(spark, "describe")
    summary = jobs.describe_job(spark, apps, out)
    back = {name: spark.read.option("header", True).csv(f"{out}/{name}") for name in (
        "approval_by_race", "approval_over_time", "loan_type_approval", "interest_by_race", "summary_statistics",
        "income_histogram", "loan_amount_histogram")}
    assert back["approval_by_race"].columns == ["race_group", "approval_rate", "applications"]
    assert sum(int(r.applications) for r in back["approval_by_race"].collect()) == apps.count()
    want = {r.activity_year: r.approval_rate for r in describe.approval_over_time(apps).collect()}
    assert {int(r.activity_year): float(r.approval_rate) for r in back["approval_over_time"].collect()} == want
    assert [r.summary for r in back["summary_statistics"].collect()] == ["count", "mean", "stddev", "min", "25%", "50%", "75%", "max"]
    assert summary.count() == 8
    assert sum(int(r.n) for r in back["income_histogram"].collect()) == apps.where("income is not null").count()


def test_profile_job(spark):
    raw, out = fx.raw_applications(spark, SF001), shared_dir(spark, "profile")
    got = rows_of(jobs.profile_job(spark, raw, out))
    assert got == rows_of(profile.column_profile(raw))
    shape = spark.read.option("header", True).csv(f"{out}/shape").first()
    assert (int(shape.rows), int(shape.cols)) == (raw.count(), len(raw.columns))
    counts = {r.measure: float(r.value) for r in spark.read.option("header", True).csv(f"{out}/measures")
              .where("statistic = 'count'").collect()}
    assert counts["income"] == raw.where("try_cast(income as double) is not null").count()


def test_samples(spark):
    apps = fx.applications(spark, SF001)
    assert jobs.sampled(apps, None) is apps and jobs.sampled(apps, 1.0).count() == apps.count()
    one, other = jobs.sampled(apps, 0.2), jobs.sampled(apps.repartition(7), 0.2)
    assert rows_of(one) == rows_of(other) and 0.1 < one.count() / apps.count() < 0.3
    assert 0.1 < jobs.sampled(apps, 0.2, "bernoulli").count() / apps.count() < 0.3
    with pytest.raises(ValueError, match="fraction"):
        jobs.sampled(apps, 1.5)


def test_cli_describe_on_a_sample(spark, capsys):
    path, out = shared_dir(spark, "cli-apps"), shared_dir(spark, "cli-describe")
    apps = fx.applications(spark, SF001)
    sinks.write_parquet(apps, path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        jobs.main(["describe", "--input", path, "--out", out, "--format", "parquet", "--sample", "0.5"])
        jobs.main(["profile", "--input", path, "--out", f"{out}/profile", "--format", "parquet"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "stddev" in capsys.readouterr().out
    kept = spark.read.option("header", True).csv(f"{out}/approval_by_race").agg(F.sum("applications")).first()[0]
    assert 0 < kept < apps.count()
