"""Yearly re-runs that leave other years' files alone, and the audit taken by the write itself."""

import json
import os
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from fairlend.operators import clean
from fairlend.plans import fixture as fx
from fairlend.plans import jobs
from fairlend.plans.session import shared_dir, side_session
from fairlend.sources import readers, sinks
from tests.conftest import ROOT, SF001


def files_of(path):
    root = path.removeprefix("file:")
    return {os.path.join(d, f)[len(root):] for d, _, fs in os.walk(root) for f in fs if f.endswith((".parquet", ".csv"))}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_only_the_year_s_files_change(spark):
    apps = fx.applications(spark, SF001)
    path = shared_dir(spark, "rewrite")
    sinks.write_parquet(apps, path, ["state_code", "activity_year"])
    before = files_of(path)
    new = apps.where("activity_year = 1996").withColumn("loan_amount", F.lit(1.0))
    sinks.replace_years(new, path, [1996])
    after = files_of(path)
    assert {f for f in before if "activity_year=1996/" not in f} == {f for f in after if "activity_year=1996/" not in f}
    assert not {f for f in before & after if "activity_year=1996/" in f}
    want = apps.where("activity_year <> 1996").unionByName(new)
    assert rows_of(readers.read_parquet_partitioned(spark, path).select(*fx.APPLICATION_COLUMNS)) == rows_of(want)


def test_a_state_that_left_and_a_new_year(spark):
    rows = [(2020, "CA", 1.0), (2020, "TX", 2.0), (2021, "CA", 3.0), (2021, "TX", 4.0)]
    df = spark.createDataFrame(rows, "activity_year int, state_code string, x double")
    path = shared_dir(spark, "left")
    sinks.write_parquet(df, path, ["state_code", "activity_year"])
    sinks.replace_years(df.where("activity_year = 2021 and state_code = 'CA'"), path, [2021])
    sinks.replace_years(spark.createDataFrame([(2022, "NV", 5.0)], df.schema), path, [2022])
    got = rows_of(spark.read.parquet(path).select("activity_year", "state_code", "x"))
    assert got == [(2020, "CA", 1.0), (2020, "TX", 2.0), (2021, "CA", 3.0), (2022, "NV", 5.0)]
    sinks.replace_years(df.limit(0), path, [2020])
    assert {r[0] for r in spark.read.parquet(path).select("activity_year").collect()} == {2021, 2022}


def test_rows_of_another_year_fail_and_change_nothing(spark):
    df = spark.createDataFrame([(2020, "CA", 1.0), (2021, "CA", 2.0)], "activity_year int, state_code string, x double")
    path = shared_dir(spark, "other")
    sinks.write_parquet(df, path, ["state_code", "activity_year"])
    before = files_of(path)
    for bad in (df, spark.createDataFrame([(None, "CA", 1.0)], df.schema)):
        with pytest.raises(Exception, match="not among those to replace"):
            sinks.replace_years(bad, path, [2020])
    assert files_of(path) == before


def test_prepare_replaces_a_year(spark):
    raw = fx.raw_applications(spark, SF001)
    all_, late, out = shared_dir(spark, "all"), shared_dir(spark, "late"), shared_dir(spark, "out")
    sinks.write_csv(raw, all_)
    sinks.write_csv(raw.where("activity_year = 1997 and state_code = 'CA'"), late)
    jobs.prepare(spark, [all_], out)
    kept = {f for f in files_of(out) if "activity_year=1997/" not in f}
    audit = {r.step: r.rows for r in jobs.prepare(spark, [late], out, years=[1997]).collect()}
    assert kept == {f for f in files_of(out) if "activity_year=1997/" not in f}
    apps = fx.applications(spark, SF001)
    want = apps.where("activity_year <> 1997 or state_code = 'CA'").groupBy("activity_year").count()
    assert rows_of(spark.read.parquet(f"{out}/combined").groupBy("activity_year").count()) == rows_of(want)
    by_year = spark.read.option("header", True).csv(f"{out}/cleaned_by_year").groupBy("activity_year").count()
    assert {int(y): n for y, n in by_year.collect()} == dict(want.collect())
    assert audit["loan_amount_nonneg"] == apps.where("activity_year = 1997 and state_code = 'CA'").count()


def test_observed_audit_equals_the_pass(spark):
    raw = fx.raw_applications(side_session(spark), SF001)
    audit = clean.CleaningAudit(raw)
    kept = clean.clean_applications(audit.observed)
    path = shared_dir(spark, "observed")
    sinks.write_parquet(kept, path, ["state_code", "activity_year"])
    n = spark.read.parquet(path).count()
    assert rows_of(audit.table(n)) == rows_of(clean.audit_cleaning(raw))
    # counts that do not fit the result are taken anew
    audit.raw = raw.limit(0)
    assert {r.rows for r in audit.table(n + 1).collect()} == {0}


def test_models_score_after_an_audit(spark):
    """Observed metrics stay in a session of their own: one that took some cannot ship ML scoring to tasks."""
    from fairlend.operators import features as feats
    from fairlend.operators import models
    raw = fx.raw_applications(side_session(spark), SF001)
    audit = clean.CleaningAudit(raw)
    audit.observed.write.format("noop").mode("overwrite").save()
    assert audit.table(-1).count() == 7
    assert raw.sparkSession.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    rows = feats.model_features(clean.prep_rate(fx.applications(spark, SF001))).select(*models.fit_columns("interest_rate"))
    models.fit_rate_model(rows).scored.select("prediction").write.format("noop").mode("overwrite").save()


_JOB = """
import sys
from pyspark.sql import functions as F
from fairlend.plans import jobs
from fairlend.plans.session import build_session
spark = build_session("local[2]", 2, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": sys.argv[1],
                                            "spark.checkpoint.dir": sys.argv[1] + "/ckpt", "spark.eventLog.compress": "false"})
jobs.prepare(spark, [sys.argv[2]], sys.argv[1] + "/out").collect()
spark.stop()
"""


def test_prepare_reads_the_text_once(spark):
    text = shared_dir(spark, "text").removeprefix("file:")
    sinks.write_csv(fx.raw_applications(spark, SF001), text)
    size = sum(os.path.getsize(text + f) for f in files_of(text))
    log = tempfile.mkdtemp(prefix="fairlend-events-")
    subprocess.run([sys.executable, "-c", _JOB, log, text], check=True, cwd=ROOT, env={**os.environ, "PYTHONPATH": ROOT},
                   capture_output=True, timeout=300)
    lines = [ln for d, _, fs in os.walk(log) if "ckpt" not in d and "/out" not in d for f in fs
             for ln in open(os.path.join(d, f), errors="replace")]
    events = [json.loads(ln) for ln in lines if ln.startswith('{"Event":"')]
    plans = [e["physicalPlanDescription"] for e in events if e["Event"].endswith("SparkListenerSQLExecutionStart")]
    parsing = [p for p in plans if "Scan csv" in p]
    assert len(parsing) == 1 and text in parsing[0] and "CollectMetrics" in parsing[0]
    read = sum(e["Task Metrics"]["Input Metrics"]["Bytes Read"] for e in events if e["Event"] == "SparkListenerTaskEnd")
    # the text once, a buffer of it for the header line, and the columnar output for the yearly files and the count
    assert size <= read < 1.9 * size, (size, read)
