"""End-to-end study jobs on the sf0.001 fixture, outputs read back."""

from pyspark.sql import functions as F

from fairlend.functions import schema as S
from fairlend.plans import fixture as fx
from fairlend.plans import jobs
from fairlend.plans.session import shared_dir
from fairlend.sources import sinks
from tests.conftest import SF001


def test_prepare_then_gap_and_models(spark):
    raw = fx.raw_applications(spark, SF001)
    y1, y2 = shared_dir(spark, "y1"), shared_dir(spark, "y2")
    sinks.write_csv(raw.where(F.col("activity_year") <= 1996), y1, sep="|")
    sinks.write_csv(raw.where(F.col("activity_year") > 1996), y2, sep="|")
    out = shared_dir(spark, "prep")
    audit = {r.step: r.rows for r in jobs.prepare(spark, [y1, y2], out, sep="|").collect()}
    assert audit["raw"] == raw.count()
    apps = jobs.load_applications(spark, f"{out}/combined", "parquet")
    assert apps.count() == audit["loan_amount_nonneg"] == fx.applications(spark, SF001).count()

    gap_out = shared_dir(spark, "gaps")
    top = jobs.county_gap_job(spark, apps, gap_out, fx.county_dimension(spark, SF001))
    back = spark.read.option("header", True).schema(S.COUNTY_GAP).csv(f"{gap_out}/top25_disparities")
    assert back.count() == top.count() > 0
    ranked = spark.read.option("header", True).csv(f"{gap_out}/top25_table")
    assert ranked.count() == top.count()

    app_out = shared_dir(spark, "approval")
    s = jobs.approval(spark, apps, app_out).first()
    assert 0.0 <= s.accuracy <= 1.0 and s.rows == apps.where("approved in (0, 1)").count()
    coefs = spark.read.option("header", True).csv(f"{app_out}/coefficients")
    assert coefs.count() == s.width + 1
    preds = spark.read.option("header", True).csv(f"{app_out}/predictions")
    assert preds.count() == s.rows and "probability" in preds.columns

    rate_out = shared_dir(spark, "rates")
    r = jobs.rates(spark, apps, rate_out).first()
    assert r.rmse > 0 and r.rows > 0


def test_cli_gaps_job(spark, capsys):
    apps_path, out = shared_dir(spark, "cli-apps"), shared_dir(spark, "cli-out")
    sinks.write_parquet(fx.applications(spark, SF001), apps_path)
    dim_path = shared_dir(spark, "cli-dim")
    sinks.write_csv(fx.county_dimension(spark, SF001).select(
        F.col("county_fips").alias("GEOID"), F.col("statefp").alias("STATEFP"),
        F.col("name").alias("NAME")), dim_path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        jobs.main(["gaps", "--input", apps_path, "--out", out, "--format", "parquet",
                   "--counties", dim_path, "--input-gb", "0.001"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "approval_disparity_gap" in capsys.readouterr().out
    top = spark.read.option("header", True).csv(f"{out}/top25_disparities")
    table = spark.read.option("header", True).csv(f"{out}/top25_table")
    assert top.count() == table.count() > 0
