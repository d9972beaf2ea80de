"""The study's end-to-end jobs, composed from the library's operators.

``prepare``   yearly delimited files → cleaned rows per year + combined dataset
``approval``  approval model: coefficients (with odds ratios), metrics, predictions
``gaps``      county approval gaps: full table, top 25, report tables
``rates``     rate model: coefficients, metrics, predictions
``describe``  descriptive tables: approval by group, year and loan type, rates, summary, histograms
``profile``   profile report of raw or cleaned files: shape, nulls, frequent values, measures

Every output is written by the executors (CSV with header, or Parquet);
only results that a model's width or a top-k bounds are single files.

Usage::

    python -m fairlend.plans.jobs gaps --input /data/applications --out /results/gaps
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from fairlend.functions import codes
from fairlend.functions import schema as S
from fairlend.functions.lineage import materialize
from fairlend.operators import clean, describe, gaps, metrics, models, profile
from fairlend.operators import features as feats
from fairlend.plans.session import side_session
from fairlend.sources import readers, sinks


def load_applications(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Cleaned applications from CSV (explicit schema) or Parquet."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    return readers.read_csv_typed(spark, path, S.APPLICATION)


def prepare(spark: SparkSession, yearly_paths: Sequence[str], out: str,
            sep: str = ",", years: Sequence[int] | None = None) -> DataFrame:
    """Read the yearly files, clean them, write per-year and combined outputs.

    With ``years`` the files hold those years only, new or corrected: their
    partitions of an earlier run's outputs are replaced and the others stay as
    they are.  Returns the cleaning audit (rows left after each rule), counted
    by the tasks that read the text for the write.
    """
    raw = readers.read_yearly_files(side_session(spark), yearly_paths, S.RAW_APPLICATION, sep=sep, required=S.REQUIRED_RAW)
    audit = clean.CleaningAudit(raw)
    cleaned = clean.clean_applications(audit.observed)
    combined, by_year = f"{out}/combined", f"{out}/cleaned_by_year"
    # the per-year CSV files are derived from the columnar combined output, not the text
    if years is None:
        sinks.write_parquet(cleaned, combined, ["state_code", "activity_year"])
        written = spark.read.parquet(combined)
        sinks.write_partitioned_csv(written, by_year)
    else:
        sinks.replace_years(cleaned, combined, years)
        written = readers.read_parquet_partitioned(spark, combined, years=years)
        sinks.replace_years(written, by_year, years, ["activity_year"], fmt="csv")
    return audit.table(written.count())


def approval(spark: SparkSession, apps: DataFrame, out: str) -> DataFrame:
    """Approval model: returns the one-row metric summary."""
    rows = feats.model_features(clean.prep_approval(apps)).select(*models.fit_columns("approved"))
    with feats.persisted(feats.evened(rows)) as cached:
        n = cached.count()
        fitted = models.fit_approval_model(cached)
        sinks.write_csv(models.approval_predictions(fitted), f"{out}/predictions")
        sinks.write_single_csv(fitted.coefficients, f"{out}/coefficients")
        summary = metrics.model_summary_row(fitted, "logistic", rows=n)
        sinks.write_single_csv(summary, f"{out}/summary")
    return summary


def county_gap_job(spark: SparkSession, apps: DataFrame, out: str,
                   counties: DataFrame | None = None, min_n: int = 50) -> DataFrame:
    """County gaps: full table, top 25, and with a county table the map/rank tables."""
    # one row per county feeding four outputs: aggregate the input once
    table = materialize(gaps.county_gaps(apps, min_n))
    sinks.write_csv(table.orderBy(*gaps.gap_order()), f"{out}/county_disparities")
    top = gaps.top_gaps(table)
    sinks.write_single_csv(top, f"{out}/top25_disparities")
    if counties is not None:
        mapped = gaps.county_map(counties, table)
        sinks.write_csv(gaps.state_gap_map(mapped), f"{out}/state_maps")
        sinks.write_single_csv(gaps.ranked_gap_table(mapped), f"{out}/top25_table")
    return top


def rates(spark: SparkSession, apps: DataFrame, out: str) -> DataFrame:
    """Rate model: returns the one-row metric summary."""
    rows = feats.model_features(clean.prep_rate(apps)).select(*models.fit_columns("interest_rate"))
    with feats.persisted(feats.evened(rows)) as cached:
        fitted = models.fit_rate_model(cached)
        sinks.write_csv(models.rate_predictions(fitted), f"{out}/predictions")
        sinks.write_single_csv(fitted.coefficients, f"{out}/coefficients")
        summary = metrics.model_summary_row(fitted, "linear")
        sinks.write_single_csv(summary, f"{out}/summary")
    return summary


def describe_job(spark: SparkSession, apps: DataFrame, out: str) -> DataFrame:
    """The report's descriptive tables, each a folder of ``out``; returns the summary.

    The columns they read are kept for the tables and the passes of the
    summary.
    """
    columns = ["approved", "activity_year", "loan_type", "applicant_race_1", *describe.SUMMARY_INPUTS]
    with feats.persisted(feats.evened(apps.select(*columns))) as kept:
        tables = {"approval_by_race": describe.approval_by_race(kept),
                  "approval_over_time": describe.approval_over_time(kept),
                  "loan_type_approval": describe.loan_type_approval(kept),
                  "interest_by_race": describe.interest_by_race(kept)}
        for name, table in tables.items():
            sinks.write_single_csv(table, f"{out}/{name}")
        summary = describe.summary_wide(describe.summary_statistics(kept))
        sinks.write_single_csv(summary, f"{out}/summary_statistics")
        # bins grow with the spread of the values, not with the rows
        sinks.write_csv(describe.histogram(kept, "income", INCOME_BIN), f"{out}/income_histogram")
        sinks.write_csv(describe.histogram(kept, "loan_amount", AMOUNT_BIN), f"{out}/loan_amount_histogram")
    return summary


#: Widths of the histograms' bins: incomes are in thousands.
INCOME_BIN, AMOUNT_BIN = 50.0, 10_000.0


def profile_job(spark: SparkSession, rows: DataFrame, out: str, share: float = 0.01) -> DataFrame:
    """Profile of a table, each part a folder of ``out``; returns the columns' profile.

    ``shape``; ``columns``: nulls and frequent values; ``measures``: the numeric
    measures described, text that is no number left out.
    """
    sinks.write_single_csv(profile.shape(rows), f"{out}/shape")
    columns = profile.column_profile(rows, share=share)
    sinks.write_single_csv(columns, f"{out}/columns")
    measures = [c for c in codes.NUMERIC_COLUMNS if c in rows.columns]
    if measures:
        with feats.persisted(feats.evened(clean.coerce_numeric(rows.select(*measures)))) as kept:
            sinks.write_single_csv(profile.summary_long(kept, measures), f"{out}/measures")
    return readers.read_csv_typed(spark, f"{out}/columns", columns.schema, required=columns.columns)


#: The columns whose hash decides whether a row is in a sample: all that tell applications apart.
SAMPLE_KEYS = ["activity_year", "state_code", "county_code", "action_taken", "applicant_race_1", "loan_type",
               "loan_amount", "property_value", "income", "interest_rate"]


def sampled(apps: DataFrame, fraction: float | None, method: str = "key") -> DataFrame:
    """A sample for a trial run; all rows without a fraction.

    ``key``: by a hash of the row's values, the same rows on every cluster
    (equal rows are all in or all out); ``bernoulli``: seeded, as in the study.
    """
    if fraction is None:
        return apps
    if not 0.0 < fraction <= 1.0:
        raise ValueError(f"a sample is a fraction above 0 and up to 1, not {fraction}")
    if method == "bernoulli":
        return clean.sample_bernoulli(apps, fraction)
    return clean.sample_by_key(apps, fraction, [c for c in SAMPLE_KEYS if c in apps.columns])


def main(argv: Sequence[str] | None = None) -> None:
    from fairlend.plans.session import build_session, input_bytes, size_shuffles

    p = argparse.ArgumentParser(prog="fairlend.plans.jobs")
    p.add_argument("job", choices=["prepare", "approval", "gaps", "rates", "describe", "profile"])
    p.add_argument("--input", nargs="+", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--format", default="csv", choices=["csv", "parquet"])
    p.add_argument("--counties", default=None, help="county table (GEOID, STATEFP, NAME) as CSV")
    p.add_argument("--sep", default=",")
    p.add_argument("--sample", type=float, default=None, help="run on this fraction of the rows")
    p.add_argument("--sample-method", default="key", choices=["key", "bernoulli"],
                   help="by a hash of the row's values, or seeded at random as in the study")
    p.add_argument("--years", nargs="+", type=int, default=None,
                   help="prepare: the years that the input holds; only these are replaced in --out")
    p.add_argument("--input-gb", type=float, default=None,
                   help="input size instead of that of the files; sets the shuffle width (about 128 MB per partition)")
    p.add_argument("--checkpoint-dir", default=None,
                   help="folder that driver and executors share, for intermediate tables (spark.checkpoint.dir)")
    a = p.parse_args(argv)
    spark = build_session(extra={"spark.checkpoint.dir": a.checkpoint_dir} if a.checkpoint_dir else None)
    size_shuffles(spark, int(a.input_gb * 1024 ** 3) if a.input_gb else input_bytes(spark, a.input))
    if a.job == "prepare":
        prepare(spark, a.input, a.out, a.sep, a.years).show(truncate=False)
        return
    if a.job == "profile":
        rows = (spark.read.parquet(*a.input) if a.format == "parquet"
                else readers.read_yearly_files(spark, a.input, S.RAW_APPLICATION, a.sep))
        profile_job(spark, sampled(rows, a.sample, a.sample_method), a.out).show(100, truncate=False)
        return
    apps = sampled(load_applications(spark, a.input[0], a.format), a.sample, a.sample_method)
    if a.job == "describe":
        describe_job(spark, apps, a.out).show(truncate=False)
    elif a.job == "approval":
        approval(spark, apps, a.out).show(truncate=False)
    elif a.job == "gaps":
        dim = readers.read_county_dimension(spark, a.counties) if a.counties else None
        county_gap_job(spark, apps, a.out, dim).show(25, truncate=False)
    else:
        rates(spark, apps, a.out).show(truncate=False)


if __name__ == "__main__":
    main()
