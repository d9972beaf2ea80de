"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query reads the driver's tables through ``plans.fixture`` and runs the
library's operators over the whole input.  Key names match
``plans.oracle.ORACLE`` where an SQL oracle exists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlend.functions import codes
from fairlend.functions import schema as S

from fairlend.operators import certificate, clean, describe, gaps, metrics, models, profile
from fairlend.operators import features as feats
from fairlend.plans import fixture as fx
from fairlend.functions.lineage import stored
from fairlend.plans.session import shared_dir, side_session
from fairlend.sources import headers, readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# --- group-gap analysis (R2) -------------------------------------------------

@register("county_gap_top25")
def county_gap_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 counties with the largest approval gap (flagship)."""
    return gaps.top_gaps(gaps.county_gaps(fx.applications(spark, sf_dir)))


@register("county_stats")
def county_stats(spark, sf_dir):
    """Per-county counts and per-group approval rates, no threshold."""
    df = feats.add_comparison_group(feats.add_race_group(clean.prep_gap(fx.applications(spark, sf_dir))))
    return gaps.group_gap(df)


@register("county_min_sample")
def county_min_sample(spark, sf_dir):
    """Counties with at least 50 rows on each side."""
    return gaps.min_sample(county_stats(spark, sf_dir))


@register("county_gap")
def county_gap(spark, sf_dir):
    """Gap for every county, threshold off (one-sided counties get null)."""
    return gaps.county_gaps(fx.applications(spark, sf_dir), min_n=0)


@register("county_fips")
def county_fips(spark, sf_dir):
    """Padded FIPS and display label for each county of the gap table."""
    g = gaps.county_gaps(fx.applications(spark, sf_dir), min_n=0)
    return gaps.add_fips(g).select("state_code", "county_code", "county_fips", "county_label")


def _mapped(spark, sf_dir):
    return gaps.county_map(fx.county_dimension(spark, sf_dir),
                           gaps.county_gaps(fx.applications(spark, sf_dir)))


@register("county_left_join")
def county_left_join(spark, sf_dir):
    """County dimension ⟕ thresholded gaps, with the has_gap flag."""
    return _mapped(spark, sf_dir)


@register("gap_range")
def gap_range(spark, sf_dir):
    """Min and max gap over counties with an estimate."""
    return gaps.gap_range(_mapped(spark, sf_dir))


@register("state_gap_map")
def state_gap_map(spark, sf_dir):
    """Per-state map rows with the shared colour range."""
    return gaps.state_gap_map(_mapped(spark, sf_dir))


@register("ranked_gap_table")
def ranked_gap_table(spark, sf_dir):
    """Ranked top-25 report table."""
    return gaps.ranked_gap_table(_mapped(spark, sf_dir))


# --- cleaning (O14, O19–O31) --------------------------------------------------

@register("clean_applications")
def clean_applications_q(spark, sf_dir):
    """The full cleaning chain over the raw rows."""
    return fx.applications(spark, sf_dir)


@register("clean_audit")
def clean_audit(spark, sf_dir):
    """Rows left after each cleaning rule, one aggregation pass."""
    return clean.audit_cleaning(fx.raw_applications(spark, sf_dir))


@register("drop_null_keys")
def drop_null_keys(spark, sf_dir):
    """Raw rows with county, race and income present."""
    df = clean.drop_null_keys(fx.raw_applications(spark, sf_dir))
    return df.select("l_orderkey", "l_linenumber", "state_code", "county_code",
                     "applicant_race_1", "action_taken")


@register("coerce_numeric")
def coerce_numeric(spark, sf_dir):
    """Text measures → double, junk → null, over all raw rows."""
    df = clean.coerce_numeric(fx.raw_applications(spark, sf_dir))
    return df.select("l_orderkey", "l_linenumber", "loan_amount", "income", "interest_rate", "property_value")


@register("nonneg_or_null")
def nonneg_or_null(spark, sf_dir):
    """Rows whose coerced measures are non-negative or missing."""
    df = clean.keep_nonneg_or_null(clean.coerce_numeric(fx.raw_applications(spark, sf_dir)))
    return df.select("l_orderkey", "l_linenumber", "loan_amount", "income", "interest_rate")


@register("union_years")
def union_years(spark, sf_dir):
    """Early years lack the rate column; union by name fills it with null."""
    raw = fx.raw_applications(spark, sf_dir)
    early = raw.where(F.col("activity_year") <= 1997).drop("interest_rate")
    late = raw.where(F.col("activity_year") > 1997)
    u = clean.union_years([early, late])
    return u.groupBy("activity_year").agg(F.count(F.lit(1)).alias("n"),
                                          F.count("interest_rate").alias("n_rate"))


@register("derive_approved")
def derive_approved(spark, sf_dir):
    """State restriction, decided actions and the approval label."""
    df = clean.derive_approved(clean.restrict_states(fx.raw_applications(spark, sf_dir)))
    return df.groupBy("state_code", "action_taken", "approved").agg(F.count(F.lit(1)).alias("n"))


@register("fill_defaults")
def fill_defaults(spark, sf_dir):
    """Null income / amount → 0.0, null loan type → -1."""
    df = clean.fill_defaults(fx.applications(spark, sf_dir))
    return df.select("l_orderkey", "l_linenumber", "income", "loan_amount", "loan_type")


_PREP_COLS = ["l_orderkey", "l_linenumber", "activity_year", "county_code", "approved",
              "income", "loan_amount", "loan_type", "interest_rate", "loan_to_income", "race_group"]


@register("prep_approval")
def prep_approval(spark, sf_dir):
    """The approval-model rows with their features."""
    return feats.model_features(clean.prep_approval(fx.applications(spark, sf_dir))).select(*_PREP_COLS)


@register("prep_rate")
def prep_rate(spark, sf_dir):
    """The rate-model rows with their features."""
    return feats.model_features(clean.prep_rate(fx.applications(spark, sf_dir))).select(*_PREP_COLS)


@register("sample_by_key")
def sample_by_key(spark, sf_dir):
    """10 % key-hash sample of the cleaned rows (partitioning-independent)."""
    return clean.sample_by_key(fx.applications(spark, sf_dir), 0.1, ["l_orderkey", "l_linenumber"])


@register("sample_bernoulli")
def sample_bernoulli(spark, sf_dir):
    """10 % seeded Bernoulli sample, as in the study (rows-only check)."""
    return clean.sample_bernoulli(fx.applications(spark, sf_dir), 0.1)


# --- features (O32–O34) ----------------------------------------------------------

@register("loan_to_income")
def loan_to_income(spark, sf_dir):
    """Both variants of the guarded ratio."""
    apps = fx.applications(spark, sf_dir)
    df = feats.add_loan_to_income(feats.add_loan_to_income(apps, 0.0, "lti_zero"), None, "lti_null")
    return df.select("l_orderkey", "l_linenumber", "income", "loan_amount", "lti_zero", "lti_null")


@register("race_group_5")
def race_group_5(spark, sf_dir):
    """Five-label grouping, counted per source code."""
    df = feats.add_race_group(fx.applications(spark, sf_dir), "five")
    return df.groupBy("applicant_race_1", "race_group").agg(F.count(F.lit(1)).alias("n"))


@register("race_group_7")
def race_group_7(spark, sf_dir):
    """Seven-label report grouping, counted per source code."""
    df = feats.add_race_group(fx.applications(spark, sf_dir), "seven")
    return df.groupBy("applicant_race_1", "race_group").agg(F.count(F.lit(1)).alias("n"))


@register("comparison_group")
def comparison_group(spark, sf_dir):
    """Comparison groups with unassigned rows dropped."""
    df = feats.add_comparison_group(feats.add_race_group(fx.applications(spark, sf_dir)))
    return df.groupBy("race_group", "comparison_group").agg(F.count(F.lit(1)).alias("n"))


# --- profiling (O15–O18) -------------------------------------------------------------

@register("row_col_counts")
def row_col_counts(spark, sf_dir):
    """Rows and columns before and after cleaning."""
    before = profile.shape(fx.raw_applications(spark, sf_dir)).withColumn("stage", F.lit("raw"))
    after = profile.shape(fx.applications(spark, sf_dir)).withColumn("stage", F.lit("clean"))
    return before.unionByName(after)


@register("null_counts")
def null_counts(spark, sf_dir):
    """Nulls per column of the raw rows."""
    return profile.null_counts(fx.raw_applications(spark, sf_dir))


@register("column_profile")
def column_profile(spark, sf_dir):
    """Nulls and exact counts of the frequent values of every raw column, two passes for all of them."""
    return profile.column_profile(fx.raw_applications(spark, sf_dir), S.RAW_APPLICATION.names)


@register("distinct_values")
def distinct_values(spark, sf_dir):
    """Distinct action codes of the raw rows."""
    return profile.distinct_values(fx.raw_applications(spark, sf_dir), "action_taken")


@register("value_counts")
def value_counts(spark, sf_dir):
    """Race code frequencies of the raw rows (nulls dropped)."""
    return profile.value_counts(fx.raw_applications(spark, sf_dir), "applicant_race_1")


@register("value_counts_ethnicity")
def value_counts_ethnicity(spark, sf_dir):
    """Ethnicity code frequencies of the raw rows (nulls dropped)."""
    return profile.value_counts(fx.raw_applications(spark, sf_dir), "applicant_ethnicity_1")


@register("drop_if_present")
def drop_if_present(spark, sf_dir):
    """Raw rows without the unused ethnicity column."""
    return clean.drop_if_present(fx.raw_applications(spark, sf_dir))


def _measures(spark, sf_dir, *columns):
    """The columns, kept evenly for the passes over them: the fixture joins four tables to shape them."""
    return feats.persisted(feats.evened(fx.applications(spark, sf_dir).select(*columns)))


@register("describe_column")
def describe_column(spark, sf_dir):
    """Describe the coerced interest rate."""
    with _measures(spark, sf_dir, "interest_rate") as kept:
        return profile.describe_column(kept, "interest_rate", digits=6)


@register("describe_income")
def describe_income(spark, sf_dir):
    """Describe the coerced income (junk coerced to null, many ties)."""
    with _measures(spark, sf_dir, "income") as kept:
        return profile.describe_column(kept, "income", digits=6)


@register("value_counts_approved")
def value_counts_approved(spark, sf_dir):
    """Frequencies of the derived approval label."""
    return profile.value_counts(fx.applications(spark, sf_dir), "approved")


# --- descriptive tables (O36–O41) ------------------------------------------------------

@register("approval_by_race")
def approval_by_race(spark, sf_dir):
    return describe.approval_by_race(fx.applications(spark, sf_dir))


@register("approval_over_time")
def approval_over_time(spark, sf_dir):
    return describe.approval_over_time(fx.applications(spark, sf_dir))


@register("loan_type_approval")
def loan_type_approval(spark, sf_dir):
    return describe.loan_type_approval(fx.applications(spark, sf_dir))


@register("interest_by_race")
def interest_by_race(spark, sf_dir):
    return describe.interest_by_race(fx.applications(spark, sf_dir), digits=6)


@register("summary_statistics")
def summary_statistics(spark, sf_dir):
    with _measures(spark, sf_dir, *describe.SUMMARY_INPUTS) as kept:
        return describe.summary_statistics(kept, digits=6)


@register("summary_statistics_wide")
def summary_statistics_wide(spark, sf_dir):
    """O40 in the study's layout: statistics as rows, measures as columns."""
    return describe.summary_wide(summary_statistics(spark, sf_dir))


@register("income_histogram")
def income_histogram(spark, sf_dir):
    """Income in bins of 50 (thousands)."""
    return describe.histogram(fx.applications(spark, sf_dir), "income", 50.0)


@register("loan_amount_histogram")
def loan_amount_histogram(spark, sf_dir):
    """Loan amount in bins of 10,000."""
    return describe.histogram(fx.applications(spark, sf_dir), "loan_amount", 10000.0)


# --- adjusted models (O50–O61) -----------------------------------------------------------

def _approval_rows(spark, sf_dir):
    """The columns that the approval fit reads."""
    rows = feats.model_features(clean.prep_approval(fx.applications(spark, sf_dir)))
    return rows.select(*models.fit_columns("approved"))


def _rate_rows(spark, sf_dir):
    """The columns that the rate fit reads."""
    rows = feats.model_features(clean.prep_rate(fx.applications(spark, sf_dir)))
    return rows.select(*models.fit_columns("interest_rate"))


def _fit(rows, name, result):
    """``result(rows)`` with the rows kept for all its passes: it is written before they are let go."""
    with feats.persisted(feats.evened(rows)) as cached:
        return stored(result(cached), name)


@register("category_index")
def category_index(spark, sf_dir):
    """Level → index of the four categorical columns (frequency order)."""
    return models.category_index(_approval_rows(spark, sf_dir))


@register("one_hot_slot_counts")
def one_hot_slot_counts(spark, sf_dir):
    """Rows per one-hot slot of the assembled vector."""
    return _fit(_approval_rows(spark, sf_dir), "slots", models.one_hot_slot_counts)


@register("feature_names")
def feature_names(spark, sf_dir):
    """Slot names of the assembled vector, in slot order."""
    return models.feature_names(_approval_rows(spark, sf_dir))


@register("approval_model")
def approval_model(spark, sf_dir):
    """Logistic fit; one row with width, intercept, accuracy, AUC."""
    rows = _approval_rows(spark, sf_dir)
    with feats.persisted(feats.evened(rows)) as cached:
        n = cached.count()  # fills the cache the fit then reads
        fitted = models.fit_approval_model(cached)
        return stored(metrics.model_summary_row(fitted, "logistic", rows=n), "approval-summary")


@register("approval_coefficients")
def approval_coefficients(spark, sf_dir):
    """Named coefficients with odds ratios, intercept last."""
    return _fit(_approval_rows(spark, sf_dir), "coefficients", lambda d: models.fit_approval_model(d).coefficients)


@register("approval_predictions")
def approval_predictions(spark, sf_dir):
    """In-sample scores with class probability."""
    return _fit(_approval_rows(spark, sf_dir), "predictions",
                lambda d: models.approval_predictions(models.fit_approval_model(d)))


@register("logit_group_rates")
def logit_group_rates(spark, sf_dir):
    """O53 identity: saturated logistic fit reproduces each group's approval rate."""
    rates = _fit(_approval_rows(spark, sf_dir), "group-rates", models.group_rate_logit)
    return rates.select("race_group", F.round("fitted_rate", 5).alias("fitted_rate"))


@register("rate_model")
def rate_model(spark, sf_dir):
    """Linear fit; one row with width, intercept, R², RMSE."""
    return _fit(_rate_rows(spark, sf_dir), "rate-summary",
                lambda d: metrics.model_summary_row(models.fit_rate_model(d), "linear"))


@register("rate_coefficients")
def rate_coefficients(spark, sf_dir):
    """Named rate-model coefficients (slots only)."""
    return _fit(_rate_rows(spark, sf_dir), "coefficients", lambda d: models.fit_rate_model(d).coefficients)


@register("rate_predictions")
def rate_predictions(spark, sf_dir):
    """In-sample rate predictions."""
    return _fit(_rate_rows(spark, sf_dir), "predictions", lambda d: models.rate_predictions(models.fit_rate_model(d)))


def _sig6(c):
    """Round to 6 significant digits via scientific formatting (engine-neutral)."""
    return F.format_string("%.5e", c).cast("double")


@register("ridge_one_feature")
def ridge_one_feature(spark, sf_dir):
    """O54 identity: one-feature L2 fit of rate on income equals the closed form."""
    fit = models.ridge_one_feature(_rate_rows(spark, sf_dir), "income", "interest_rate")
    return fit.select(_sig6("intercept").alias("intercept"), _sig6("slope").alias("slope"))


@register("approval_prediction_write")
def approval_prediction_write(spark, sf_dir):
    """Scored rows written by the executors as CSV and read back by name.

    ``consistent``: the prediction is the class whose probability is above one half.
    """
    path = shared_dir(spark, "approval-predictions")
    with feats.persisted(feats.evened(_approval_rows(spark, sf_dir))) as cached:
        scored = models.approval_predictions(models.fit_approval_model(cached))
        sinks.write_csv(scored, path)
    back = readers.read_csv_typed(spark, path, scored.schema, required=scored.columns)
    return back.select("income", "loan_amount", "loan_to_income", "race_group", "loan_type", "county_code", "approved",
                       ((F.col("prediction") == 1.0) == (F.col("probability") > 0.5)).alias("consistent"))


@register("rate_prediction_write")
def rate_prediction_write(spark, sf_dir):
    """Scored rate rows as CSV, read back; ``bias`` is the mean error, 0 with a free intercept."""
    path = shared_dir(spark, "rate-predictions")
    with feats.persisted(feats.evened(_rate_rows(spark, sf_dir))) as cached:
        scored = models.rate_predictions(models.fit_rate_model(cached))
        sinks.write_csv(scored, path)
    back = readers.read_csv_typed(spark, path, scored.schema, required=scored.columns)
    bias = back.agg(F.round(F.abs(F.avg("prediction") - F.avg("interest_rate")), 6).alias("bias"))
    return back.select("interest_rate", "race_group", "income", "loan_amount", "county_code",
                       bias.select("bias").scalar().alias("bias"))


def _certified(rows, label, kind, fit, schema, place, reg, digits):
    """The fit's coefficient table written as one CSV file and read back, with the gradient of the loss at what was read."""
    path = shared_dir(rows.sparkSession, place)
    with feats.persisted(feats.evened(rows)) as cached:
        fitted = fit(cached)
        sinks.write_single_csv(fitted.coefficients, path)
        back = readers.read_csv_typed(rows.sparkSession, path, schema, required=schema.names)
        checked = certificate.fit_gradient(fitted.scored, back, label, reg, kind)
        # adding 0 turns a rounded -0.0 into 0.0
        return stored(checked.select("slot", "feature", (F.round("gradient", digits) + 0.0).alias("gradient")), place)


@register("approval_coefficient_write")
def approval_coefficient_write(spark, sf_dir):
    """Coefficients of the converged fit, written, read back, and the penalised loss's gradient at them.

    The study's 20 iterations stop short of the minimum; here the solver goes on until nothing changes.
    """
    def fit(rows):
        return models.fit_approval_model(rows, maxIter=1000, tol=1e-15)
    return _certified(_approval_rows(spark, sf_dir), "approved", "logistic", fit, S.LOGIT_COEFFICIENTS,
                      "approval-coefficients", codes.LOGIT_PARAMS["regParam"], 6)


@register("rate_coefficient_write")
def rate_coefficient_write(spark, sf_dir):
    """The rate model's coefficients, written, read back, and the penalised loss's gradient at them."""
    return _certified(_rate_rows(spark, sf_dir), "interest_rate", "linear", models.fit_rate_model, S.LINEAR_COEFFICIENTS,
                      "rate-coefficients", codes.LINEAR_PARAMS["regParam"], 9)


@register("sample_bernoulli_bounds")
def sample_bernoulli_bounds(spark, sf_dir):
    """The seeded sample holds rows of the table only, once each, and as many as 5 standard deviations allow."""
    apps = stored(fx.applications(spark, sf_dir).select("l_orderkey", "l_linenumber"), "sample-input")
    drawn = stored(clean.sample_bernoulli(apps, 0.1), "sample")
    n, m = apps.agg(F.count("*").alias("n")), drawn.agg(F.count("*").alias("n"))
    foreign = drawn.exceptAll(apps).agg(F.count("*").alias("n"))
    return m.select((foreign.select("n").scalar() == 0).alias("rows_of_the_table"),
                    (F.abs(F.col("n") - 0.1 * n.select("n").scalar())
                     <= 5 * F.sqrt(0.09 * n.select("n").scalar())).alias("size_fits"))


@register("preview")
def preview(spark, sf_dir):
    """O1: column names of a pipe-delimited file, in order, and whether the first rows were read."""
    path = shared_dir(spark, "preview")
    sinks.write_csv(fx.raw_applications(spark, sf_dir), path, sep="|")
    names, head = readers.preview(readers.read_delimited(spark, path))
    return head.agg(F.count("*").alias("rows")).select(
        "rows", F.posexplode(F.array(*map(F.lit, names))).alias("place", "column_name"))


@register("binary_metrics")
def binary_metrics(spark, sf_dir):
    """Accuracy and rank-sum AUC of a score/prediction against approval."""
    apps = fx.applications(spark, sf_dir).withColumn(
        "predicted", (F.coalesce(F.col("income"), F.lit(0.0)) > 50).cast("int"))
    m = metrics.binary_metrics(apps, "approved", "income", "predicted")
    return m.select(F.round("accuracy", 9).alias("accuracy"), F.round("auc", 9).alias("auc"))


@register("regression_metrics")
def regression_metrics(spark, sf_dir):
    """R² and RMSE of the county-mean rate as a predictor of the rate."""
    rows = _rate_rows(spark, sf_dir).select("county_code", "interest_rate")
    # One row per county, written first: its real size lets Spark broadcast it before any row is exchanged.
    means = stored(rows.groupBy("county_code").agg(F.avg("interest_rate").alias("county_rate")), "county-means")
    scored = rows.join(means, "county_code")
    m = metrics.regression_metrics(scored, "interest_rate", "county_rate")
    return m.select("n", F.round("r2", 9).alias("r2"), F.round("rmse", 9).alias("rmse"))


# --- sources and sinks (O1–O13) ----------------------------------------------------------
# Each writes data Spark derived from the tables into a fresh folder under the
# cluster's shared checkpoint location, then reads it back with the reader.

@register("read_pipe_delimited")
def read_pipe_delimited(spark, sf_dir):
    """O1: raw rows written as a pipe-delimited file with header, read back typed."""
    path = shared_dir(spark, "pipe")
    sinks.write_csv(fx.raw_applications(spark, sf_dir), path, sep="|")
    return readers.read_delimited(spark, path, sep="|", schema=fx.RAW, required=S.REQUIRED_RAW)


@register("read_csv_typed")
def read_csv_typed(spark, sf_dir):
    """O2: cleaned rows written as CSV, read back under the explicit schema."""
    path = shared_dir(spark, "csv")
    sinks.write_csv(fx.applications(spark, sf_dir), path)
    return readers.read_csv_typed(spark, path, fx.APPLICATION, required=S.REQUIRED_APPLICATION)


@register("read_yearly_files")
def read_yearly_files(spark, sf_dir):
    """O3: two yearly file sets, the early one without the rate column."""
    raw = fx.raw_applications(spark, sf_dir)
    early, late = shared_dir(spark, "early"), shared_dir(spark, "late")
    sinks.write_csv(raw.where(F.col("activity_year") <= 1997).drop("interest_rate"), early)
    sinks.write_csv(raw.where(F.col("activity_year") > 1997), late)
    df = readers.read_yearly_files(spark, [early, late], S.RAW_APPLICATION, required=S.REQUIRED_RAW)
    return df.groupBy("activity_year").agg(F.count(F.lit(1)).alias("n"),
                                           F.count("interest_rate").alias("n_rate"))


@register("read_parquet_partitioned")
def read_parquet_partitioned(spark, sf_dir):
    """Cleaned rows as Parquet partitioned by state and year; read TX only."""
    path = shared_dir(spark, "parquet")
    sinks.write_parquet(fx.applications(spark, sf_dir), path, ["state_code", "activity_year"])
    return readers.read_parquet_partitioned(spark, path, states=["TX"]).select(*fx.APPLICATION_COLUMNS)


@register("sink_roundtrip_csv")
def sink_roundtrip_csv(spark, sf_dir):
    """Model rows written by the executors as CSV and read back."""
    rows = feats.model_features(clean.prep_approval(fx.applications(spark, sf_dir))).select(*_PREP_COLS)
    path = shared_dir(spark, "sink")
    sinks.write_csv(rows, path)
    sch = T.StructType([rows.schema[c] for c in _PREP_COLS])
    return readers.read_csv_typed(spark, path, sch)


@register("lossless_csv")
def lossless_csv(spark, sf_dir):
    """Whole texts with line breaks, quotes and separators, null and empty values, through files that can be split."""
    docs = fx.table(spark, sf_dir, "documents")
    third = F.pmod("doc_id", F.lit(3))
    rows = docs.select("doc_id", "text", F.when(third == 1, F.lit("")).when(third == 2, F.concat(F.lit(" \\"), "lang"))
                       .alias("note"), "n_chars")
    path = shared_dir(spark, "lossless")
    sinks.write_lossless_csv(rows, path)
    return readers.read_lossless_csv(spark, path, rows.schema)


@register("read_mixed_headers")
def read_mixed_headers(spark, sf_dir):
    """O1–O3: one folder of files whose columns stand in two orders, each file under its own header."""
    raw = fx.raw_applications(spark, sf_dir)
    path = shared_dir(spark, "mixed")
    early = F.col("activity_year") <= 1995
    sinks.write_csv(raw.where(early), path, sep="|")
    sinks.write_csv(raw.where(~early).select(*reversed(raw.columns)), path, mode="append", sep="|")
    return headers.read_mixed_headers(spark, path, fx.RAW, sep="|", required=S.REQUIRED_RAW)


@register("saved_model_scores")
def saved_model_scores(spark, sf_dir):
    """A rate model fitted on years up to 1995, saved and reloaded, scores the later ones as it did before.

    Their years are categories that the fit never saw.
    """
    rows = _rate_rows(spark, sf_dir)
    path = shared_dir(spark, "saved-model")
    with feats.persisted(feats.evened(rows)) as cached:
        fitted = models.fit_rate_model(cached.where("activity_year <= 1995"))
        models.save_model(fitted, path)
        saved = models.load_model(spark, path)
        new = cached.where("activity_year > 1995")
        before = models.score_rows(models.SavedModel(fitted.pipeline, fitted.names, saved.label), new, "before")
        both = models.score_rows(saved, before, "after")
        return stored(both.select(*rows.columns, (F.col("before") == F.col("after")).alias("same")), "saved-scores")


@register("saved_model_stream")
def saved_model_stream(spark, sf_dir):
    """O56 as a stream: the saved model scores prepared rows as their files arrive."""
    from fairlend.streaming import yearly

    rows = _rate_rows(spark, sf_dir)
    model, landing, out, ckpt = (shared_dir(spark, n) for n in ("stream-model", "scoring", "scored", "scoring-ckpt"))
    with feats.persisted(feats.evened(rows)) as cached:
        models.save_model(models.fit_rate_model(cached.where("activity_year <= 1995")), model)
        sinks.write_parquet(cached.where("activity_year > 1995"), landing)
    yearly.start_scoring(spark, model, landing, rows.schema, out, ckpt, max_files_per_trigger=4).awaitTermination()
    scored = spark.read.parquet(out)
    return scored.select(*rows.columns, F.col("prediction").isNotNull().alias("scored"))


@register("read_county_table")
def read_county_table(spark, sf_dir):
    """County attributes written with census column names, read back and renamed."""
    dim = fx.county_dimension(spark, sf_dir).select(
        F.col("county_fips").alias("GEOID"), F.col("statefp").alias("STATEFP"),
        F.col("name").alias("NAME"))
    path = shared_dir(spark, "counties")
    sinks.write_csv(dim, path)
    return readers.read_county_dimension(spark, path)


@register("read_gap_table")
def read_gap_table(spark, sf_dir):
    """The county gap table written as CSV and read back under its schema."""
    path = shared_dir(spark, "gap-table")
    sinks.write_csv(gaps.county_gaps(fx.applications(spark, sf_dir)), path)
    return readers.read_gap_table(spark, path)


@register("single_file_sink")
def single_file_sink(spark, sf_dir):
    """The top 25 written as one CSV part file, read back."""
    path = shared_dir(spark, "top25")
    sinks.write_single_csv(county_gap_top25(spark, sf_dir), path)
    return readers.read_gap_table(spark, path)


@register("yearly_rewrite")
def yearly_rewrite(spark, sf_dir):
    """A dataset whose year 1997 was wrong (amounts doubled, a state that is none), that year replaced, all read."""
    apps = fx.applications(spark, sf_dir)
    year = F.col("activity_year") == 1997
    wrong = apps.withColumns({"loan_amount": F.when(year, F.col("loan_amount") * 2).otherwise(F.col("loan_amount")),
                              "state_code": F.when(year, F.lit("XX")).otherwise(F.col("state_code"))})
    path = shared_dir(spark, "rewritten")
    sinks.write_parquet(wrong, path, ["state_code", "activity_year"])
    sinks.replace_years(apps.where(year), path, [1997])
    return readers.read_parquet_partitioned(spark, path).select(*fx.APPLICATION_COLUMNS)


@register("observed_audit")
def observed_audit(spark, sf_dir):
    """Rows left after each cleaning rule, counted by the write of the cleaned rows."""
    audit = clean.CleaningAudit(fx.raw_applications(side_session(spark), sf_dir))
    path = shared_dir(spark, "audited")
    sinks.write_parquet(clean.clean_applications(audit.observed), path)
    return audit.table(spark.read.parquet(path).count())


@register("clean_partitioned_write")
def clean_partitioned_write(spark, sf_dir):
    """Cleaned rows written per year as CSV; rows per state and year read back."""
    path = shared_dir(spark, "yearly")
    sinks.write_partitioned_csv(fx.applications(spark, sf_dir), path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy("state_code", F.col("activity_year").cast("int").alias("activity_year")) \
        .agg(F.count(F.lit(1)).alias("n"))


# --- streaming ingest ----------------------------------------------------------------------

@register("stream_mixed_headers")
def stream_mixed_headers(spark, sf_dir):
    """O1–O3, O42–O44 as streams: files in two column orders → rows of one schema → per-county state → gaps."""
    from fairlend.streaming import yearly

    raw = fx.raw_applications(spark, sf_dir)
    landing, rows, out = (shared_dir(spark, n) for n in ("mixed-landing", "mixed-rows", "mixed-gaps"))
    early = F.col("activity_year") <= 1995
    sinks.write_csv(raw.where(early), landing)
    sinks.write_csv(raw.where(~early).select(*reversed(raw.columns)), landing, mode="append")
    headers.start_ingest(spark, landing, rows, shared_dir(spark, "mixed-ckpt"), S.RAW_APPLICATION, required=S.REQUIRED_RAW,
                         max_files_per_trigger=4).awaitTermination()
    stream = headers.ingested_stream(spark, rows, S.RAW_APPLICATION)
    yearly.start_county_gaps(spark, landing, out, shared_dir(spark, "mixed-state"), raw=stream).awaitTermination()
    return yearly.read_county_gaps(spark, out)


@register("stream_county_gaps")
def stream_county_gaps(spark, sf_dir):
    """O3, O42–O44 as a stream: raw files → cleaned → per-county state → gaps.

    The raw rows land as CSV part files; the stream takes one file per
    micro-batch, so the county state is built up over several batches.  The
    final published table must equal the batch gap table.
    """
    from fairlend.streaming import yearly

    landing = shared_dir(spark, "landing")
    sinks.write_csv(fx.raw_applications(spark, sf_dir), landing)
    out = shared_dir(spark, "stream-gaps")
    q = yearly.start_county_gaps(spark, landing, out, shared_dir(spark, "stream-ckpt"),
                                 max_files_per_trigger=1)
    q.awaitTermination()
    return yearly.read_county_gaps(spark, out)
