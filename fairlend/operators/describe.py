"""Descriptive tables (O36–O41): rates by group, summary, histograms.

All are single hash aggregations (partial + final); outputs have one row
per group, so they are tiny whatever the input size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlend.functions import codes
from fairlend.functions.columns import value_to_label
from fairlend.operators.features import add_loan_to_income, add_race_group
from fairlend.operators.profile import summary_long


def approval_by_race(apps: DataFrame) -> DataFrame:
    """Approval rate and applications per seven-label race group, highest first."""
    g = add_race_group(apps, "seven")
    return (g.groupBy("race_group")
            .agg(F.avg("approved").alias("approval_rate"),
                 F.count(F.lit(1)).alias("applications"))
            .orderBy(F.desc("approval_rate"), F.asc("race_group")))


def approval_over_time(apps: DataFrame, year_col: str = "activity_year") -> DataFrame:
    """Approval rate per year, ascending."""
    return (apps.groupBy(year_col).agg(F.avg("approved").alias("approval_rate"))
            .orderBy(year_col))


def loan_type_approval(apps: DataFrame) -> DataFrame:
    """Approval rate and count per loan type, with its label."""
    return (apps.groupBy("loan_type")
            .agg(F.avg("approved").alias("approval_rate"),
                 F.count(F.lit(1)).alias("applications"))
            .withColumn("loan_label", value_to_label("loan_type", codes.LOAN_LABELS))
            .orderBy(F.asc_nulls_last("loan_type")))


def interest_by_race(apps: DataFrame, exclude: Sequence[str] = (codes.RACE_SEVEN_DEFAULT,),
                     digits: int | None = None) -> DataFrame:
    """Mean rate and loan count per race group over rows with a rate.

    The catch-all group is left out by default, as in the studied report.
    """
    g = add_race_group(apps.where(F.col("interest_rate").isNotNull()), "seven")
    if exclude:
        g = g.where(~F.col("race_group").isin(list(exclude)))
    avg = F.avg("interest_rate")
    return (g.groupBy("race_group")
            .agg(avg.alias("__avg"), F.count(F.lit(1)).alias("loans"))
            .orderBy(F.desc("__avg"), F.asc("race_group"))
            .select("race_group", (F.round("__avg", digits) if digits is not None else F.col("__avg"))
                    .alias("avg_interest_rate"), "loans"))


SUMMARY_MEASURES = ["loan_amount", "income", "interest_rate", "loan_to_income"]
#: The columns that they are made of.
SUMMARY_INPUTS = ["loan_amount", "income", "interest_rate"]


def summary_statistics(apps: DataFrame, digits: int | None = None) -> DataFrame:
    """Count, mean, stddev, min, exact quartiles, max of the four measures.

    The ratio uses the null variant (no ratio without positive income).
    """
    df = add_loan_to_income(apps, zero_as=None)
    return summary_long(df, SUMMARY_MEASURES, digits)


def summary_wide(long: DataFrame, measures: Sequence[str] = SUMMARY_MEASURES) -> DataFrame:
    """O40 in the study's layout: one row per statistic, one column per measure.

    A pivot with the measure list given, so Spark needs no extra job to find
    the pivot values; the input is the small long-form table.
    """
    wide = long.groupBy(F.col("statistic").alias("summary")).pivot("measure", list(measures)) \
        .agg(F.first("value"))
    return wide.orderBy(_stat_rank("summary"))


def _stat_rank(col: str):
    order = ["count", "mean", "stddev", "std", "min", "25%", "50%", "75%", "max"]
    expr = None
    for i, k in enumerate(order):
        cond = F.col(col) == k
        expr = F.when(cond, i) if expr is None else expr.when(cond, i)
    return expr.otherwise(len(order))


def histogram(df: DataFrame, col: str, width: float, origin: float = 0.0) -> DataFrame:
    """Fixed-width bins ``floor((x - origin) / width)`` with counts."""
    x = F.col(col).cast("double")
    b = F.floor((x - F.lit(origin)) / F.lit(width)).cast("long")
    return (df.where(x.isNotNull() & ~F.isnan(x)).groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("bin",
                    (F.lit(origin) + F.col("bin") * F.lit(width)).alias("bin_start"),
                    (F.lit(origin) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
                    "n")
            .orderBy("bin"))
