"""Derived columns."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlend.functions import codes
from fairlend.functions.columns import code_to_label, guarded_ratio
from fairlend.functions.lineage import parallelism


def add_loan_to_income(df: DataFrame, zero_as: float | None = 0.0,
                       out: str = "loan_to_income") -> DataFrame:
    """``loan_amount / income`` when both are positive.

    ``zero_as=0.0`` is the model variant; ``zero_as=None`` leaves the ratio
    null, the variant of the summary table (D5).
    """
    return df.withColumn(out, guarded_ratio("loan_amount", "income", zero_as))


def add_race_group(df: DataFrame, scheme: str = "five", col: str = "applicant_race_1",
                   out: str = "race_group") -> DataFrame:
    """Race code → group label; ``scheme`` is ``'five'`` or ``'seven'``."""
    if scheme == "five":
        expr = code_to_label(col, codes.RACE_FIVE, codes.RACE_FIVE_DEFAULT)
    elif scheme == "seven":
        expr = code_to_label(col, codes.RACE_SEVEN, codes.RACE_SEVEN_DEFAULT)
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    return df.withColumn(out, expr)


def add_comparison_group(df: DataFrame, drop_unassigned: bool = True,
                         group_col: str = "race_group",
                         out: str = "comparison_group") -> DataFrame:
    """Race group → Advantaged / Disadvantaged, others null (and dropped)."""
    expr = code_to_label(group_col, codes.COMPARISON_GROUPS, None)
    df = df.withColumn(out, expr)
    return df.where(F.col(out).isNotNull()) if drop_unassigned else df


def model_features(df: DataFrame) -> DataFrame:
    """Loan-to-income (0-variant) and the five-label race group."""
    return add_race_group(add_loan_to_income(df))


def evened(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over as many tasks as the cluster has cores, or shuffles have partitions if more.

    For a prepared set that several passes read: a source of few splits (one
    row group, one gzip file) or a selective filter would leave all its rows to
    a few tasks of every pass.  The number is given, since AQE merges what a
    rebalance by size gives to partitions of 1 MB and more.
    """
    spark = df.sparkSession
    return df.repartition(max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))))


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Keep a prepared set across the several passes of a model fit.

    MEMORY_AND_DISK so a set larger than the store spills instead of being
    recomputed; lost blocks are rebuilt from lineage if an executor dies.
    """
    cached = df.persist(level)
    try:
        yield cached
    finally:
        cached.unpersist()
