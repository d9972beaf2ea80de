"""Fit metrics (O59–O60) on any (label, score/prediction) table.

In-sample, as in the study.  Both are aggregations over the whole table;
AUC uses the distributed rank-sum in ``functions.ordered`` (no single-task
sort, ties get averaged ranks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlend.functions.ordered import auc_from_score_counts


def binary_metrics(df: DataFrame, label: str, score: str, prediction: str) -> DataFrame:
    """One row (accuracy, auc) from a single pass over ``df``.

    The input is reduced once to per-score counts (positives, negatives,
    correct predictions); accuracy and the rank-sum AUC come from one plan
    over them, without a checkpoint.  Rows without a score count for the
    accuracy only.
    """
    y, p, s = F.col(label), F.col(prediction), F.col(score).cast("double")
    scored = F.col("s").isNotNull()
    per = df.groupBy(s.alias("s")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(y.isNotNull() & (y != 1), 1).otherwise(0)).alias("neg"),
        F.sum(F.when(y == p, 1).otherwise(0)).alias("correct"),
        F.count(y == p).alias("compared"))
    per = per.withColumns({c: F.when(scored, F.col(c)).otherwise(0) for c in ("pos", "neg")})
    both = auc_from_score_counts(per, extra=["correct", "compared"])
    return both.select((F.col("correct") / F.nullif(F.col("compared"), F.lit(0))).alias("accuracy"), "auc")


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row (n, r2, rmse); r2 = 1 − SSE/SST about the label mean."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    sums = df.where(y.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((y - p) * (y - p)).alias("sse"),
        F.var_pop(y).alias("var_y"))
    return sums.select(
        "n",
        (1 - F.col("sse") / (F.col("var_y") * F.col("n"))).alias("r2"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def model_summary_row(fitted, kind: str, rows: int | None = None) -> DataFrame:
    """One row of in-sample fit metrics.

    Logistic: accuracy and the exact rank-sum AUC from :func:`binary_metrics`
    (one pass over the scored rows).  MLlib's training summary gives the same
    accuracy but bins the ROC curve into 100 points, so its AUC differs in
    about the sixth decimal, and it sorts every score and re-scores the rows
    several times (2.4x slower at 6M rows).  Linear: R² and RMSE from
    :func:`regression_metrics`, one pass over the scored rows.  ``rows``: the
    training row count if the caller has it (e.g. from the persisted training
    set).
    """
    from pyspark.ml.functions import vector_to_array

    m = fitted.model
    if kind == "logistic":
        label = m.getLabelCol()
        scored = fitted.scored.withColumn("__p1", vector_to_array("probability")[1])
        met = binary_metrics(scored, label, "__p1", "prediction")
        n = rows if rows is not None else fitted.scored.count()
        return met.select(F.lit(int(n)).cast("long").alias("rows"),
                          F.lit(len(fitted.names)).cast("int").alias("width"),
                          F.lit(float(m.intercept)).alias("intercept"), "accuracy", "auc")
    met = regression_metrics(fitted.scored, m.getLabelCol(), "prediction")
    return met.select(F.col("n").cast("long").alias("rows"), F.lit(len(fitted.names)).cast("int").alias("width"),
                      F.lit(float(m.intercept)).alias("intercept"), "r2", "rmse")
