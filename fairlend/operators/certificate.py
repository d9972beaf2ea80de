"""Certificate of a fit (O53, O54, O58): the gradient of the penalised loss at the coefficients.

At the minimum it is 0 in every slot, whatever the solver did to get there; a
coefficient that is off, or a penalty other than the stated one, shows.  One
pass over the sparse vectors: MLlib's ``Summarizer`` adds up each slot weighted
by the positive and by the negative residuals in one tree aggregation.  Only
the summed vectors (model width) become rows.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Added to every weight: a summary without any positive weight would fail.
_TINY = 1e-300


def slot_sums(scored: DataFrame, label: str, predicted: str, features: str = "features") -> DataFrame:
    """(slot, n, mean, variance, cross, bias, label_std) from one pass over the scored rows.

    ``cross``: mean of the slot times the residual ``label - predicted``;
    ``bias``: mean residual; ``variance``: the slot's, with divisor n;
    ``label_std``: the label's, with divisor n.
    """
    r = F.col(label).cast("double") - F.col(predicted)
    rows = scored.select(F.col(features).alias("x"), r.alias("r"), F.col(label).cast("double").alias("y"),
                         (F.greatest(r, F.lit(0.0)) + _TINY).alias("above"),
                         (F.greatest(-r, F.lit(0.0)) + _TINY).alias("below"))
    one = rows.agg(F.count("*").alias("n"), F.avg("r").alias("bias"), F.stddev_pop("y").alias("label_std"),
                   Summarizer.sum(F.col("x"), F.col("above")).alias("above"),
                   Summarizer.sum(F.col("x"), F.col("below")).alias("below"),
                   Summarizer.mean(F.col("x")).alias("mean"), Summarizer.variance(F.col("x")).alias("variance"))
    names = ["above", "below", "mean", "variance"]
    zipped = F.arrays_zip(*(vector_to_array(c).alias(c) for c in names))
    slots = one.select("n", "bias", "label_std", F.posexplode(zipped).alias("slot", "s"))
    n = F.col("n")
    return slots.select("slot", "n", F.col("s.mean").alias("mean"),
                        (F.col("s.variance") * (n - 1) / n).alias("variance"),
                        ((F.col("s.above") - F.col("s.below")) / n).alias("cross"), "bias", "label_std")


def fit_gradient(scored: DataFrame, coefficients: DataFrame, label: str, reg: float, kind: str) -> DataFrame:
    """(slot, feature, coefficient, gradient) of a fit with L2 penalty ``reg``; 0 where the fit is the minimum.

    ``coefficients``: (slot, feature, coefficient), the table of a fit, with or
    without an intercept row after the slots; ``scored``: the training rows as
    that fit scored them.  Both models penalise coefficients of features scaled
    to unit deviation: linear, mean of the centred slot times the residual over
    the slot's deviation, less ``reg * deviation * coefficient / deviation of
    the label`` (divisor n); logistic, the mean of the slot times label less
    probability over its deviation, less ``reg * deviation * coefficient``
    (divisor n - 1).  For the intercept: the mean residual.  A slot without
    variance has no gradient to follow: its coefficient must be 0.
    """
    if kind == "logistic":
        scored = scored.withColumn("__predicted", vector_to_array("probability")[1])
        spread = F.sqrt(F.col("variance") * F.col("n") / (F.col("n") - 1))
        scale = F.lit(1.0)
    elif kind == "linear":
        scored = scored.withColumn("__predicted", F.col("prediction"))
        spread = F.sqrt("variance")
        scale = F.col("label_std")
    else:
        raise ValueError(f"unknown kind {kind!r}")
    sums = slot_sums(scored, label, "__predicted")
    sd, b = F.col("sd"), F.col("coefficient")
    pull = (F.col("cross") - F.col("mean") * F.col("bias")) / sd
    slots = coefficients.select("slot", "feature", "coefficient").join(sums.withColumn("sd", spread), "slot", "left")
    # The intercept's row has no slot; its gradient is the bias, the same in all rows (as many as the model is wide).
    bias = F.max("bias").over(Window.partitionBy(F.lit(0)))
    gradient = F.when(F.col("mean").isNull(), bias).when(sd > 0, pull - reg * sd * b / scale).otherwise(b)
    return slots.select("slot", "feature", "coefficient", gradient.alias("gradient"))
