"""The gradient at a fit's coefficients is 0 for the fit's own penalty and not for another."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fairlend.operators import certificate, clean, models
from fairlend.operators import features as feats
from fairlend.plans import fixture as fx
from tests.conftest import SF001


@pytest.fixture(scope="module")
def approval(spark):
    rows = feats.model_features(clean.prep_approval(fx.applications(spark, SF001))).select(*models.fit_columns("approved"))
    with feats.persisted(feats.evened(rows)) as kept:
        yield models.fit_approval_model(kept, maxIter=1000, tol=1e-15)


@pytest.fixture(scope="module")
def rate(spark):
    rows = feats.model_features(clean.prep_rate(fx.applications(spark, SF001))).select(*models.fit_columns("interest_rate"))
    with feats.persisted(feats.evened(rows)) as kept:
        yield models.fit_rate_model(kept)


def worst(fitted, label, reg, kind, table=None):
    out = certificate.fit_gradient(fitted.scored, table if table is not None else fitted.coefficients, label, reg, kind)
    return max(abs(r.gradient) for r in out.collect())


def test_linear_fit(rate):
    assert worst(rate, "interest_rate", 0.01, "linear") < 1e-10
    assert worst(rate, "interest_rate", 0.02, "linear") > 1e-5
    moved = rate.coefficients.withColumn("coefficient", F.col("coefficient") * 1.01)
    assert worst(rate, "interest_rate", 0.01, "linear", moved) > 1e-6


def test_logistic_fit(approval):
    out = certificate.fit_gradient(approval.scored, approval.coefficients, "approved", 0.01, "logistic").collect()
    assert [r.feature for r in sorted(out)][-1] == "Intercept" and len(out) == len(approval.names) + 1
    assert max(abs(r.gradient) for r in out) < 4e-7
    assert worst(approval, "approved", 0.02, "logistic") > 1e-4


def test_unconverged_fit_shows(spark, approval):
    few = models.fit_approval_model(approval.scored.select(*models.fit_columns("approved")), maxIter=2)
    assert worst(few, "approved", 0.01, "logistic") > 1e-4


def test_sums_against_numpy(rate):
    got = certificate.slot_sums(rate.scored, "interest_rate", "prediction").orderBy("slot").collect()
    rows = rate.scored.select(vector_to_array("features"), "interest_rate", "prediction").collect()
    x, y, p = (np.array([r[i] for r in rows]) for i in range(3))
    np.testing.assert_allclose([r["mean"] for r in got], x.mean(axis=0), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose([r.variance for r in got], x.var(axis=0), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose([r.cross for r in got], x.T @ (y - p) / len(y), rtol=1e-7, atol=1e-7)


def test_perfect_fit_and_constant_slot(spark):
    from pyspark.ml.linalg import Vectors
    rows = spark.createDataFrame([(Vectors.dense([1.0, 5.0]), 1.0, 1.0), (Vectors.dense([2.0, 5.0]), 2.0, 2.0)],
                                 ["features", "y", "prediction"])
    table = spark.createDataFrame([(0, "a", 1.0), (1, "b", 0.0)], "slot int, feature string, coefficient double")
    assert [r.gradient for r in sorted(certificate.fit_gradient(rows, table, "y", 0.0, "linear").collect())] == [0.0, 0.0]
    with pytest.raises(ValueError, match="kind"):
        certificate.fit_gradient(rows, table, "y", 0.0, "other")
