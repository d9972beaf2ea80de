"""Model identities (closed-form ridge, saturated logit) and slot naming."""

import math

import numpy as np
from pyspark.sql import functions as F

from fairlend.operators import features as feats
from fairlend.operators import models
from fairlend.plans import fixture as fx
from tests.conftest import SF001


def _rows(spark):
    from fairlend.operators import clean
    return feats.model_features(clean.prep_approval(fx.applications(spark, SF001)))


def test_slot_names_cover_width_in_index_order(spark):
    rows = _rows(spark)
    fitted = models.fit_approval_model(rows, maxIter=5)
    width = len(fitted.model.coefficients)
    assert len(fitted.names) == width
    assert fitted.names[:3] == ["income", "loan_amount", "loan_to_income"]
    assert all(n.startswith(("race_group_vec_", "loan_type_vec_", "county_code_vec_",
                             "activity_year_vec_")) for n in fitted.names[3:])
    coefs = fitted.coefficients.orderBy("slot").collect()
    assert coefs[-1].feature == "Intercept" and len(coefs) == width + 1
    for r in coefs:
        assert abs(r.odds_ratio - math.exp(r.coefficient)) < 1e-12
    # every real race level keeps a slot (drop-last only removes the unseen bucket)
    n_race = rows.select("race_group").distinct().count()
    assert sum(n.startswith("race_group_vec_") for n in fitted.names) == n_race


def test_index_order_ties_alphabetical_and_unseen_kept(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "race_group string")
    idx = models.feature_stages(["race_group"], [])[0].fit(df)
    assert idx.labelsArray[0] == ["c", "a", "b"]
    unseen = idx.transform(spark.createDataFrame([("z",)], "race_group string")).first()
    assert unseen["race_group_idx"] == 3.0


def test_ridge_one_feature_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(50, 10, 400)
    y = 3 + 0.2 * x + rng.normal(0, 1, 400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit = models.ridge_one_feature(df, "x", "y", reg=0.01).first()
    slope = (np.cov(x, y, bias=True)[0, 1] / x.var()) / (1 + 0.01 / y.std())
    assert abs(fit.slope - slope) < 1e-8
    assert abs(fit.intercept - (y.mean() - slope * x.mean())) < 1e-6


def test_saturated_logit_reproduces_group_rates(spark):
    rows = [("A", 1)] * 30 + [("A", 0)] * 10 + [("B", 1)] * 5 + [("B", 0)] * 15 + [("C", 1)] * 9 + [("C", 0)] * 1
    df = spark.createDataFrame(rows, "race_group string, approved int")
    got = {r[0]: r[1] for r in models.group_rate_logit(df).collect()}
    assert abs(got["A"] - 0.75) < 1e-6 and abs(got["B"] - 0.25) < 1e-6 and abs(got["C"] - 0.9) < 1e-6


def test_predictions_have_probability_double(spark):
    fitted = models.fit_approval_model(_rows(spark), maxIter=3)
    p = models.approval_predictions(fitted)
    assert dict(p.dtypes)["probability"] == "double"
    r = p.agg(F.min("probability"), F.max("probability")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0


def test_rate_model_summary(spark):
    from fairlend.operators import clean, metrics
    rows = feats.model_features(clean.prep_rate(fx.applications(spark, SF001)))
    fitted = models.fit_rate_model(rows)
    s = metrics.model_summary_row(fitted, "linear").first()
    assert s.rows == rows.count() and s.width == len(fitted.names)
    assert s.rmse > 0


def test_logistic_summary_row_agrees_with_mllib(spark):
    from fairlend.operators import metrics
    fitted = models.fit_approval_model(_rows(spark), maxIter=5)
    row = metrics.model_summary_row(fitted, "logistic").first()
    s = fitted.model.summary
    assert row.accuracy == s.accuracy
    assert abs(row.auc - s.areaUnderROC) < 1e-4
    assert row.rows == _rows(spark).count() and row.width == len(fitted.names)
