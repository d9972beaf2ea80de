"""Sample-versus-full stability of the rate model (the study's 10 % / full practice)."""

import math

from pyspark.sql import functions as F

from fairlend.operators import clean, models
from fairlend.operators import features as feats
from fairlend.plans import fixture as fx
from tests.conftest import SF01


def test_rate_race_coefficients_stable_under_key_sample(spark):
    rows = feats.model_features(clean.prep_rate(fx.applications(spark, SF01))).cache()
    half = clean.sample_by_key(rows, 0.5, ["l_orderkey", "l_linenumber"])
    full = {r.feature: r.coefficient for r in models.fit_rate_model(rows).coefficients.collect()}
    samp = {r.feature: r.coefficient for r in models.fit_rate_model(half).coefficients.collect()}
    sd = half.agg(F.stddev("interest_rate")).first()[0]
    n_min = min(r[1] for r in half.groupBy("race_group").count().collect())
    tol = 4 * sd / math.sqrt(n_min)  # four standard errors of a group mean
    race = [k for k in full if k.startswith("race_group_vec_")]
    assert race and all(k in samp for k in race)
    for k in race:
        assert abs(full[k] - samp[k]) < tol, (k, full[k], samp[k], tol)
    rows.unpersist()
