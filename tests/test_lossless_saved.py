"""CSV that loses nothing and stays splittable; saved models on new rows."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlend.operators import clean, models
from fairlend.operators import features as feats
from fairlend.plans import fixture as fx
from fairlend.plans.session import shared_dir
from fairlend.sources import readers, sinks
from tests.conftest import SF001

VALUES = ["a\nb", "", None, " ", "  both  ", '"', '""quoted""', "a,b|c", "\\N", "\\n", "\\", "\\\\b", "line\r\nline", "\r",
          "tab\t", "\x00", "é x", "x" * 100_000, "#", "null"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sep", [",", "|", "\t"])
def test_values_survive(spark, sep):
    path = shared_dir(spark, "lossless")
    df = spark.createDataFrame([(i, v, VALUES[-i - 1], i * 0.1 if i % 2 else None, None, i % 2 == 0)
                                for i, v in enumerate(VALUES)],
                               "id long, a string, `b,\\n` string, x double, d date, t boolean")
    sinks.write_lossless_csv(df, path, sep=sep)
    assert rows_of(readers.read_lossless_csv(spark, path, df.schema, sep=sep)) == rows_of(df)


def test_a_lone_column_and_no_rows(spark):
    path = shared_dir(spark, "lone")
    df = spark.createDataFrame([(None,), ("",), ("a\nb",), (None,)], "v string")
    sinks.write_lossless_csv(df, path)
    assert rows_of(readers.read_lossless_csv(spark, path, df.schema)) == rows_of(df)
    path = shared_dir(spark, "none")
    sinks.write_lossless_csv(df.limit(0), path)
    assert readers.read_lossless_csv(spark, path, df.schema, required=[]).count() == 0


def test_extreme_doubles_and_times(spark):
    path = shared_dir(spark, "doubles")
    df = spark.createDataFrame([(5e-324, 1), (1.7976931348623157e308, 2), (0.1, 3), (-0.0, 4), (float("inf"), 5)], "x double, i int")
    df = df.withColumn("at", F.timestamp_micros(F.col("i") * 1_000_001)).withColumn("day", F.date_add(F.lit("2020-02-28"), F.col("i")))
    sinks.write_lossless_csv(df, path)
    assert rows_of(readers.read_lossless_csv(spark, path, df.schema)) == rows_of(df)


def test_files_are_read_in_splits(spark):
    path = shared_dir(spark, "splits")
    df = spark.range(4000, numPartitions=1).select("id", F.concat(F.lit("a\nb\n"), F.repeat(F.lit("x"), 100)).alias("v"))
    sinks.write_lossless_csv(df, path)
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "65536")
    try:
        back = readers.read_lossless_csv(spark, path, df.schema)
        assert back.rdd.getNumPartitions() > 3
        assert back.count() == 4000 and back.where("v like 'a\nb\n%'").count() == 4000
    finally:
        spark.conf.set(key, before)


def _rate_rows(spark):
    rows = feats.model_features(clean.prep_rate(fx.applications(spark, SF001)))
    return rows.select(*models.fit_columns("interest_rate"))


def test_saved_model_scores_as_before(spark):
    rows, path = _rate_rows(spark), shared_dir(spark, "model")
    fitted = models.fit_rate_model(rows)
    models.save_model(fitted, path)
    saved = models.load_model(spark, path)
    assert saved.names == fitted.names and saved.label == "interest_rate"
    assert saved.inputs == [*models.codes.NUMERIC_FEATURES, *models.codes.CATEGORICAL_FEATURES]
    assert rows_of(models.score_rows(saved, rows)) == rows_of(fitted.scored.select(*rows.columns, "prediction"))


def test_unseen_categories_are_in_the_extra_bucket(spark):
    rows, path = _rate_rows(spark), shared_dir(spark, "unseen")
    fitted = models.fit_rate_model(rows)
    models.save_model(fitted, path)
    saved = models.load_model(spark, path)
    at = {n: float(c) for n, c in zip(saved.names, fitted.model.coefficients)}
    new = spark.createDataFrame([("nowhere", 77, 1.0, 3000, 2.0, 3.0, 4.0)],
                                "race_group string, loan_type int, county_code double, activity_year int, "
                                "income double, loan_amount double, loan_to_income double")
    got = models.score_rows(saved, new).first()
    want = fitted.model.intercept + 2.0 * at["income"] + 3.0 * at["loan_amount"] + 4.0 * at["loan_to_income"]
    assert abs(got.prediction - want) < 1e-9


def test_saved_logit_gives_probabilities(spark):
    rows = feats.model_features(clean.prep_approval(fx.applications(spark, SF001))).select(*models.fit_columns("approved"))
    fitted, path = models.fit_approval_model(rows, maxIter=3), shared_dir(spark, "logit")
    models.save_model(fitted, path)
    got = models.score_rows(models.load_model(spark, path), rows.drop("approved"))
    assert got.columns[-2:] == ["prediction", "probability"]
    assert got.where("prediction <> if(probability > 0.5, 1.0, 0.0)").count() == 0
    with pytest.raises(ValueError, match="prediction"):
        models.score_rows(models.load_model(spark, path), got)


def test_a_folder_with_other_slots_raises(spark):
    rows, path = _rate_rows(spark), shared_dir(spark, "torn")
    models.save_model(models.fit_rate_model(rows), path)
    spark.createDataFrame([(0, "a", "y")], "slot int, feature string, label string").write.mode("overwrite").parquet(f"{path}/slots")
    with pytest.raises(ValueError, match="names 1 slots"):
        models.load_model(spark, path)


def test_stream_scores_as_batch(spark):
    from fairlend.streaming import yearly
    rows = _rate_rows(spark)
    model, landing, out, ckpt = (shared_dir(spark, n) for n in ("m", "l", "o", "c"))
    models.save_model(models.fit_rate_model(rows.where("activity_year <= 1995")), model)
    sinks.write_parquet(rows.repartition(3), landing)
    for _ in range(2):
        yearly.start_scoring(spark, model, landing, rows.schema, out, ckpt, max_files_per_trigger=1).awaitTermination()
    assert rows_of(spark.read.parquet(out)) == rows_of(models.score_rows(models.load_model(spark, model), rows))


def test_county_table_names_what_it_lacks(spark):
    path = shared_dir(spark, "county")
    spark.createDataFrame([("6037", "LA")], "GEOID string, NAME string").write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="statefp"):
        readers.read_county_dimension(spark, path)
    assert isinstance(readers.S.COUNTY_DIMENSION, T.StructType) and os.path.isdir(path.removeprefix("file:"))
