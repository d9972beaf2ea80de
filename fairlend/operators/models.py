"""Adjusted models (O50–O58, O61) on MLlib.

Scale notes
-----------
* One multi-column ``StringIndexer`` counts the levels of all categorical
  columns in a single aggregation pass (instead of one job per column), and
  one ``OneHotEncoder`` encodes them; the assembled vector stays sparse
  (hundreds of slots, 3 dense + one non-zero per categorical column).
* The prepared rows are persisted (MEMORY_AND_DISK) around the fit, so the
  indexer pass and each optimizer iteration re-read the cache, not the
  source; lost blocks are recomputed from lineage.
* Logistic regression runs L-BFGS with one ``treeAggregate`` per iteration;
  linear regression with the ``auto`` solver takes the normal-equation path
  (one Gram-matrix pass) at this width.  Only the coefficient vector and the
  slot metadata (bounded by model width) reach the driver.
* Scoring is a lazy ``transform``; predictions are written by the
  executors, never collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlend.functions import codes, schema


def feature_stages(categorical: Sequence[str] = codes.CATEGORICAL_FEATURES,
                   numeric: Sequence[str] = codes.NUMERIC_FEATURES,
                   features_col: str = "features") -> list:
    """Index (most frequent = 0, unseen kept), one-hot, assemble."""
    cats = list(categorical)
    idx = StringIndexer(inputCols=cats, outputCols=[c + "_idx" for c in cats],
                        handleInvalid="keep", stringOrderType="frequencyDesc")
    # dropLast drops only the extra "unseen" bucket: every real level keeps a slot
    ohe = OneHotEncoder(inputCols=[c + "_idx" for c in cats],
                        outputCols=[c + "_vec" for c in cats], dropLast=True)
    asm = VectorAssembler(inputCols=list(numeric) + [c + "_vec" for c in cats],
                          outputCol=features_col)
    return [idx, ohe, asm]


def slot_names(scored: DataFrame, features_col: str = "features") -> list[str]:
    """Vector slot → name from the ML attribute metadata, ordered by index.

    Slots without a name get ``unknown_<i>``.
    """
    meta = scored.schema[features_col].metadata.get("ml_attr", {})
    width = int(meta.get("num_attrs", 0))
    named: dict[int, str] = {}
    for group in meta.get("attrs", {}).values():
        for attr in group:
            named[int(attr["idx"])] = attr.get("name")
    width = max([width] + [i + 1 for i in named])
    return [named.get(i) or f"unknown_{i}" for i in range(width)]


@dataclass
class FittedModel:
    pipeline: PipelineModel
    scored: DataFrame
    coefficients: DataFrame
    names: list[str]

    @property
    def model(self):
        return self.pipeline.stages[-1]


def _coefficient_table(spark, names, coefs, intercept, with_odds: bool) -> DataFrame:
    rows = [(i, n, float(c)) for i, (n, c) in enumerate(zip(names, coefs))]
    if intercept is not None:
        rows.append((len(rows), "Intercept", float(intercept)))
    df = spark.createDataFrame(rows, schema.LINEAR_COEFFICIENTS)
    return df.withColumn("odds_ratio", F.exp("coefficient")) if with_odds else df


def fit_pipeline(prepared: DataFrame, estimator, categorical=codes.CATEGORICAL_FEATURES,
                 numeric=codes.NUMERIC_FEATURES) -> tuple[PipelineModel, DataFrame, list[str]]:
    """Fit index → one-hot → assemble → estimator; score lazily."""
    pipe = Pipeline(stages=feature_stages(categorical, numeric) + [estimator])
    model = pipe.fit(prepared)
    scored = model.transform(prepared)
    return model, scored, slot_names(scored)


def fit_approval_model(prepared: DataFrame, label: str = "approved",
                       categorical=codes.CATEGORICAL_FEATURES, numeric=codes.NUMERIC_FEATURES,
                       **params) -> FittedModel:
    """L2 logistic regression of approval (maxIter 20, regParam 0.01).

    Coefficient table: slot, feature, coefficient, odds_ratio = exp(coefficient),
    with the intercept as the last row.
    """
    p = dict(codes.LOGIT_PARAMS)
    p.update(params)
    est = LogisticRegression(featuresCol="features", labelCol=label, **p)
    model, scored, names = fit_pipeline(prepared, est, categorical, numeric)
    lr = model.stages[-1]
    coefs = _coefficient_table(prepared.sparkSession, names, lr.coefficients.toArray(),
                               lr.intercept, with_odds=True)
    return FittedModel(model, scored, coefs, names)


def fit_rate_model(prepared: DataFrame, label: str = "interest_rate",
                   categorical=codes.CATEGORICAL_FEATURES, numeric=codes.NUMERIC_FEATURES,
                   **params) -> FittedModel:
    """L2 linear regression of the rate (maxIter 20, regParam 0.01).

    Coefficient table: slot, feature, coefficient (no intercept row).
    """
    p = dict(codes.LINEAR_PARAMS)
    p.update(params)
    est = LinearRegression(featuresCol="features", labelCol=label, **p)
    model, scored, names = fit_pipeline(prepared, est, categorical, numeric)
    lr = model.stages[-1]
    # as in the study, the rate table lists the slots only; the intercept is
    # reported with the fit metrics (metrics.model_summary_row)
    coefs = _coefficient_table(prepared.sparkSession, names, lr.coefficients.toArray(),
                               None, with_odds=False)
    return FittedModel(model, scored, coefs, names)


def fit_columns(label: str, categorical=codes.CATEGORICAL_FEATURES, numeric=codes.NUMERIC_FEATURES) -> list[str]:
    """The columns a fit reads: all that needs to be kept in memory around it."""
    return [label, *numeric, *categorical]


def approval_predictions(fitted: FittedModel) -> DataFrame:
    """Scored rows with the class-1 probability as a plain double."""
    return fitted.scored.select(
        "income", "loan_amount", "loan_to_income", "race_group", "loan_type", "county_code",
        "approved", "prediction",
        vector_to_array("probability")[1].alias("probability"))


def rate_predictions(fitted: FittedModel) -> DataFrame:
    """Scored rows of the rate model."""
    return fitted.scored.select("interest_rate", "prediction", "race_group", "income",
                                "loan_amount", "county_code")


@dataclass
class SavedModel:
    """A fitted pipeline read back from its folder, with its slot names and the label it was fitted to."""
    pipeline: PipelineModel
    names: list[str]
    label: str

    @property
    def inputs(self) -> list[str]:
        """The columns that scoring reads."""
        index, assembler = self.pipeline.stages[0], self.pipeline.stages[-2]
        encoded = set(self.pipeline.stages[1].getOutputCols())
        return [*(c for c in assembler.getInputCols() if c not in encoded), *index.getInputCols()]


def save_model(fitted: FittedModel, path: str) -> None:
    """The pipeline with its encodings, and a table of slots beside it (model width)."""
    fitted.pipeline.write().overwrite().save(f"{path}/pipeline")
    spark = fitted.scored.sparkSession
    rows = [(i, name, fitted.model.getLabelCol()) for i, name in enumerate(fitted.names)]
    (spark.createDataFrame(rows, "slot int, feature string, label string").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/slots"))


def load_model(spark: SparkSession, path: str) -> SavedModel:
    """What :func:`save_model` wrote; raises if the pipeline's width is not that of the slot table."""
    pipeline = PipelineModel.load(f"{path}/pipeline")
    slots = sorted(spark.read.parquet(f"{path}/slots").collect())
    if len(slots) != len(pipeline.stages[-1].coefficients):
        raise ValueError(f"{path} names {len(slots)} slots of a model with {len(pipeline.stages[-1].coefficients)}")
    return SavedModel(pipeline, [s.feature for s in slots], slots[0].label)


def score_rows(saved: SavedModel, rows: DataFrame, out: str = "prediction") -> DataFrame:
    """``rows``, a table or a stream, with the model's prediction (and ``probability`` of class 1).

    A category that the fit never saw is in the extra bucket, whose slots are
    all 0: the row is scored by its other columns.  The label is not needed;
    other columns of ``rows`` stay.  Columns that the pipeline adds on its way
    must not be in ``rows`` (raises).
    """
    model = saved.pipeline.stages[-1]
    added = [c for s in saved.pipeline.stages for p in ("outputCols", "outputCol", "predictionCol", "probabilityCol",
                                                        "rawPredictionCol") if s.hasParam(p) and s.isDefined(p)
             for c in ([s.getOrDefault(p)] if isinstance(s.getOrDefault(p), str) else s.getOrDefault(p))]
    clash = sorted(set(added) & set(rows.columns))
    if clash:
        raise ValueError(f"the rows have columns that scoring adds: {', '.join(clash)}")
    scored = saved.pipeline.transform(rows)
    extra = ([vector_to_array(model.getProbabilityCol())[1].alias("probability")]
             if model.hasParam("probabilityCol") else [])
    return scored.select(*rows.columns, F.col(model.getPredictionCol()).alias(out), *extra)


def category_index(prepared: DataFrame, categorical=codes.CATEGORICAL_FEATURES) -> DataFrame:
    """(column_name, label, idx) as assigned by the fitted indexer.

    The fitted indexer holds its labels in order on the driver (model width);
    the rows are read once, for the fit.
    """
    cats = list(categorical)
    labels = feature_stages(cats)[0].fit(prepared).labelsArray
    rows = [(c, label, i) for c, own in zip(cats, labels) for i, label in enumerate(own)]
    return prepared.sparkSession.createDataFrame(rows, "column_name string, label string, idx int")


def one_hot_slot_counts(prepared: DataFrame, categorical=codes.CATEGORICAL_FEATURES,
                        numeric=codes.NUMERIC_FEATURES) -> DataFrame:
    """Rows where each one-hot slot is 1, with the slot's name.

    The vector sum is MLlib's ``Summarizer`` (a tree aggregation); only the
    summed vector (model width) is exploded into rows.
    """
    from pyspark.ml.stat import Summarizer

    stages = feature_stages(categorical, numeric)
    model = Pipeline(stages=stages).fit(prepared)
    scored = model.transform(prepared)
    names = slot_names(scored)
    total = scored.select(Summarizer.sum(F.col("features")).alias("s"))
    exploded = total.select(F.posexplode(vector_to_array("s")).alias("slot", "rows"))
    first_cat = len(list(numeric))
    name_col = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("slot") + 1)
    return (exploded.where(F.col("slot") >= first_cat)
            .select(F.col("slot").cast("int").alias("slot"), name_col.alias("feature"),
                    F.col("rows").cast("long").alias("rows")))


def feature_names(prepared: DataFrame, categorical=codes.CATEGORICAL_FEATURES,
                  numeric=codes.NUMERIC_FEATURES) -> DataFrame:
    """(slot, feature) for the assembled vector."""
    model = Pipeline(stages=feature_stages(categorical, numeric)).fit(prepared)
    names = slot_names(model.transform(prepared))
    return prepared.sparkSession.createDataFrame(
        list(enumerate(names)), "slot int, feature string")


def group_rate_logit(prepared: DataFrame, group: str = "race_group",
                     label: str = "approved") -> DataFrame:
    """Saturated logistic model of ``label`` on one categorical ``group``.

    No penalty, tight tolerance: the fitted probability of each group equals
    its observed rate, which makes the logistic fit checkable by SQL.
    Output: (group, fitted_rate) from the scored rows.
    """
    est = LogisticRegression(featuresCol="features", labelCol=label, regParam=0.0,
                             maxIter=100, tol=1e-12)
    model, scored, _ = fit_pipeline(prepared, est, [group], [])
    return (scored.groupBy(group)
            .agg(F.avg(vector_to_array("probability")[1]).alias("fitted_rate")))


def ridge_one_feature(prepared: DataFrame, x: str, y: str, reg: float = 0.01) -> DataFrame:
    """MLlib L2 linear fit of ``y`` on one numeric ``x``: one row (intercept, slope)."""
    asm = VectorAssembler(inputCols=[x], outputCol="features")
    est = LinearRegression(featuresCol="features", labelCol=y, regParam=reg, maxIter=20)
    lr = Pipeline(stages=[asm, est]).fit(prepared).stages[-1]
    return prepared.sparkSession.createDataFrame(
        [(float(lr.intercept), float(lr.coefficients[0]))], "intercept double, slope double")
