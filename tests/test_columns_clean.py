from pyspark.sql import functions as F

from fairlend.functions.columns import fips5, fips_label, guarded_ratio, key_hash_unit, to_double
from fairlend.operators import clean


def test_coercion_cases(spark):
    vals = ["12", " 7 ", "1,000", "Exempt", "NaN", "", None, "-3.5"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(to_double("s")).collect()]
    assert got == [12.0, 7.0, None, None, None, None, None, -3.5]


def test_sign_filters_keep_null_and_zero(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (None,)], "income double")
    got = sorted([r[0] for r in clean.keep_nonneg_or_null(df, ["income"]).collect()],
                 key=lambda x: (x is not None, x))
    assert got == [None, 0.0, 1.0]


def test_null_keys_dropped_before_coercion(spark):
    # 'Exempt' is present (kept by the key rule), becomes null, then 0.0 by the fill
    rows = [(6037.0, 5, "Exempt", "100", None, "CA", 1, 2023),
            (6037.0, 5, None, "100", None, "CA", 1, 2023),
            (None, 5, "50", "100", None, "CA", 1, 2023)]
    df = spark.createDataFrame(rows, "county_code double, applicant_race_1 int, income string, "
                                     "loan_amount string, interest_rate string, state_code string, "
                                     "action_taken int, activity_year int")
    out = clean.clean_applications(df)
    assert out.count() == 1
    assert out.first()["income"] is None
    filled = clean.fill_defaults(out.withColumn("loan_type", F.lit(None).cast("int")))
    r = filled.first()
    assert r["income"] == 0.0 and r["loan_type"] == -1


def test_union_by_name_missing_column(spark):
    a = spark.createDataFrame([(2022, 1.0)], "activity_year int, loan_amount double")
    b = spark.createDataFrame([(2023, 2.0, 300.0)], "activity_year int, loan_amount double, property_value double")
    u = clean.union_years([a, b]).orderBy("activity_year").collect()
    assert u[0]["property_value"] is None and u[1]["property_value"] == 300.0


def test_derive_approved_and_states(spark):
    df = spark.createDataFrame([(1, "CA"), (2, "TX"), (3, "TX"), (4, "CA"), (1, "NV")],
                               "action_taken int, state_code string")
    out = clean.derive_approved(clean.restrict_states(df)).orderBy("action_taken").collect()
    assert [(r.action_taken, r.approved) for r in out] == [(1, 1), (2, 1), (3, 0)]


def test_drop_if_present(spark):
    df = spark.createDataFrame([(1, 2)], "a int, applicant_ethnicity_1 int")
    assert clean.drop_if_present(df).columns == ["a"]
    assert clean.drop_if_present(spark.createDataFrame([(1,)], "a int")).columns == ["a"]


def test_guarded_ratio_variants(spark):
    df = spark.createDataFrame([(0.0, 10.0), (None, 10.0), (5.0, 10.0), (5.0, 0.0), (5.0, None)],
                               "income double, loan double")
    z = [r[0] for r in df.select(guarded_ratio("loan", "income", 0.0)).collect()]
    n = [r[0] for r in df.select(guarded_ratio("loan", "income", None)).collect()]
    assert z == [0.0, 0.0, 2.0, 0.0, 0.0]
    assert n == [None, None, 2.0, None, None]


def test_fips(spark):
    df = spark.createDataFrame([(6037.0,), (48477.0,)], "c double")
    got = df.select(fips5("c"), fips_label("c")).collect()
    assert [tuple(r) for r in got] == [("06037", "6037"), ("48477", "48477")]


def test_key_hash_sample_is_partitioning_independent(spark):
    df = spark.range(0, 20000).withColumn("k2", F.col("id") % 7)
    a = clean.sample_by_key(df, 0.1, ["id", "k2"])
    b = clean.sample_by_key(df.repartition(13), 0.1, ["id", "k2"])
    ida = sorted(r[0] for r in a.select("id").collect())
    idb = sorted(r[0] for r in b.select("id").collect())
    assert ida == idb and 1500 < len(ida) < 2500
    u = df.select(key_hash_unit(["id"]).alias("u")).agg(F.min("u"), F.max("u")).first()
    assert 0.0 <= u[0] and u[1] < 1.0


def test_audit_is_monotone(spark):
    from fairlend.plans import fixture as fx
    from tests.conftest import SF001
    audit = clean.audit_cleaning(fx.raw_applications(spark, SF001)).orderBy("step_no").collect()
    rows = [r.rows for r in audit]
    assert rows == sorted(rows, reverse=True)
    assert rows[-1] == fx.applications(spark, SF001).count()


def test_coercion_property(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    numerals = st.one_of(
        st.integers(min_value=-10**9, max_value=10**9).map(str),
        st.floats(allow_nan=False, allow_infinity=False, width=64).map(repr),
        st.sampled_from(["Exempt", "NA", "", "1,000", "1.2.3", "abc"]))

    @settings(max_examples=5, deadline=None)
    @given(st.lists(numerals, min_size=1, max_size=40))
    def check(values):
        df = spark.createDataFrame([(v,) for v in values], "s string")
        got = [r[0] for r in df.select(to_double("s")).collect()]
        for v, g in zip(values, got):
            try:
                want = float(v)
            except ValueError:
                want = None
            assert g == want, (v, g, want)

    check()


def test_inside_open(spark):
    from fairlend.functions.columns import inside_open
    xs = [None, float("nan"), -1.0, 0.0, -0.0, 5e-324, 1e-17, 12.5, 24.999999999999996, 25.0, 26.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(inside_open("x", 0.0, 25.0)).collect()]
    assert got == [x is not None and 0.0 < x < 25.0 for x in xs]


def test_the_rate_filter_reads_the_rate_once(spark):
    """Over text, each mention parses it: one in the range, one in the cleaning rule for negative rates."""
    text = clean.coerce_numeric(spark.createDataFrame([(1, "3.5", 6037.0, 1, 1.0, 2.0)], "approved int, interest_rate string, "
                                "county_code double, loan_type int, income double, loan_amount double"), ["interest_rate"])
    plan = clean.prep_rate(text)._jdf.queryExecution().optimizedPlan().toString()
    condition = next(line for line in plan.splitlines() if "Filter" in line)
    assert condition.count("interest_rate") == 1
