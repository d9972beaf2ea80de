"""Text input is bound by header name, whatever its column order."""

import pytest

from fairlend.functions import schema as S
from fairlend.operators import gaps
from fairlend.plans import jobs
from fairlend.plans.session import shared_dir
from fairlend.sources import readers
from fairlend.streaming import yearly

COMBINED = ["activity_year", "state_code", "county_code", "approved", "applicant_race_1", "loan_type", "loan_amount",
            "income", "interest_rate"]


def written(spark, names, rows, sep=","):
    path = shared_dir(spark, "bind")
    spark.createDataFrame([tuple(map(str, r)) for r in rows], ", ".join(f"{n} string" for n in names)) \
        .coalesce(1).write.option("header", True).option("sep", sep).csv(path)
    return path


def combined_rows(whole):
    one = "1.0" if whole else "1"
    return [(2022 + i % 2, "CA", "6037.0", one if i % 3 else "0", (5, 3)[i % 2], "2.0" if whole else 2, 255000 + i, 80.5, 3.25)
            for i in range(600)]


@pytest.mark.parametrize("order", [list(range(9)), [8, 3, 0, 5, 1, 7, 2, 6, 4]])
@pytest.mark.parametrize("whole", [False, True])
def test_combined_header_in_any_order(spark, order, whole):
    rows = combined_rows(whole)
    path = written(spark, [COMBINED[i] for i in order], [[r[i] for i in order] for r in rows])
    df = readers.read_csv_typed(spark, path)
    r = df.where("loan_amount = 255001.0").first()
    assert (r.activity_year, r.state_code, r.county_code, r.approved, r.applicant_race_1, r.loan_type, r.income,
            r.interest_rate, r.action_taken) == (2023, "CA", 6037.0, 1, 3, 2, 80.5, 3.25, None)
    g = gaps.county_gaps(df, min_n=50).first()
    assert (g.state_code, g.county_code, g.total_applications) == ("CA", 6037.0, 600)
    assert g.advantaged_approval_rate == pytest.approx(2 / 3) == g.disadvantaged_approval_rate


def test_fractions_and_junk_are_no_integers(spark):
    path = written(spark, COMBINED, [(2022, "CA", "x", "1.5", "5", "NA", 1, 1, "Exempt")])
    r = readers.read_csv_typed(spark, path).first()
    assert (r.county_code, r.approved, r.applicant_race_1, r.loan_type, r.interest_rate) == (None, None, 5, None, None)


def test_a_missing_required_column_raises(spark):
    path = written(spark, ["state_code", "approved"], [("CA", 1)])
    with pytest.raises(ValueError, match="county_code, applicant_race_1"):
        readers.read_csv_typed(spark, path)
    with pytest.raises(ValueError, match="action_taken"):
        readers.read_yearly_files(spark, [path], S.RAW_APPLICATION, required=S.REQUIRED_RAW)


RAW = ["property_value", "income", "state_code", "applicant_race_1", "county_code", "loan_type", "action_taken",
       "activity_year", "loan_amount", "applicant_ethnicity_1", "interest_rate"]


def raw_rows():
    return [("300000", "80", "CA", "5.0" if i % 2 else "3.0", "6037.0", "1", "3.0" if i % 3 == 0 else "1.0", "2022", "255000",
             "2", "NA") for i in range(600)]


def test_prepare_to_csv_to_gaps_equals_the_parquet_route(spark):
    out = shared_dir(spark, "bind-prep")
    jobs.prepare(spark, [written(spark, RAW, raw_rows(), "|")], out, sep="|")
    tables = [gaps.county_gaps(jobs.load_applications(spark, f"{out}/{p}", f)).collect()
              for p, f in (("cleaned_by_year", "csv"), ("combined", "parquet"))]
    assert tables[0] == tables[1]
    (row,) = tables[0]
    assert (row.state_code, row.county_code, row.total_applications) == ("CA", 6037.0, 600)


def test_stream_on_the_raw_header(spark):
    out = shared_dir(spark, "bind-out")
    folder = written(spark, RAW, raw_rows())
    yearly.start_county_gaps(spark, folder, out, shared_dir(spark, "bind-ck")).awaitTermination()
    (row,) = yearly.read_county_gaps(spark, out).collect()
    assert (row.state_code, row.county_code, row.total_applications) == ("CA", 6037.0, 600)
    assert row.advantaged_approval_rate == pytest.approx(2 / 3)


def test_quoted_line_breaks_and_quotes(spark):
    from fairlend.sources import sinks
    path = shared_dir(spark, "bind-text")
    rows = [(1, 'a "quoted" b'), (2, "two\nlines"), (3, "x,y"), (4, None)]
    sinks.write_csv(spark.createDataFrame(rows, "id int, t string"), path)
    back = readers.read_delimited(spark, path, ",", multi_line=True).collect()
    assert sorted((int(r.id), r.t) for r in back) == rows
