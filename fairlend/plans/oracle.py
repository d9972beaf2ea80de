"""Oracle SQL (DuckDB dialect) for the registered queries.

Each statement inlines the application views over the driver's tables as
CTEs, then states the operator's semantics in plain SQL, independently of
the Spark code.  Integer aggregates are cast to BIGINT and doubles that are
sums of doubles are rounded on both sides, so value hashes compare.
"""

from __future__ import annotations

from fairlend.functions import schema as S

RAW = """raw_applications AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CAST(year(o_orderdate) AS INT) AS activity_year,
         CASE WHEN n_regionkey < 2 THEN 'CA' WHEN n_regionkey < 4 THEN 'TX' ELSE 'NV' END AS state_code,
         CASE WHEN o_orderkey % 53 = 0 THEN NULL
              ELSE CAST(48000 + n_nationkey * 7 + c_custkey % 7 AS DOUBLE) END AS county_code,
         CAST(CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_quantity > 48 THEN 4 ELSE 1 END AS INT) AS action_taken,
         CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 5 AS INT) END AS applicant_ethnicity_1,
         CASE WHEN l_suppkey % 23 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN 'Exempt'
              ELSE CAST(l_extendedprice * 2 AS VARCHAR) END AS property_value,
         CASE CAST(c_custkey % 12 AS INT)
              WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 21 WHEN 3 THEN 27 WHEN 4 THEN 3 WHEN 5 THEN 3
              WHEN 6 THEN 4 WHEN 7 THEN 5 WHEN 8 THEN 5 WHEN 9 THEN 5 WHEN 10 THEN 6 ELSE NULL END AS applicant_race_1,
         CASE WHEN l_suppkey % 50 = 0 THEN NULL ELSE CAST((l_linenumber - 1) % 4 + 1 AS INT) END AS loan_type,
         CAST(CASE WHEN l_partkey % 97 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS VARCHAR) AS loan_amount,
         CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 41 = 0 THEN 'Exempt'
              WHEN o_orderkey % 43 = 0 THEN '0' ELSE CAST(c_acctbal / 10 AS VARCHAR) END AS income,
         CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_suppkey % 31 = 0 THEN 'NA'
              ELSE CAST(l_discount * 300 AS VARCHAR) END AS interest_rate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                JOIN customer ON o_custkey = c_custkey
                JOIN nation ON c_nationkey = n_nationkey)"""

APPS = """applications AS (
  SELECT * FROM (
    SELECT l_orderkey, l_linenumber, activity_year, state_code, county_code, action_taken,
           CAST(CASE WHEN action_taken IN (1, 2) THEN 1 WHEN action_taken = 3 THEN 0 END AS INT) AS approved,
           applicant_race_1, loan_type,
           TRY_CAST(loan_amount AS DOUBLE) AS loan_amount,
           TRY_CAST(property_value AS DOUBLE) AS property_value,
           TRY_CAST(income AS DOUBLE) AS income,
           TRY_CAST(interest_rate AS DOUBLE) AS interest_rate
    FROM raw_applications
    WHERE county_code IS NOT NULL AND applicant_race_1 IS NOT NULL AND income IS NOT NULL
      AND state_code IN ('CA', 'TX') AND action_taken IN (1, 2, 3)) t
  WHERE (income >= 0 OR income IS NULL)
    AND (interest_rate >= 0 OR interest_rate IS NULL)
    AND (loan_amount >= 0 OR loan_amount IS NULL))"""

COUNTIES = """counties AS (
  SELECT lpad(CAST(48000 + n_nationkey * 7 + k AS VARCHAR), 5, '0') AS county_fips,
         CASE WHEN n_regionkey < 2 THEN '06' WHEN n_regionkey < 4 THEN '48' ELSE '32' END AS statefp,
         concat(n_name, '_', CAST(k AS VARCHAR)) AS name
  FROM nation CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) v(k))"""

RACE5 = """CASE WHEN applicant_race_1 = 1 THEN 'Native American'
            WHEN applicant_race_1 = 3 THEN 'Black'
            WHEN applicant_race_1 = 5 THEN 'White'
            WHEN applicant_race_1 IN (2, 21, 22, 23, 24, 25, 26, 27) THEN 'Asian'
            ELSE 'Other' END"""

RACE7 = """CASE WHEN applicant_race_1 = 1 THEN 'American Indian / Alaska Native'
            WHEN applicant_race_1 IN (2, 21, 22, 23, 24, 25, 26, 27) THEN 'Asian'
            WHEN applicant_race_1 = 3 THEN 'Black'
            WHEN applicant_race_1 IN (4, 41, 42, 43, 44) THEN 'Native Hawaiian / Pacific Islander'
            WHEN applicant_race_1 = 5 THEN 'White'
            WHEN applicant_race_1 IN (6, 7) THEN 'Not Provided'
            ELSE 'Unknown / Other' END"""

# Gap-study rows: decided, county present, comparison group assigned.
GAP_ROWS = f"""gap_rows AS (
  SELECT *, CASE WHEN race_group IN ('White', 'Asian') THEN 'Advantaged'
                 WHEN race_group IN ('Black', 'Native American') THEN 'Disadvantaged' END AS comparison_group
  FROM (SELECT *, {RACE5} AS race_group FROM applications
        WHERE approved IN (0, 1) AND county_code IS NOT NULL) r
  WHERE race_group IN ('White', 'Asian', 'Black', 'Native American'))"""

COUNTY_STATS = """county_stats AS (
  SELECT state_code, county_code,
         CAST(count(*) AS BIGINT) AS total_applications,
         CAST(sum(CASE WHEN comparison_group = 'Advantaged' THEN 1 ELSE 0 END) AS BIGINT) AS advantaged_n,
         CAST(sum(CASE WHEN comparison_group = 'Disadvantaged' THEN 1 ELSE 0 END) AS BIGINT) AS disadvantaged_n,
         avg(CASE WHEN comparison_group = 'Advantaged' THEN approved END) AS advantaged_approval_rate,
         avg(CASE WHEN comparison_group = 'Disadvantaged' THEN approved END) AS disadvantaged_approval_rate
  FROM gap_rows GROUP BY state_code, county_code)"""

COUNTY_GAPS = """county_gaps AS (
  SELECT *, advantaged_approval_rate - disadvantaged_approval_rate AS approval_disparity_gap
  FROM county_stats WHERE advantaged_n >= 50 AND disadvantaged_n >= 50)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = with_ctes(RAW, APPS)
GAP_BASE = with_ctes(RAW, APPS, GAP_ROWS, COUNTY_STATS, COUNTY_GAPS)

ORACLE: dict[str, str] = {}

ORACLE["county_gap_top25"] = GAP_BASE + """
SELECT state_code, county_code, total_applications, advantaged_n, disadvantaged_n,
       advantaged_approval_rate, disadvantaged_approval_rate, approval_disparity_gap
FROM county_gaps
ORDER BY approval_disparity_gap DESC NULLS LAST, state_code, county_code
LIMIT 25"""

GAP_STATS_BASE = with_ctes(RAW, APPS, GAP_ROWS, COUNTY_STATS)

ORACLE["county_stats"] = GAP_STATS_BASE + "SELECT * FROM county_stats"

ORACLE["county_min_sample"] = GAP_STATS_BASE + """
SELECT * FROM county_stats WHERE advantaged_n >= 50 AND disadvantaged_n >= 50"""

ORACLE["county_gap"] = GAP_STATS_BASE + """
SELECT *, advantaged_approval_rate - disadvantaged_approval_rate AS approval_disparity_gap
FROM county_stats"""

ORACLE["county_fips"] = GAP_STATS_BASE + """
SELECT state_code, county_code,
       lpad(CAST(CAST(trunc(county_code) AS INTEGER) AS VARCHAR), 5, '0') AS county_fips,
       CAST(CAST(trunc(county_code) AS INTEGER) AS VARCHAR) AS county_label
FROM county_stats"""

MAPPED = """mapped AS (
  SELECT c.county_fips, c.statefp, c.name, g.state_code, g.total_applications, g.advantaged_n,
         g.disadvantaged_n, g.advantaged_approval_rate, g.disadvantaged_approval_rate,
         g.approval_disparity_gap, g.approval_disparity_gap IS NOT NULL AS has_gap
  FROM counties c LEFT JOIN (
    SELECT *, lpad(CAST(CAST(trunc(county_code) AS INTEGER) AS VARCHAR), 5, '0') AS county_fips
    FROM county_gaps) g ON c.county_fips = g.county_fips)"""

MAP_BASE = with_ctes(RAW, APPS, GAP_ROWS, COUNTY_STATS, COUNTY_GAPS, COUNTIES, MAPPED)

ORACLE["county_left_join"] = MAP_BASE + "SELECT * FROM mapped"

ORACLE["gap_range"] = MAP_BASE + """
SELECT min(approval_disparity_gap) AS gap_min, max(approval_disparity_gap) AS gap_max
FROM mapped WHERE has_gap"""

ORACLE["state_gap_map"] = MAP_BASE + """
SELECT CASE WHEN statefp = '06' THEN 'CA' WHEN statefp = '48' THEN 'TX' END AS map_state,
       county_fips, name, approval_disparity_gap, has_gap AS estimated,
       (SELECT min(approval_disparity_gap) FROM mapped WHERE has_gap) AS gap_min,
       (SELECT max(approval_disparity_gap) FROM mapped WHERE has_gap) AS gap_max
FROM mapped WHERE statefp IN ('06', '48')"""

ORACLE["ranked_gap_table"] = MAP_BASE + """
SELECT CAST(row_number() OVER (ORDER BY approval_disparity_gap DESC, county_fips) AS INTEGER) AS rank,
       name AS county, state_code AS state, county_fips AS fips,
       round(approval_disparity_gap, 4) AS approval_gap
FROM mapped WHERE has_gap
ORDER BY approval_disparity_gap DESC, county_fips LIMIT 25"""

# --- cleaning ---------------------------------------------------------------

ORACLE["clean_applications"] = BASE + "SELECT * FROM applications"

ORACLE["yearly_rewrite"] = ORACLE["clean_applications"]

ORACLE["clean_audit"] = ORACLE["observed_audit"] = with_ctes(RAW) + """,
flags AS (
  SELECT county_code IS NOT NULL AND applicant_race_1 IS NOT NULL AND income IS NOT NULL AS k,
         state_code IN ('CA', 'TX') AS s, action_taken IN (1, 2, 3) AS a,
         coalesce(TRY_CAST(income AS DOUBLE) >= 0, TRUE) AS i,
         coalesce(TRY_CAST(interest_rate AS DOUBLE) >= 0, TRUE) AS r,
         coalesce(TRY_CAST(loan_amount AS DOUBLE) >= 0, TRUE) AS l
  FROM raw_applications)
SELECT * FROM (
  SELECT 0 AS step_no, 'raw' AS step, count(*) AS rows FROM flags
  UNION ALL SELECT 1, 'null_keys_dropped', count(*) FILTER (WHERE k) FROM flags
  UNION ALL SELECT 2, 'state_restricted', count(*) FILTER (WHERE k AND s) FROM flags
  UNION ALL SELECT 3, 'decision_restricted', count(*) FILTER (WHERE k AND s AND a) FROM flags
  UNION ALL SELECT 4, 'income_nonneg', count(*) FILTER (WHERE k AND s AND a AND i) FROM flags
  UNION ALL SELECT 5, 'interest_rate_nonneg', count(*) FILTER (WHERE k AND s AND a AND i AND r) FROM flags
  UNION ALL SELECT 6, 'loan_amount_nonneg', count(*) FILTER (WHERE k AND s AND a AND i AND r AND l) FROM flags)"""

ORACLE["drop_null_keys"] = with_ctes(RAW) + """
SELECT l_orderkey, l_linenumber, state_code, county_code, applicant_race_1, action_taken
FROM raw_applications
WHERE county_code IS NOT NULL AND applicant_race_1 IS NOT NULL AND income IS NOT NULL"""

ORACLE["coerce_numeric"] = with_ctes(RAW) + """
SELECT l_orderkey, l_linenumber, TRY_CAST(loan_amount AS DOUBLE) AS loan_amount,
       TRY_CAST(income AS DOUBLE) AS income, TRY_CAST(interest_rate AS DOUBLE) AS interest_rate,
       TRY_CAST(property_value AS DOUBLE) AS property_value
FROM raw_applications"""

ORACLE["nonneg_or_null"] = with_ctes(RAW) + """
SELECT * FROM (
  SELECT l_orderkey, l_linenumber, TRY_CAST(loan_amount AS DOUBLE) AS loan_amount,
         TRY_CAST(income AS DOUBLE) AS income, TRY_CAST(interest_rate AS DOUBLE) AS interest_rate
  FROM raw_applications) t
WHERE (income >= 0 OR income IS NULL) AND (interest_rate >= 0 OR interest_rate IS NULL)
  AND (loan_amount >= 0 OR loan_amount IS NULL)"""

ORACLE["union_years"] = with_ctes(RAW) + """
SELECT activity_year, count(*) AS n, count(interest_rate) AS n_rate FROM (
  SELECT activity_year, NULL AS interest_rate FROM raw_applications WHERE activity_year <= 1997
  UNION ALL
  SELECT activity_year, interest_rate FROM raw_applications WHERE activity_year > 1997) u
GROUP BY activity_year"""

ORACLE["derive_approved"] = with_ctes(RAW) + """
SELECT state_code, action_taken,
       CAST(CASE WHEN action_taken IN (1, 2) THEN 1 WHEN action_taken = 3 THEN 0 END AS INT) AS approved,
       count(*) AS n
FROM raw_applications
WHERE state_code IN ('CA', 'TX') AND action_taken IN (1, 2, 3)
GROUP BY ALL"""

ORACLE["fill_defaults"] = BASE + """
SELECT l_orderkey, l_linenumber, coalesce(income, 0.0::DOUBLE) AS income,
       coalesce(loan_amount, 0.0::DOUBLE) AS loan_amount, coalesce(loan_type, -1) AS loan_type
FROM applications"""

PREP_SELECT = f"""
SELECT l_orderkey, l_linenumber, activity_year, county_code, approved, income, loan_amount,
       loan_type, interest_rate,
       CASE WHEN income > 0 AND loan_amount > 0 THEN loan_amount / income ELSE 0.0::DOUBLE END AS loan_to_income,
       {RACE5} AS race_group
FROM (SELECT l_orderkey, l_linenumber, activity_year, county_code, approved, interest_rate,
             applicant_race_1, coalesce(income, 0.0::DOUBLE) AS income,
             coalesce(loan_amount, 0.0::DOUBLE) AS loan_amount, coalesce(loan_type, -1) AS loan_type
      FROM applications WHERE {{where}}) f"""

ORACLE["prep_approval"] = BASE + PREP_SELECT.format(
    where="approved IN (0, 1) AND activity_year IS NOT NULL AND county_code IS NOT NULL") + """
WHERE income >= 0 AND loan_amount >= 0"""

ORACLE["prep_rate"] = BASE + PREP_SELECT.format(
    where="approved = 1 AND interest_rate IS NOT NULL AND interest_rate > 0 AND interest_rate < 25 "
          "AND county_code IS NOT NULL")

ORACLE["sample_by_key"] = BASE + """
SELECT * FROM applications
WHERE CAST(CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 8)
                AS BIGINT) AS DOUBLE) / 4294967296.0 < 0.1"""

# --- features -----------------------------------------------------------------

ORACLE["loan_to_income"] = BASE + """
SELECT l_orderkey, l_linenumber, income, loan_amount,
       CASE WHEN income > 0 AND loan_amount > 0 THEN loan_amount / income ELSE 0.0::DOUBLE END AS lti_zero,
       CASE WHEN income > 0 AND loan_amount > 0 THEN loan_amount / income END AS lti_null
FROM applications"""

ORACLE["race_group_5"] = BASE + f"""
SELECT applicant_race_1, {RACE5} AS race_group, count(*) AS n FROM applications GROUP BY ALL"""

ORACLE["race_group_7"] = BASE + f"""
SELECT applicant_race_1, {RACE7} AS race_group, count(*) AS n FROM applications GROUP BY ALL"""

ORACLE["comparison_group"] = with_ctes(RAW, APPS) + f""",
g AS (SELECT {RACE5} AS race_group FROM applications)
SELECT race_group,
       CASE WHEN race_group IN ('White', 'Asian') THEN 'Advantaged' ELSE 'Disadvantaged' END AS comparison_group,
       count(*) AS n
FROM g WHERE race_group IN ('White', 'Asian', 'Black', 'Native American') GROUP BY ALL"""

# --- profiling ------------------------------------------------------------------

_RAW_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "activity_year", "state_code",
             "county_code", "action_taken", "applicant_ethnicity_1", "applicant_race_1", "loan_type",
             "loan_amount", "property_value", "income", "interest_rate"]

ORACLE["null_counts"] = with_ctes(RAW) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM raw_applications"
    for c in _RAW_COLS)

ORACLE["row_col_counts"] = BASE + """
SELECT count(*) AS rows, 15 AS cols, 'raw' AS stage FROM raw_applications
UNION ALL SELECT count(*), 13, 'clean' FROM applications"""

ORACLE["distinct_values"] = with_ctes(RAW) + "SELECT DISTINCT action_taken FROM raw_applications"

ORACLE["value_counts"] = with_ctes(RAW) + """
SELECT applicant_race_1, count(*) AS n FROM raw_applications
WHERE applicant_race_1 IS NOT NULL GROUP BY applicant_race_1 ORDER BY n DESC, applicant_race_1"""

ORACLE["value_counts_ethnicity"] = with_ctes(RAW) + """
SELECT applicant_ethnicity_1, count(*) AS n FROM raw_applications
WHERE applicant_ethnicity_1 IS NOT NULL GROUP BY applicant_ethnicity_1 ORDER BY n DESC, applicant_ethnicity_1"""

ORACLE["drop_if_present"] = with_ctes(RAW) + "SELECT * EXCLUDE (applicant_ethnicity_1) FROM raw_applications"


def _describe_sql(measures: list[str], source: str, std_label: str, with_measure: bool) -> str:
    parts = []
    for m in measures:
        lead = f"'{m}' AS measure, " if with_measure else ""
        stats = [("count", f"CAST(count({m}) AS DOUBLE)"), ("mean", f"avg({m})"),
                 (std_label, f"stddev_samp({m})"), ("min", f"min({m})"),
                 ("25%", f"quantile_cont({m}, 0.25)"), ("50%", f"quantile_cont({m}, 0.5)"),
                 ("75%", f"quantile_cont({m}, 0.75)"), ("max", f"max({m})")]
        for label, expr in stats:
            parts.append(f"SELECT {lead}'{label}' AS statistic, round({expr}, 6) AS value FROM {source}")
    return "\nUNION ALL\n".join(parts)


ORACLE["describe_column"] = BASE + _describe_sql(["interest_rate"], "applications", "std", False)

# --- descriptive tables -------------------------------------------------------------

ORACLE["approval_by_race"] = BASE + f"""
SELECT {RACE7} AS race_group, avg(approved) AS approval_rate, count(*) AS applications
FROM applications GROUP BY ALL ORDER BY approval_rate DESC, race_group"""

ORACLE["approval_over_time"] = BASE + """
SELECT activity_year, avg(approved) AS approval_rate FROM applications
GROUP BY activity_year ORDER BY activity_year"""

ORACLE["loan_type_approval"] = BASE + """
SELECT loan_type, avg(approved) AS approval_rate, count(*) AS applications,
       CASE loan_type WHEN 1 THEN 'Conventional' WHEN 2 THEN 'FHA' WHEN 3 THEN 'VA'
                      WHEN 4 THEN 'RHS/FSA' END AS loan_label
FROM applications GROUP BY loan_type ORDER BY loan_type NULLS LAST"""

ORACLE["interest_by_race"] = BASE + f"""
SELECT race_group, round(avg(interest_rate), 6) AS avg_interest_rate, count(*) AS loans
FROM (SELECT {RACE7} AS race_group, interest_rate FROM applications WHERE interest_rate IS NOT NULL) t
WHERE race_group <> 'Unknown / Other'
GROUP BY race_group ORDER BY avg_interest_rate DESC, race_group"""

ORACLE["summary_statistics"] = BASE.rstrip("\n") + """,
m AS (SELECT loan_amount, income, interest_rate,
             CASE WHEN income > 0 AND loan_amount > 0 THEN loan_amount / income END AS loan_to_income
      FROM applications)
""" + _describe_sql(["loan_amount", "income", "interest_rate", "loan_to_income"], "m", "stddev", True)


ORACLE["summary_statistics_wide"] = ORACLE["summary_statistics"].replace(
    _describe_sql(["loan_amount", "income", "interest_rate", "loan_to_income"], "m", "stddev", True),
    "SELECT statistic AS summary, "
    + ", ".join(f"max(value) FILTER (WHERE measure = '{m}') AS {m}"
                for m in ["loan_amount", "income", "interest_rate", "loan_to_income"])
    + " FROM (" + _describe_sql(["loan_amount", "income", "interest_rate", "loan_to_income"],
                                "m", "stddev", True) + ") s GROUP BY statistic")


def _hist_sql(col: str, width: float) -> str:
    return BASE + f"""
SELECT CAST(floor({col} / {width}) AS BIGINT) AS bin,
       CAST(floor({col} / {width}) AS BIGINT) * CAST({width} AS DOUBLE) AS bin_start,
       (CAST(floor({col} / {width}) AS BIGINT) + 1) * CAST({width} AS DOUBLE) AS bin_end,
       count(*) AS n
FROM applications WHERE {col} IS NOT NULL AND NOT isnan({col})
GROUP BY 1 ORDER BY 1"""


ORACLE["income_histogram"] = _hist_sql("income", 50.0)
ORACLE["loan_amount_histogram"] = _hist_sql("loan_amount", 10000.0)

# --- models -------------------------------------------------------------------------

APPROVAL_ROWS = f"""approval_rows AS (
  SELECT *, {RACE5} AS race_group,
         CASE WHEN income > 0 AND loan_amount > 0 THEN loan_amount / income ELSE 0.0::DOUBLE END AS loan_to_income
  FROM (SELECT activity_year, county_code, approved, applicant_race_1, interest_rate,
               coalesce(income, 0.0::DOUBLE) AS income, coalesce(loan_amount, 0.0::DOUBLE) AS loan_amount,
               coalesce(loan_type, -1) AS loan_type
        FROM applications
        WHERE approved IN (0, 1) AND activity_year IS NOT NULL AND county_code IS NOT NULL) f
  WHERE income >= 0 AND loan_amount >= 0)"""

LEVELS = """levels AS (
  SELECT column_name, ord, label, n,
         CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, label) - 1 AS INTEGER) AS idx
  FROM (SELECT 'race_group' AS column_name, 0 AS ord, race_group AS label, count(*) AS n
          FROM approval_rows GROUP BY race_group
        UNION ALL SELECT 'loan_type', 1, CAST(loan_type AS VARCHAR), count(*) FROM approval_rows GROUP BY loan_type
        UNION ALL SELECT 'county_code', 2, CAST(county_code AS VARCHAR), count(*) FROM approval_rows GROUP BY county_code
        UNION ALL SELECT 'activity_year', 3, CAST(activity_year AS VARCHAR), count(*) FROM approval_rows
          GROUP BY activity_year) c)"""

SLOTS = """slots AS (
  SELECT l.column_name, l.label, l.n, l.idx,
         CAST(3 + coalesce((SELECT count(*) FROM levels p WHERE p.ord < l.ord), 0) + l.idx AS INTEGER) AS slot,
         l.column_name || '_vec_' || l.label AS feature
  FROM levels l)"""

MODEL_BASE = with_ctes(RAW, APPS, APPROVAL_ROWS, LEVELS, SLOTS)

ORACLE["category_index"] = MODEL_BASE + "SELECT column_name, label, idx FROM levels"

ORACLE["one_hot_slot_counts"] = MODEL_BASE + "SELECT slot, feature, n AS rows FROM slots"

ORACLE["feature_names"] = MODEL_BASE + """
SELECT 0 AS slot, 'income' AS feature UNION ALL SELECT 1, 'loan_amount'
UNION ALL SELECT 2, 'loan_to_income' UNION ALL SELECT slot, feature FROM slots"""

_NUMERIC_SLOTS = """SELECT 0 AS slot, 'income' AS feature UNION ALL SELECT 1, 'loan_amount'
UNION ALL SELECT 2, 'loan_to_income' UNION ALL SELECT slot, feature FROM slots"""

ORACLE["approval_prediction_write"] = with_ctes(RAW, APPS, APPROVAL_ROWS) + """
SELECT income, loan_amount, loan_to_income, race_group, loan_type, county_code, approved, true AS consistent
FROM approval_rows"""

ORACLE["approval_coefficient_write"] = MODEL_BASE + f"""
SELECT slot, feature, 0.0::DOUBLE AS gradient FROM ({_NUMERIC_SLOTS}
UNION ALL SELECT CAST(3 + count(*) AS INTEGER), 'Intercept' FROM slots) t"""

RATE_MODEL_ROWS = APPROVAL_ROWS.replace("WHERE approved IN (0, 1) AND activity_year IS NOT NULL",
                                        "WHERE approved = 1 AND interest_rate > 0 AND interest_rate < 25")

ORACLE["rate_prediction_write"] = with_ctes(RAW, APPS, RATE_MODEL_ROWS) + """
SELECT interest_rate, race_group, income, loan_amount, county_code, 0.0::DOUBLE AS bias FROM approval_rows"""

ORACLE["rate_coefficient_write"] = with_ctes(RAW, APPS, RATE_MODEL_ROWS, LEVELS, SLOTS) + f"""
SELECT slot, feature, 0.0::DOUBLE AS gradient FROM ({_NUMERIC_SLOTS}) t"""

_LATER_RATES = with_ctes(RAW, APPS, RATE_MODEL_ROWS) + """
SELECT interest_rate, income, loan_amount, loan_to_income, race_group, loan_type, county_code, activity_year, true AS {}
FROM approval_rows WHERE activity_year > 1995"""
ORACLE["saved_model_scores"] = _LATER_RATES.format("same")
ORACLE["saved_model_stream"] = _LATER_RATES.format("scored")

ORACLE["sample_bernoulli_bounds"] = "SELECT true AS rows_of_the_table, true AS size_fits"

ORACLE["preview"] = "SELECT 5::BIGINT AS rows, (row_number() OVER () - 1)::INTEGER AS place, column_name FROM (VALUES " \
    + ", ".join(f"('{c}')" for c in _RAW_COLS) + ") v(column_name)"

ORACLE["logit_group_rates"] = with_ctes(RAW, APPS, APPROVAL_ROWS) + """
SELECT race_group, round(avg(approved), 5) AS fitted_rate FROM approval_rows GROUP BY race_group"""

RATE_ROWS = """rate_rows AS (
  SELECT coalesce(income, 0.0::DOUBLE) AS income, interest_rate, county_code
  FROM applications
  WHERE approved = 1 AND interest_rate IS NOT NULL AND interest_rate > 0 AND interest_rate < 25
    AND county_code IS NOT NULL)"""

ORACLE["ridge_one_feature"] = with_ctes(RAW, APPS, RATE_ROWS) + """,
m AS (SELECT avg(income) AS mx, avg(interest_rate) AS my,
             covar_pop(income, interest_rate) / var_pop(income) / (1 + 0.01 / stddev_pop(interest_rate)) AS slope
      FROM rate_rows)
SELECT CAST(printf('%.5e', my - slope * mx) AS DOUBLE) AS intercept,
       CAST(printf('%.5e', slope) AS DOUBLE) AS slope
FROM m"""

ORACLE["binary_metrics"] = BASE + """,
s AS (SELECT income AS score, approved AS label,
             CAST(coalesce(income, 0.0) > 50 AS INTEGER) AS predicted FROM applications),
per AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
               sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg
        FROM s WHERE score IS NOT NULL GROUP BY score),
cum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS neg_before FROM per)
SELECT round((SELECT avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END) FROM s), 9) AS accuracy,
       round(sum(pos * (neg_before + 0.5 * neg)) / (sum(pos) * sum(neg)), 9) AS auc
FROM cum"""

ORACLE["regression_metrics"] = with_ctes(RAW, APPS, RATE_ROWS) + """,
p AS (SELECT interest_rate AS y, avg(interest_rate) OVER (PARTITION BY county_code) AS yhat FROM rate_rows)
SELECT count(*) AS n,
       round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 9) AS r2,
       round(sqrt(sum((y - yhat) * (y - yhat)) / count(*)), 9) AS rmse
FROM p"""

# --- sources and sinks ------------------------------------------------------------------

ORACLE["read_pipe_delimited"] = with_ctes(RAW) + "SELECT * FROM raw_applications"
ORACLE["read_csv_typed"] = BASE + "SELECT * FROM applications"
ORACLE["read_yearly_files"] = ORACLE["union_years"]
ORACLE["read_parquet_partitioned"] = BASE + "SELECT * FROM applications WHERE state_code = 'TX'"
ORACLE["sink_roundtrip_csv"] = ORACLE["prep_approval"]
ORACLE["clean_partitioned_write"] = BASE + """
SELECT state_code, activity_year, count(*) AS n FROM applications GROUP BY ALL"""
ORACLE["column_profile"] = with_ctes(RAW) + """,
long AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM raw_applications"
    for c in S.RAW_APPLICATION.names) + """),
counted AS (SELECT column_name, value, count(*) AS n FROM long GROUP BY ALL),
columns AS (SELECT column_name, CAST(sum(n) AS BIGINT) AS rows,
                   CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS nulls FROM counted GROUP BY column_name)
SELECT c.column_name, rows, nulls, value, n
FROM columns c LEFT JOIN counted v ON c.column_name = v.column_name AND value IS NOT NULL AND n > 0.01 * rows"""
ORACLE["read_mixed_headers"] = ORACLE["read_pipe_delimited"]
ORACLE["lossless_csv"] = """
SELECT doc_id, text, CASE doc_id % 3 WHEN 1 THEN '' WHEN 2 THEN ' \\' || lang END AS note, n_chars FROM documents"""
ORACLE["stream_county_gaps"] = ORACLE["stream_mixed_headers"] = GAP_BASE + "SELECT * FROM county_gaps"
ORACLE["read_county_table"] = with_ctes(COUNTIES) + "SELECT * FROM counties"
ORACLE["read_gap_table"] = GAP_BASE + "SELECT * FROM county_gaps"
ORACLE["single_file_sink"] = ORACLE["county_gap_top25"]
ORACLE["describe_income"] = BASE + _describe_sql(["income"], "applications", "std", False)
ORACLE["value_counts_approved"] = BASE + """
SELECT approved, count(*) AS n FROM applications
WHERE approved IS NOT NULL GROUP BY approved ORDER BY n DESC, approved"""
