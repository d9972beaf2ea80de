"""Explicit schemas: no inference pass over the input."""

from __future__ import annotations

from pyspark.sql import types as T

# Dirty application rows as they arrive in the yearly delimited files:
# measures are text so the cleaning step decides what parses.  Files are bound
# to these names by their header, whatever the order of their columns.
RAW_APPLICATION = T.StructType([
    T.StructField("activity_year", T.IntegerType()),
    T.StructField("state_code", T.StringType()),
    T.StructField("county_code", T.DoubleType()),
    T.StructField("action_taken", T.IntegerType()),
    T.StructField("applicant_ethnicity_1", T.IntegerType()),
    T.StructField("applicant_race_1", T.IntegerType()),
    T.StructField("loan_type", T.IntegerType()),
    T.StructField("loan_amount", T.StringType()),
    T.StructField("property_value", T.StringType()),
    T.StructField("income", T.StringType()),
    T.StructField("interest_rate", T.StringType()),
])
# Columns a raw file cannot lack; a year may lack the others.
REQUIRED_RAW = ["state_code", "county_code", "action_taken", "applicant_race_1", "income"]

# Cleaned, typed application rows.
APPLICATION = T.StructType([
    T.StructField("activity_year", T.IntegerType()),
    T.StructField("state_code", T.StringType()),
    T.StructField("county_code", T.DoubleType()),
    T.StructField("action_taken", T.IntegerType()),
    T.StructField("approved", T.IntegerType()),
    T.StructField("applicant_race_1", T.IntegerType()),
    T.StructField("loan_type", T.IntegerType()),
    T.StructField("loan_amount", T.DoubleType()),
    T.StructField("property_value", T.DoubleType()),
    T.StructField("income", T.DoubleType()),
    T.StructField("interest_rate", T.DoubleType()),
])

# Columns a cleaned file cannot lack.
REQUIRED_APPLICATION = ["state_code", "county_code", "approved", "applicant_race_1"]

# County gap result table.
COUNTY_GAP = T.StructType([
    T.StructField("state_code", T.StringType()),
    T.StructField("county_code", T.DoubleType()),
    T.StructField("total_applications", T.LongType()),
    T.StructField("advantaged_n", T.LongType()),
    T.StructField("disadvantaged_n", T.LongType()),
    T.StructField("advantaged_approval_rate", T.DoubleType()),
    T.StructField("disadvantaged_approval_rate", T.DoubleType()),
    T.StructField("approval_disparity_gap", T.DoubleType()),
])

# County attribute table (census county list without geometry).
COUNTY_DIMENSION = T.StructType([
    T.StructField("county_fips", T.StringType()),
    T.StructField("statefp", T.StringType()),
    T.StructField("name", T.StringType()),
])

LOGIT_COEFFICIENTS = T.StructType([
    T.StructField("slot", T.IntegerType()),
    T.StructField("feature", T.StringType()),
    T.StructField("coefficient", T.DoubleType()),
    T.StructField("odds_ratio", T.DoubleType()),
])

LINEAR_COEFFICIENTS = T.StructType([
    T.StructField("slot", T.IntegerType()),
    T.StructField("feature", T.StringType()),
    T.StructField("coefficient", T.DoubleType()),
])
