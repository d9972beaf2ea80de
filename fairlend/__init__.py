"""fairlend: outcome-disparity analysis of application-level lending data on Spark.

Sub-packages
------------
functions   column-expression builders, code lists, schemas, exact order statistics
sources     readers (delimited, CSV, yearly files, partitioned Parquet, county table) and sinks
operators   cleaning, features, profiling, descriptive tables, group gaps, models, metrics
plans       session set-up, fixture views over test tables, the registered query catalog
streaming   the yearly-file ingest as a Structured Streaming job
"""

__version__ = "0.1.0"

from fairlend.operators.clean import (  # noqa: E402
    audit_cleaning, clean_applications, prep_approval, prep_gap, prep_rate,
    sample_bernoulli, sample_by_key,
)
from fairlend.operators.describe import (  # noqa: E402
    approval_by_race, approval_over_time, histogram, interest_by_race,
    loan_type_approval, summary_statistics, summary_wide,
)
from fairlend.operators.features import (  # noqa: E402
    add_comparison_group, add_loan_to_income, add_race_group, model_features,
)
from fairlend.operators.gaps import (  # noqa: E402
    county_gaps, county_map, gap_range, group_gap, ranked_gap_table, state_gap_map, top_gaps,
)
from fairlend.operators.metrics import binary_metrics, regression_metrics  # noqa: E402
from fairlend.operators.models import fit_approval_model, fit_rate_model  # noqa: E402
from fairlend.operators.profile import describe_column, null_counts, value_counts  # noqa: E402
from fairlend.sources.readers import (  # noqa: E402
    read_county_dimension, read_csv_typed, read_delimited, read_parquet_partitioned,
    read_yearly_files,
)

__all__ = [
    "audit_cleaning", "clean_applications", "prep_approval", "prep_gap", "prep_rate",
    "sample_bernoulli", "sample_by_key", "approval_by_race", "approval_over_time", "histogram",
    "interest_by_race", "loan_type_approval", "summary_statistics", "summary_wide",
    "add_comparison_group", "add_loan_to_income", "add_race_group", "model_features",
    "county_gaps", "county_map", "gap_range", "group_gap", "ranked_gap_table", "state_gap_map",
    "top_gaps", "binary_metrics", "regression_metrics", "fit_approval_model", "fit_rate_model",
    "describe_column", "null_counts", "value_counts", "read_county_dimension", "read_csv_typed",
    "read_delimited", "read_parquet_partitioned", "read_yearly_files",
]
