"""Code lists and labels used by the lending analysis.

FIXED VALUES. These must equal the studied analysis for results to match:
race codes and their group labels, the comparison-group membership, the
loan-type labels, the two states and their census FIPS prefixes, the
action codes that mean approved / denied, and the model settings.
"""

from __future__ import annotations

# --- fixed values: five-label race grouping used by the models and gap study
RACE_FIVE = {
    "Native American": [1],
    "Black": [3],
    "White": [5],
    "Asian": [2, 21, 22, 23, 24, 25, 26, 27],
}
RACE_FIVE_DEFAULT = "Other"

# --- fixed values: seven-label race grouping of the descriptive report tables
RACE_SEVEN = {
    "American Indian / Alaska Native": [1],
    "Asian": [2, 21, 22, 23, 24, 25, 26, 27],
    "Black": [3],
    "Native Hawaiian / Pacific Islander": [4, 41, 42, 43, 44],
    "White": [5],
    "Not Provided": [6, 7],
}
RACE_SEVEN_DEFAULT = "Unknown / Other"

# --- fixed values: comparison groups of the county gap study
COMPARISON_GROUPS = {
    "Advantaged": ["White", "Asian"],
    "Disadvantaged": ["Black", "Native American"],
}
ADVANTAGED = "Advantaged"
DISADVANTAGED = "Disadvantaged"

# --- fixed values: loan-type labels
LOAN_LABELS = {1: "Conventional", 2: "FHA", 3: "VA", 4: "RHS/FSA"}
MISSING_LOAN_TYPE = -1

# --- fixed values: states studied and their census state FIPS codes
STATES = ["CA", "TX"]
STATE_FIPS = {"CA": "06", "TX": "48"}

# --- fixed values: action_taken codes kept, and which of them mean approval
APPROVED_ACTIONS = [1, 2]
DENIED_ACTIONS = [3]

# --- fixed values: cleaning and study settings
NULL_KEY_COLUMNS = ["county_code", "applicant_race_1", "income"]
NUMERIC_COLUMNS = ["loan_amount", "income", "interest_rate", "property_value"]
NONNEG_COLUMNS = ["income", "interest_rate", "loan_amount"]
DROPPED_COLUMNS = ["applicant_ethnicity_1"]
FILL_DEFAULTS = {"income": 0.0, "loan_amount": 0.0, "loan_type": -1}
MIN_GROUP_N = 50
TOP_K = 25
RATE_BOUNDS = (0.0, 25.0)
NUMERIC_FEATURES = ["income", "loan_amount", "loan_to_income"]
CATEGORICAL_FEATURES = ["race_group", "loan_type", "county_code", "activity_year"]
LOGIT_PARAMS = {"maxIter": 20, "regParam": 0.01, "elasticNetParam": 0.0}
LINEAR_PARAMS = {"maxIter": 20, "regParam": 0.01}
SAMPLE_SEED = 42
