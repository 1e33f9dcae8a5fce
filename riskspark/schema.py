"""Columns, rules and search spaces of the loan data model."""

from pyspark.sql import types as T

# --- Fixed values: the data model and its business rules -------------------

TARGET = "DefaultFlag"
ID_COLS = ["LoanID", "CustomerID"]
ORDER_COL = "RowSeq"

NUMERIC_COLS = [
    "Age", "Income", "LoanAmount", "CreditScore", "MonthsEmployed",
    "NumCreditLines", "InterestRate", "LoanTerm", "DTIRatio",
]
BINARY_COLS = ["HasMortgage", "HasDependents", "HasCoSigner"]
NOMINAL_COLS = ["EmploymentType", "MaritalStatus", "LoanPurpose"]
ORDINAL_COL = "Education"
CATEGORICAL_COLS = [ORDINAL_COL, *NOMINAL_COLS, *BINARY_COLS]
REQUIRED_COLS = [TARGET, "Age", "Income", "LoanAmount"]

EDUCATION_LEVELS = {"High School": 0, "Bachelor's": 1, "Master's": 2, "PhD": 3}
NOMINAL_VALUES = {
    "EmploymentType": ["Full-time", "Part-time", "Self-employed", "Unemployed"],
    "MaritalStatus": ["Divorced", "Married", "Single"],
    "LoanPurpose": ["Auto", "Business", "Education", "Home", "Other"],
}

ENGINEERED_COLS = [
    "LoanToIncomeRatio", "MonthlyIncome", "EMI", "EMIToIncomeRatio",
    "EmploymentRatio", "CreditScoreBand", "CompositeRiskIndex",
    "HighRiskFlag", "TotalInterestCost",
]

AGE_MIN, AGE_MAX = 18, 100
INCOME_MIN = 0.0
LOAN_AMOUNT_MIN = 0.0

CREDIT_EDGES = [0, 580, 670, 740, 800, 1000]
CREDIT_LABELS = [0, 1, 2, 3, 4]

RISK_EDGES = [-0.01, 0.30, 0.60, 1.01]
RISK_LABELS = ["Low Risk (<30%)", "Medium Risk (30-60%)", "High Risk (>60%)"]

AGE_GROUP_EDGES = [17, 30, 45, 60, 100]
AGE_GROUP_LABELS = ["18-30", "31-45", "46-60", "60+"]
INCOME_BRACKET_LABELS = ["Very Low", "Low", "Medium", "High", "Very High"]

COST_FALSE_NEGATIVE = 10_000.0
COST_FALSE_POSITIVE = 500.0

SEED = 42
TEST_SIZE = 0.20
CV_FOLDS = 5
TUNING_DRAWS = 5
TUNING_FOLDS = 3

SEARCH_SPACES = {
    "Logistic Regression": {"C": [0.01, 0.1, 1.0, 10.0]},
    "Decision Tree": {
        "max_depth": [5, 8, 10, 15],
        "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 5],
        "criterion": ["gini", "entropy"],
    },
    "Random Forest": {
        "n_estimators": [50, 100],
        "max_depth": [8, 10, 12],
        "min_samples_leaf": [1, 2],
        "max_features": ["sqrt", 0.3],
    },
    "Boosted Trees": {
        "n_estimators": [50, 100],
        "max_depth": [3, 5, 6],
        "learning_rate": [0.05, 0.1],
        "subsample": [0.8, 1.0],
    },
    "Leaf-limited Boosted Trees": {
        "n_estimators": [50, 100],
        "max_depth": [3, 5, 6],
        "learning_rate": [0.05, 0.1],
        "num_leaves": [15, 31],
    },
}

# Text that a CSV reader takes as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- Derived from the above ------------------------------------------------

LOAN_SCHEMA = T.StructType(
    [T.StructField("LoanID", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in NUMERIC_COLS]
    + [T.StructField(c, T.StringType()) for c in CATEGORICAL_COLS]
    + [T.StructField(TARGET, T.IntegerType())]
)

APPLICANT_SCHEMA = T.StructType([f for f in LOAN_SCHEMA if f.name not in ("LoanID", TARGET)])

ONE_HOT_COLS = [f"{c}_{v}" for c in NOMINAL_COLS for v in NOMINAL_VALUES[c]]
FEATURE_COLS = [*NUMERIC_COLS, *BINARY_COLS, ORDINAL_COL, *ENGINEERED_COLS, *ONE_HOT_COLS]


def present(df, columns):
    """The given columns that this frame has (all but four are optional)."""
    return [c for c in columns if c in df.columns]
