"""The normalised tables: customers, loan_applications, loan_details."""

from pyspark.sql import DataFrame, functions as F

from riskspark.schema import TARGET

# Columns and keys of the three tables.
CUSTOMER_COLS = [
    "CustomerID", "Age", "Income", "Education", "EmploymentType",
    "MaritalStatus", "HasMortgage", "HasDependents",
]
APPLICATION_COLS = [
    "LoanID", "CustomerID", "LoanAmount", "LoanPurpose", "LoanTerm",
    "InterestRate", "HasCoSigner", TARGET,
]
DETAIL_COLS = ["LoanID", "CreditScore", "MonthsEmployed", "NumCreditLines", "DTIRatio"]

PRIMARY_KEYS = {"customers": "CustomerID", "loan_applications": "LoanID", "loan_details": "LoanID"}
FOREIGN_KEYS = [
    ("loan_applications", "CustomerID", "customers"),
    ("loan_details", "LoanID", "loan_applications"),
]


def with_customer_id(df: DataFrame) -> DataFrame:
    return df.withColumn("CustomerID", F.concat(F.lit("CUST_"), F.col("LoanID")))


def customers(df: DataFrame, unique_ids=False) -> DataFrame:
    """Distinct customer rows.

    Rows with unique ids are distinct already: then it is a projection, and a
    later query reads only the columns it needs.
    """
    rows = with_customer_id(df).select(*CUSTOMER_COLS)
    return rows if unique_ids else rows.distinct()


def loan_applications(df: DataFrame) -> DataFrame:
    return with_customer_id(df).select(*APPLICATION_COLS)


def loan_details(df: DataFrame) -> DataFrame:
    return df.select(*DETAIL_COLS)


def normalise(df: DataFrame, unique_ids=False) -> dict:
    """The three tables by name; cleaned rows have unique ids."""
    return {
        "customers": customers(df, unique_ids),
        "loan_applications": loan_applications(df),
        "loan_details": loan_details(df),
    }


def integrity_violations(tables: dict) -> DataFrame:
    """(table_name, rule, violations) for every primary and foreign key."""
    checks = []
    for name, key in PRIMARY_KEYS.items():
        repeated = tables[name].groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
        checks.append(_violations(repeated, name, f"primary key {key}"))
    for name, key, parent in FOREIGN_KEYS:
        # One row per key on both sides, so a key with many rows is no hot spot.
        used = tables[name].where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
        orphans = used.join(tables[parent].select(key).distinct(), key, "left_anti")
        checks.append(_violations(orphans, name, f"foreign key {key}", F.sum("rows")))
    return _union(checks)


def _violations(bad: DataFrame, table, rule, number=None) -> DataFrame:
    number = F.count(F.lit(1)) if number is None else F.coalesce(number, F.lit(0))
    return bad.agg(number.alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), "violations"
    )


def table_counts(tables: dict) -> DataFrame:
    """(table_name, row_count) per table."""
    return _union([
        t.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, t in tables.items()
    ])


def _union(frames):
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
