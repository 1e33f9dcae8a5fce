"""Portfolio-risk marts.

Every mart takes the dict of normalised tables. `wide(df)` builds a dict
around one cleaned frame instead: the marts then read it without any join,
and give the same rows because the three tables share one key, 1:1.
"""

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.schema import TARGET


def wide(cleaned: DataFrame) -> dict:
    return {"wide": cleaned}


def _loans(tables: dict, *others) -> DataFrame:
    """Applications joined to the named tables; no join for a wide source."""
    if "wide" in tables:
        return tables["wide"]
    loans = tables["loan_applications"]
    if "customers" in others:
        loans = loans.join(tables["customers"], "CustomerID")
    if "loan_details" in others:
        loans = loans.join(tables["loan_details"], "LoanID")
    return loans


def _mean(col, digits) -> Column:
    return F.round(F.avg(col), digits)


def _rate() -> Column:
    return F.round(F.avg(TARGET) * 100.0, 2)


def _risk(count="Total_Loans", defaults="Default_Count", rate="Default_Rate_Pct"):
    return [
        F.count("LoanID").alias(count),
        F.sum(TARGET).alias(defaults),
        _rate().alias(rate),
    ]


def kpi(tables: dict) -> DataFrame:
    return _loans(tables).agg(*_kpi_columns())


def kpi_extended(tables: dict) -> DataFrame:
    return _loans(tables).agg(
        *_kpi_columns(),
        _mean("LoanAmount", 2).alias("Avg_Loan_Amount"),
        _mean("InterestRate", 2).alias("Avg_Interest_Rate"),
    )


def _kpi_columns():
    return [
        F.count(F.lit(1)).alias("Total_Applications"),
        F.sum(F.when(F.col(TARGET) == 0, 1).otherwise(0)).alias("Non_Default_Count"),
        F.sum(F.when(F.col(TARGET) == 1, 1).otherwise(0)).alias("Default_Count"),
        _rate().alias("Default_Rate_Pct"),
    ]


def by_education(tables: dict) -> DataFrame:
    return (
        _loans(tables, "customers").groupBy("Education")
        .agg(*_risk(), _mean("Income", 2).alias("Avg_Income"), _mean("LoanAmount", 2).alias("Avg_Loan_Amount"))
        .orderBy(F.desc("Default_Rate_Pct"))
    )


def by_employment(tables: dict) -> DataFrame:
    return (
        _loans(tables, "customers", "loan_details").groupBy("EmploymentType")
        .agg(*_risk(), _mean("Income", 2).alias("Avg_Income"), _mean("MonthsEmployed", 1).alias("Avg_Months_Employed"))
        .orderBy(F.desc("Default_Rate_Pct"))
    )


def by_purpose(tables: dict) -> DataFrame:
    return (
        _loans(tables).groupBy("LoanPurpose")
        .agg(*_risk(), _mean("LoanAmount", 2).alias("Avg_Loan_Amount"), _mean("InterestRate", 2).alias("Avg_Interest_Rate"))
        .orderBy(F.desc("Default_Rate_Pct"))
    )


def profiles(tables: dict) -> DataFrame:
    status = F.when(F.col(TARGET) == 1, "Defaulter").otherwise("Non-Defaulter")
    return (
        _loans(tables, "customers", "loan_details").groupBy(TARGET)
        .agg(
            F.count("LoanID").alias("Applicant_Count"),
            _mean("Income", 2).alias("Avg_Income"),
            _mean("LoanAmount", 2).alias("Avg_Loan_Amount"),
            _mean("CreditScore", 1).alias("Avg_Credit_Score"),
            _mean("DTIRatio", 3).alias("Avg_DTI_Ratio"),
            _mean("InterestRate", 2).alias("Avg_Interest_Rate"),
        )
        .select(status.alias("Status"), "*").drop(TARGET)
    )


def score_band() -> Column:
    """Left-closed bands; a score between two bands (669.5) falls to the last."""
    score = F.col("CreditScore")
    return (
        F.when(score < 580, "1. Poor (<580)")
        .when(score.between(580, 669), "2. Fair (580-669)")
        .when(score.between(670, 739), "3. Good (670-739)")
        .when(score.between(740, 799), "4. Very Good (740-799)")
        .otherwise("5. Excellent (800+)")
    )


def by_score_band(tables: dict) -> DataFrame:
    return (
        _loans(tables, "loan_details").groupBy(score_band().alias("Credit_Score_Band"))
        .agg(*_risk()).orderBy("Credit_Score_Band")
    )


def high_risk_segment(tables: dict) -> DataFrame:
    return (
        _loans(tables, "loan_details").where((F.col("DTIRatio") > 0.6) & (F.col("CreditScore") < 600))
        .agg(*_risk("High_Risk_Count", "High_Risk_Defaults", "High_Risk_Default_Rate_Pct"))
    )


def by_cosigner(tables: dict) -> DataFrame:
    return _loans(tables).groupBy("HasCoSigner").agg(*_risk())


# Name of the exported file -> mart.
EXPORTS = {
    "sql_kpi_summary": kpi_extended,
    "sql_default_by_education": by_education,
    "sql_default_by_employment": by_employment,
    "sql_default_by_purpose": by_purpose,
    "sql_financial_profiles": profiles,
}
