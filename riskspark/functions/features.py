"""The nine engineered columns, as one expression library.

policy="training" leaves undefined ratios null, policy="scoring" replaces
them by zero, policy="app" is scoring with left-closed score bands.
"""

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.functions.binning import cut
from riskspark.functions.numeric import ratio
from riskspark.schema import CREDIT_EDGES, CREDIT_LABELS, ENGINEERED_COLS

POLICIES = ("training", "scoring", "app")


def _guarded(num: Column, den: Column, policy: str) -> Column:
    if policy == "training":
        return ratio(num, den)
    return F.when(den > 0, ratio(num, den)).otherwise(0.0)


def loan_to_income(policy="training") -> Column:
    return _guarded(F.col("LoanAmount"), F.col("Income"), policy)


def monthly_income() -> Column:
    return F.col("Income") / 12.0


def emi(policy="training") -> Column:
    """Equated monthly instalment by the amortisation formula."""
    amount, term = F.col("LoanAmount"), F.col("LoanTerm")
    rate = F.col("InterestRate") / 100.0 / 12.0
    growth = F.pow(1 + rate, term)
    flat = _guarded(amount, term, "scoring" if policy == "scoring" else "training")
    return F.when(rate > 0, ratio(amount * rate * growth, growth - 1)).otherwise(flat)


def emi_to_income(policy="training") -> Column:
    return _guarded(F.col("EMI"), F.col("MonthlyIncome"), policy)


def employment_ratio() -> Column:
    # greatest() skips nulls, so an unknown age is kept out of it.
    adult_months = F.greatest((F.col("Age") - 18) * 12, F.lit(1.0))
    return F.when(F.col("Age").isNotNull(), F.col("MonthsEmployed") / adult_months)


def credit_band(col: Column = None, closed="right", policy="training") -> Column:
    """Score band 0 (poor) .. 4 (excellent)."""
    score = F.col("CreditScore") if col is None else col
    if policy == "training":
        return cut(score, CREDIT_EDGES, CREDIT_LABELS, closed).cast("int")
    edges = [float("-inf"), *CREDIT_EDGES[1:]]
    if closed == "left":
        edges[-1] = float("inf")
    return F.coalesce(cut(score, edges, CREDIT_LABELS, closed, include_lowest=True).cast("int"), F.lit(0))


def composite_risk(policy="training") -> Column:
    return _guarded(F.col("DTIRatio") * F.col("InterestRate"), F.col("CreditScore") / 100.0,
                    "scoring" if policy == "scoring" else "training")


def high_risk_flag() -> Column:
    return F.when((F.col("DTIRatio") > 0.6) & (F.col("CreditScore") < 600), 1).otherwise(0)


def total_interest() -> Column:
    return F.col("EMI") * F.col("LoanTerm") - F.col("LoanAmount")


def add_engineered(df: DataFrame, policy="training") -> DataFrame:
    """Append the nine engineered columns; two projections, no shuffle."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    base = df.withColumns({
        "LoanToIncomeRatio": loan_to_income(policy),
        "MonthlyIncome": monthly_income(),
        "EMI": emi(policy),
        "EmploymentRatio": employment_ratio(),
        "CreditScoreBand": credit_band(closed="left" if policy == "app" else "right", policy=policy),
        "CompositeRiskIndex": composite_risk(policy),
        "HighRiskFlag": high_risk_flag(),
    })
    full = base.withColumns({
        "EMIToIncomeRatio": emi_to_income(policy),
        "TotalInterestCost": total_interest(),
    })
    return full.select(*[c for c in full.columns if c not in ENGINEERED_COLS], *ENGINEERED_COLS)
