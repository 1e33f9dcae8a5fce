"""Scoring of applications: features, encoding, decision, risk tier."""

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.functions.encoding import encode_for_scoring
from riskspark.functions.features import add_engineered
from riskspark.functions.numeric import round_even
from riskspark.operators.cleaning import require_columns
from riskspark.operators.evaluation import risk_tier
from riskspark.schema import FEATURE_COLS

DEFAULT_THRESHOLD = 0.5
SCORING_INPUTS = [
    "Income", "LoanAmount", "InterestRate", "LoanTerm", "Age", "MonthsEmployed", "CreditScore", "DTIRatio",
]

# What the underwriter sees per left-closed tier.
UNDERWRITING = [
    (0.30, "Low Risk", "✅ LOAN APPROVED",
     "Low default probability. Fast-track approval recommended."),
    (0.60, "Medium Risk", "⚠️ CONDITIONAL APPROVAL / MANUAL REVIEW",
     "Moderate risk. Additional proof of income or higher down payment advised."),
    (None, "High Risk", "❌ HIGH DEFAULT RISK (REJECT / MANUAL REVIEW)",
     "Elevated risk of default. Requires underwriting committee manual review."),
]


def align(df: DataFrame, features=FEATURE_COLS, keep=()) -> DataFrame:
    """The model's features in its order; an absent one is 0, others go."""
    have = set(df.columns)
    return df.select(*keep, *[
        F.col(f"`{c}`").cast("double").alias(c) if c in have else F.lit(0.0).alias(c) for c in features
    ])


def scoring_features(df: DataFrame, policy="scoring") -> DataFrame:
    """Raw applications to encoded features, beside the untouched columns."""
    require_columns(df, SCORING_INPUTS)
    doubles = df.withColumns({c: F.col(c).cast("double") for c in SCORING_INPUTS})
    return encode_for_scoring(add_engineered(doubles, policy))


def decision(score: Column, threshold=DEFAULT_THRESHOLD) -> Column:
    """1 when the unrounded probability reaches the threshold; null if unknown."""
    known = score.isNotNull() & ~F.isnan(score)
    return F.when(known, F.when(score >= threshold, 1).otherwise(0))


def decide(df: DataFrame, score="p", threshold=DEFAULT_THRESHOLD) -> DataFrame:
    return df.withColumns({
        "Predicted_Default": decision(F.col(score), threshold),
        "Threshold": F.lit(float(threshold)),
    })


def underwriting(df: DataFrame, score="p") -> DataFrame:
    """Add risk_tier, status, recommendation, approval_pct and default_pct."""
    p = F.col(score)

    def pick(i):
        chain = F.when(p.isNull() | F.isnan(p), F.lit(None))
        for row in UNDERWRITING[:-1]:
            chain = chain.when(p < row[0], row[i])
        return chain.otherwise(UNDERWRITING[-1][i])

    return df.withColumns({
        "risk_tier": pick(1), "status": pick(2), "recommendation": pick(3),
        "approval_pct": (1.0 - p) * 100.0, "default_pct": p * 100.0,
    })


def _scored(df: DataFrame, model) -> DataFrame:
    """Input columns and the model's probability `p`: one projection chain."""
    nested = df.select("*", F.struct("*").alias("_input"))
    features = align(scoring_features(nested), model.features, ["_input"])
    return model.score(features, out="p").select("_input.*", "p")


def score_batch(df: DataFrame, model, threshold=None) -> DataFrame:
    """Input columns plus Default_Probability, Predicted_Default, Threshold."""
    threshold = _threshold(model, threshold)
    decided = decide(_scored(df, model), "p", threshold)
    return decided.withColumn("Default_Probability", round_even(F.col("p"), 4)).drop("p").select(
        *df.columns, "Default_Probability", "Predicted_Default", "Threshold")


def score_applicants(df: DataFrame, model, threshold=None) -> DataFrame:
    """Per applicant: probability, class, threshold used and risk tier."""
    threshold = _threshold(model, threshold)
    scored = _scored(df, model)
    return scored.select(
        *df.columns,
        round_even(F.col("p"), 4).alias("default_probability"),
        decision(F.col("p"), threshold).alias("predicted_class"),
        F.lit(float(threshold)).alias("threshold_used"),
        F.when(F.col("p").isNotNull() & ~F.isnan("p"), risk_tier("p")).alias("risk_tier"),
    )


def _threshold(model, threshold):
    if threshold is not None:
        return threshold
    stored = getattr(model, "thresholds", None) or {}
    return stored.get("best_cost_threshold", DEFAULT_THRESHOLD)
