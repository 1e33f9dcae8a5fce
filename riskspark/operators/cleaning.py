"""Validation, deduplication, repair and imputation of loan records."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F, types as T

from riskspark.functions.encoding import bools_to_int, encode_binary, encode_ordinal, one_hot
from riskspark.operators.ranks import column_quantiles
from riskspark.schema import (
    AGE_MAX, AGE_MIN, CATEGORICAL_COLS, ID_COLS, INCOME_MIN, LOAN_AMOUNT_MIN, ORDER_COL,
    REQUIRED_COLS, TARGET, present,
)
from riskspark.session import stage

NULL_POLICIES = ("reference", "keep", "drop")

# Most repeated ids that are broadcast: about 100 MB.
FEW_IDS = 1_000_000


def require_columns(df: DataFrame, cols=REQUIRED_COLS) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def require_rows(df: DataFrame, message="the table has no rows") -> None:
    if df.isEmpty():
        raise RuntimeError(message)


# --- Duplicates ------------------------------------------------------------

def dedup(df: DataFrame, key="LoanID", order=ORDER_COL, broadcast_limit=FEW_IDS) -> DataFrame:
    """First row per key in input order; full-row distinct without a key.

    Rows of a key are ordered by `order`, nulls first, and then by a hash of
    the row, so ties have one answer too; a table without `order` is ordered by
    the hash alone. First the repeated keys are found, which shuffles nothing
    but keys. When they are few (counted), they are broadcast, and only their
    rows are ranked while all others stay where they are; otherwise every row
    is ranked. Both give the same rows.
    """
    if not key or key not in df.columns:
        if order in df.columns:
            return df.groupBy(*[c for c in df.columns if c != order]).agg(F.min(order).alias(order))
        return df.distinct()
    repeated = stage(
        df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "repeated")
    if repeated.count() > broadcast_limit:
        return first_by_rank(df, key, order)
    marked = df.join(F.broadcast(repeated), F.col(key).eqNullSafe(F.col("_key")), "left")
    once, copies = marked.where("_n IS NULL"), marked.where("_n IS NOT NULL")
    return once.select(*df.columns).unionByName(first_by_rank(copies.select(*df.columns), key, order))


def first_by_rank(df: DataFrame, key, order) -> DataFrame:
    """First row per key by rank.

    The rank filter runs before the shuffle too (window group limit), so a key
    that holds much of the data shrinks to one row per task first.
    """
    by = [F.col(order).asc_nulls_first()] if order in df.columns else []
    first = Window.partitionBy(key).orderBy(*by, F.xxhash64(*df.columns))
    return df.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy")


def duplicate_count(df: DataFrame, key="LoanID", order=ORDER_COL) -> DataFrame:
    """One row: how many rows dedup removes; null keys count as equal."""
    keys = [key] if key and key in df.columns else [c for c in df.columns if c != order]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows")
    )


# --- Invalid values --------------------------------------------------------

def null_out_of_range(df: DataFrame, col="Age", lo=AGE_MIN, hi=AGE_MAX) -> DataFrame:
    if col not in df.columns:
        return df
    return df.withColumn(col, F.when(F.col(col).between(lo, hi), F.col(col)))


@dataclass
class InvalidCounts:
    """Rows that break a rule, the second one after the first was applied."""

    income: int
    amount: int


def _valid(col, test, keep_null):
    return test | col.isNull() if keep_null else test


def count_invalid(df: DataFrame) -> InvalidCounts:
    """One pass over two columns; the result is one row."""
    income = F.col("Income") if "Income" in df.columns else F.lit(None).cast("double")
    amount = F.col("LoanAmount") if "LoanAmount" in df.columns else F.lit(None).cast("double")
    bad_amount = amount <= LOAN_AMOUNT_MIN
    row = df.agg(
        F.count_if(income < INCOME_MIN).alias("income"),
        F.count_if(bad_amount & (income >= INCOME_MIN)).alias("strict"),
        F.count_if(bad_amount & ((income >= INCOME_MIN) | income.isNull())).alias("lenient"),
    ).first()
    return InvalidCounts(row["income"], row["strict"] if row["income"] else row["lenient"])


def drop_invalid(df: DataFrame, null_policy="reference") -> DataFrame:
    """Drop negative incomes, then non-positive amounts.

    null_policy="reference": a null goes only if its column has an invalid
    value at all, so whether it survives depends on the other rows.
    """
    if null_policy not in NULL_POLICIES:
        raise ValueError(f"null_policy must be one of {NULL_POLICIES}")
    if null_policy == "reference":
        found = count_invalid(df)
        keep_income, keep_amount = found.income == 0, found.amount == 0
    else:
        keep_income = keep_amount = null_policy == "keep"
    if "Income" in df.columns:
        df = df.where(_valid(F.col("Income"), F.col("Income") >= INCOME_MIN, keep_income))
    if "LoanAmount" in df.columns:
        df = df.where(_valid(F.col("LoanAmount"), F.col("LoanAmount") > LOAN_AMOUNT_MIN, keep_amount))
    return df


# --- Missing values --------------------------------------------------------

def numeric_columns(df: DataFrame):
    """Numeric columns that may be imputed: neither ids nor the target."""
    skip = {TARGET, ORDER_COL, *ID_COLS}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def missing_profile(df: DataFrame, cols=None) -> DataFrame:
    """(column, n_missing) for every column, in one aggregate."""
    cols = [c for c in df.columns if c != ORDER_COL] if cols is None else cols
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], cols, "column", "n_missing")


def missing_total(df: DataFrame) -> DataFrame:
    return missing_profile(df).agg(F.sum("n_missing").alias("total_missing"))


def medians(df: DataFrame, cols=None) -> DataFrame:
    """(column, value): exact medians, mean of the two middle values."""
    cols = numeric_columns(df) if cols is None else present(df, cols)
    return column_quantiles(df, cols, [0.5]).select("column", "value")


def approx_medians(df: DataFrame, cols=None, accuracy=10_000) -> DataFrame:
    """(column, value) from mergeable sketches, for very wide value ranges."""
    cols = numeric_columns(df) if cols is None else present(df, cols)
    sketch = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(c) for c in cols])
    return sketch.unpivot([], cols, "column", "value")


def modes(df: DataFrame, cols=None) -> DataFrame:
    """(column, value): most frequent text, the smallest on a tie."""
    cols = present(df, CATEGORICAL_COLS if cols is None else cols)
    counts = (
        df.select(*cols).unpivot([], cols, "column", "value").where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("value"))).alias("best")
    return counts.groupBy("column").agg(best).select("column", F.col("best.value").alias("value"))


def fill(df: DataFrame, values: DataFrame) -> DataFrame:
    """Fill nulls from a (column, value) frame, which has one row per column."""
    fills = {r["column"]: r["value"] for r in values.collect() if r["value"] is not None}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()}) if fills else df


def columns_with_nulls(df: DataFrame, cols) -> list:
    """Those of the columns that need a fill at all; one scan, one row."""
    if not cols:
        return []
    row = df.agg(*[F.max(F.col(c).isNull()).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def impute_median(df: DataFrame, cols=None, fit_on: DataFrame = None, method="exact") -> DataFrame:
    """Numeric columns as doubles, nulls replaced by the column median."""
    cols = numeric_columns(df) if cols is None else present(df, cols)
    return _impute(df, cols, [], fit_on, method)


def impute_mode(df: DataFrame, cols=None, fit_on: DataFrame = None) -> DataFrame:
    """Text columns, nulls replaced by the most frequent value."""
    return _impute(df, [], present(df, CATEGORICAL_COLS if cols is None else cols), fit_on)


def _impute(df, numeric, text, fit_on=None, method="exact"):
    """Fill both kinds; columns without nulls are not fitted at all."""
    gaps = columns_with_nulls(df, [*numeric, *text])
    fit_on = df if fit_on is None else fit_on
    numeric_gaps, text_gaps = [c for c in numeric if c in gaps], [c for c in text if c in gaps]
    doubles = {c: F.col(c).cast("double") for c in numeric}
    df = df.withColumns(doubles) if doubles else df
    if numeric_gaps:
        df = fill(df, (medians if method == "exact" else approx_medians)(fit_on, numeric_gaps))
    return fill(df, modes(fit_on, text_gaps)) if text_gaps else df


# --- Composites ------------------------------------------------------------

def repair(df: DataFrame, null_policy="reference") -> DataFrame:
    """Null impossible ages, drop impossible incomes and amounts."""
    return drop_invalid(null_out_of_range(df), null_policy)


def impute(df: DataFrame, fit_on: DataFrame = None) -> DataFrame:
    """Both imputations, fitted on the frame before imputation."""
    return _impute(df, numeric_columns(df), present(df, CATEGORICAL_COLS), fit_on)


def encode(df: DataFrame, vocab: dict = None) -> DataFrame:
    """Cleaned rows with Education_Encoded beside Education, flags as 0/1."""
    coded = encode_ordinal(encode_binary(df), out="Education_Encoded")
    return bools_to_int(one_hot(coded, vocab=vocab))


def clean_rows(df: DataFrame, null_policy="reference", staged=True) -> DataFrame:
    """Deduplicated, repaired and imputed rows.

    The deduplicated rows are staged: the fits below read a few columns of
    them each.
    """
    require_columns(df)
    unique = dedup(df)
    unique = stage(unique, "unique") if staged else unique
    valid = repair(unique, null_policy)
    require_rows(valid, "no row is left after removing invalid ones")
    return impute(valid)


def require_target(df: DataFrame, target=TARGET) -> None:
    """Rows without a target are refused: it is neither imputed nor dropped."""
    n = df.where(F.col(target).isNull()).count()
    if n:
        raise ValueError(f"{n} rows have no {target}")


def clean(df: DataFrame, null_policy="reference", vocab: dict = None):
    """(cleaned, encoded) forms of a raw loan table."""
    require_rows(df)
    require_columns(df)
    require_target(df)
    cleaned = clean_rows(df, null_policy)
    return cleaned, encode(cleaned, vocab)


def cleaning_report(df: DataFrame) -> DataFrame:
    """One row: how many rows each rule removed or changed."""
    needed = present(df, ["LoanID", ORDER_COL, "Age", "Income", "LoanAmount"])
    unique = stage(dedup(df.select(*needed) if "LoanID" in df.columns else df), "unique")
    found = count_invalid(unique)
    income, amount, age = F.col("Income"), F.col("LoanAmount"), F.col("Age")
    keep_income = _valid(income, income >= INCOME_MIN, found.income == 0)
    keep_amount = _valid(amount, amount > LOAN_AMOUNT_MIN, found.amount == 0)
    income_ok, amount_ok = F.coalesce(keep_income, F.lit(False)), F.coalesce(keep_amount, F.lit(False))
    kept = unique.agg(
        F.count(F.lit(1)).alias("rows_unique"),
        F.count_if((age < AGE_MIN) | (age > AGE_MAX)).alias("ages_nulled"),
        F.count_if(~income_ok).alias("income_dropped"),
        F.count_if(income_ok & ~amount_ok).alias("amount_dropped"),
        F.count_if(income_ok & amount_ok).alias("rows_out"),
    ).first()
    return df.agg(F.count(F.lit(1)).alias("rows_in")).select(
        "rows_in",
        (F.col("rows_in") - F.lit(kept["rows_unique"])).alias("duplicates_dropped"),
        *[F.lit(kept[c]).cast("bigint").alias(c) for c in ("ages_nulled", "income_dropped", "amount_dropped", "rows_out")],
    )
