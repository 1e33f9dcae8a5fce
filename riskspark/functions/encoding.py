"""Categorical encodings, for training and for scoring."""

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from riskspark.schema import (
    BINARY_COLS, EDUCATION_LEVELS, NOMINAL_COLS, NOMINAL_VALUES, ORDINAL_COL, present,
)

def mapped(col: Column, mapping: dict, default=None) -> Column:
    """Value looked up in a literal mapping."""
    chain = None
    for key, value in mapping.items():
        chain = F.when(col == key, F.lit(value)) if chain is None else chain.when(col == key, F.lit(value))
    return chain.otherwise(F.lit(default).cast("int") if default is None else F.lit(default))


def encode_binary(df: DataFrame, cols=BINARY_COLS, unknown=None) -> DataFrame:
    """Yes/No to 1/0; anything else to `unknown`."""
    yes_no = {"Yes": 1, "No": 0}
    return df.withColumns({c: mapped(F.col(c), yes_no, unknown) for c in present(df, cols)})


def encode_ordinal(df: DataFrame, col=ORDINAL_COL, mapping=EDUCATION_LEVELS, out=None, unknown=None) -> DataFrame:
    """Ordered category to its rank; overwrites the column unless `out` is given."""
    if col not in df.columns:
        return df
    return df.withColumn(out or col, mapped(F.col(col), mapping, unknown))


def category_values(df: DataFrame, cols) -> dict:
    """Sorted distinct values per column; one aggregate over all columns.

    As many values reach the driver as one-hot columns are made of them.
    """
    cols = present(df, cols)
    if not cols:
        return {}
    pairs = (
        df.select(*cols).unpivot([], cols, "column", "value")
        .where(F.col("value").isNotNull()).distinct()
    )
    rows = pairs.collect()
    return {c: sorted(r["value"] for r in rows if r["column"] == c) for c in cols}


def unknown_categories(df: DataFrame, vocab: dict = None) -> DataFrame:
    """(column, value, n) of category values outside the known ones; one scan."""
    vocab = {ORDINAL_COL: list(EDUCATION_LEVELS), **NOMINAL_VALUES} if vocab is None else vocab
    cols = present(df, vocab)
    known = functools.reduce(
        operator.or_, [(F.col("column") == c) & F.col("value").isin(vocab[c]) for c in cols])
    return (
        df.select(*cols).unpivot([], cols, "column", "value").where(F.col("value").isNotNull() & ~known)
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def one_hot(df: DataFrame, cols=NOMINAL_COLS, vocab: dict = None) -> DataFrame:
    """One 0/1 column per category, in sorted order; the source is dropped.

    Null and values outside the vocabulary give zero everywhere. Without a
    vocabulary the values that occur are used.
    """
    cols = present(df, cols)
    vocab = category_values(df, cols) if vocab is None else vocab
    flags = [
        F.when(F.col(c) == v, 1).otherwise(0).alias(f"{c}_{v}")
        for c in cols for v in vocab[c]
    ]
    return df.select(*[c for c in df.columns if c not in cols], *flags)


def bools_to_int(df: DataFrame) -> DataFrame:
    """Every boolean column as 0/1."""
    flags = [name for name, kind in df.dtypes if kind == "boolean"]
    return df.withColumns({c: F.col(c).cast("int") for c in flags}) if flags else df


def encode_for_scoring(df: DataFrame) -> DataFrame:
    """Encoding with a fallback for every unknown value.

    Not "Yes" is 0, an unknown education is 1, an unknown nominal value is
    zero in the fixed vocabulary; absent nominal columns count as unknown.
    """
    df = df.withColumns({c: F.when(F.col(c) == "Yes", 1).otherwise(0) for c in present(df, BINARY_COLS)})
    df = encode_ordinal(df, unknown=1)
    absent = [c for c in NOMINAL_COLS if c not in df.columns]
    if absent:
        df = df.withColumns({c: F.lit(None).cast("string") for c in absent})
    return one_hot(df, NOMINAL_COLS, NOMINAL_VALUES)
