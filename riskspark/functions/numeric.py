"""Small numeric helpers shared by the operators."""

from pyspark.sql import Column, functions as F


def round_even(col: Column, digits: int) -> Column:
    """Round a double half to even at a number of decimals."""
    scale = 10.0 ** digits
    return F.rint(col * scale) / scale


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double, null where den is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))
