"""Column expressions shared by the operators.

They expect the columns of ``order_returns`` / ``order_facts``: one row per order with a
boolean ``returned``. Money is decimal, so sums are exact and need no rounding; ratios are
doubles, and a zero denominator yields NULL.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_count() -> Column:
    return F.count("order_id")


def return_count() -> Column:
    return F.count(F.when(F.col("returned"), F.col("order_id")))


def returned_sum(column: str = "total_amount") -> Column:
    """Sum over returned orders; NULL when there are none."""
    return F.sum(F.when(F.col("returned"), F.col(column)))


def zero_if_null(total: Column) -> Column:
    return F.coalesce(total, F.lit(0))


def loss() -> Column:
    """Revenue of returned orders, 0 when nothing came back."""
    return zero_if_null(returned_sum())


def quotient(numerator: Column, denominator: Column) -> Column:
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def rate(numerator: Column, denominator: Column) -> Column:
    """Share rounded to 4 decimals."""
    return F.round(quotient(numerator, denominator), 4)


def percent(numerator: Column, denominator: Column) -> Column:
    """Share in percent rounded to 2 decimals."""
    return F.round(quotient(numerator.cast("double") * F.lit(100.0), denominator), 2)


def mean(column: str) -> Column:
    """Average rounded to cents; divides the exact sum once instead of averaging decimals."""
    return F.round(quotient(F.sum(column), F.count(column)), 2)


def economic_value() -> Column:
    """Revenue, margin and shipping of one order; NULL if any of the three is NULL."""
    return F.col("total_amount") + F.col("profit_margin") + F.col("shipping_cost")


def month_key(date: str) -> Column:
    return F.date_format(date, "yyyy-MM")
