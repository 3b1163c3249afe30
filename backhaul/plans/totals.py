"""Totals over a whole frame."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total_of_few(column: str) -> Column:
    """``SUM(column) OVER ()`` for a result of a few grouped rows.

    Those meet in one task for the window; nothing below is read a second time.
    """
    return F.sum(column).over(Window.partitionBy())


def grand_total(stored: DataFrame, column: str) -> Column:
    """``SUM(column) OVER ()`` of a stored table of any size, as a scalar subquery.

    The window form would move every row to one task; this adds partial sums in a second pass
    over the table.
    """
    return stored.agg(F.sum(column).alias("total")).scalar()
