"""Revenue, loss and net revenue over all orders."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul.functions import metrics as m
from backhaul.operators.facts import returned_only


def total_revenue(orders: DataFrame) -> DataFrame:
    return orders.agg(F.sum("total_amount").alias("total_revenue"))


def return_loss(order_returns: DataFrame) -> DataFrame:
    """Revenue of returned orders; NULL, not 0, when there are none."""
    return returned_only(order_returns).agg(F.sum("total_amount").alias("return_loss"))


def net_revenue(order_returns: DataFrame) -> DataFrame:
    gross = F.sum("total_amount")
    return order_returns.agg(
        gross.alias("total_revenue"),
        m.loss().alias("return_loss"),
        (gross - m.loss()).alias("net_revenue"),
    )


def return_rate(order_returns: DataFrame) -> DataFrame:
    return order_returns.agg(m.rate(m.return_count(), m.order_count()).alias("return_rate"))
