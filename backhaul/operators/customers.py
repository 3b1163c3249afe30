"""Customer value, return behaviour and return loss."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul.functions import metrics as m
from backhaul.functions import segments
from backhaul.operators.facts import returned_only


def top_loss_customers(order_returns: DataFrame, k: int = 10) -> DataFrame:
    return (returned_only(order_returns).groupBy("customer_id")
            .agg(m.order_count().alias("total_returns"),
                 F.sum("total_amount").alias("return_loss"))
            .orderBy(F.desc("return_loss"), F.desc("total_returns"), "customer_id")
            .limit(k))


def top_value_customers(orders: DataFrame, k: int = 10) -> DataFrame:
    return (orders.groupBy("customer_id")
            .agg(m.order_count().alias("total_orders"),
                 F.sum("total_amount").alias("lifetime_value"))
            .orderBy(F.desc("lifetime_value"), "customer_id")
            .limit(k))


def customer_return_risk(order_returns: DataFrame, min_orders: int = 3,
                         high: float = segments.HIGH,
                         moderate: float = segments.MODERATE) -> DataFrame:
    """Risk by the rounded return rate; customers without returns are low risk."""
    return (order_returns.groupBy("customer_id")
            .agg(m.order_count().alias("total_orders"),
                 F.sum("total_amount").alias("lifetime_value"),
                 m.return_count().alias("return_count"),
                 m.loss().alias("return_loss"))
            .filter(F.col("total_orders") >= min_orders)
            .withColumn("return_rate", m.rate(F.col("return_count"), F.col("total_orders")))
            .withColumn("behavior_segment",
                        segments.risk(F.col("return_rate"), high, moderate,
                                      segments.RETURN_RISK_LABELS)))


def customer_return_rate_all(customers: DataFrame, order_returns: DataFrame) -> DataFrame:
    """Every customer, with a NULL rate for those who never ordered.

    Orders are reduced to one row per customer before the join.
    """
    activity = (order_returns.groupBy("customer_id")
                .agg(m.order_count().alias("n_orders"), m.return_count().alias("n_returns")))
    return (customers.select("customer_id").join(activity, "customer_id", "left")
            .select("customer_id",
                    F.coalesce("n_orders", F.lit(0)).alias("total_orders"),
                    F.coalesce("n_returns", F.lit(0)).alias("total_returns"),
                    m.percent(F.col("n_returns"), F.col("n_orders")).alias("return_rate_pct")))
