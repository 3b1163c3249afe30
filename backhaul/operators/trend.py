"""Monthly performance and recurring category / SKU monitoring."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul.functions import metrics as m
from backhaul.operators.facts import categorised


def monthly_trend(order_returns: DataFrame) -> DataFrame:
    """Per calendar month of the order; months without orders have no row."""
    gross = F.sum("total_amount")
    return (order_returns.groupBy(m.month_key("order_date").alias("month"))
            .agg(m.order_count().alias("total_orders"),
                 m.return_count().alias("returned_orders"),
                 gross.alias("gross_revenue"),
                 m.loss().alias("return_loss"),
                 (gross - m.loss()).alias("net_revenue"),
                 m.rate(m.return_count(), m.order_count()).alias("return_rate")))


def sku_month_monitor(facts: DataFrame, alert_rate: float = 0.25,
                      min_orders: int = 3) -> DataFrame:
    """Monthly return rate and loss per category and per SKU, with an alert flag.

    Category rows are rolled up from the SKU rows, so the orders are scanned and shuffled
    once. Their ``product_id`` is NULL.
    """
    skus = (categorised(facts)
            .groupBy(m.month_key("order_date").alias("month"), "category", "product_id")
            .agg(m.order_count().alias("total_orders"),
                 m.return_count().alias("returned_orders"),
                 F.sum("total_amount").alias("gross_revenue"),
                 m.loss().alias("return_loss")))
    measures = ["total_orders", "returned_orders", "gross_revenue", "return_loss"]
    categories = (skus.groupBy("month", "category")
                  .agg(*[F.sum(c).alias(c) for c in measures]))
    levels = (skus.withColumn("level", F.lit("sku"))
              .unionByName(categories.withColumn("level", F.lit("category")),
                           allowMissingColumns=True))
    rate = m.rate(F.col("returned_orders"), F.col("total_orders"))
    return levels.select(
        "level", "month", "category", "product_id", *measures,
        rate.alias("return_rate"),
        m.rate(F.col("return_loss"), F.col("gross_revenue")).alias("loss_rate"),
        F.coalesce((F.col("total_orders") >= min_orders) & (rate >= alert_rate), F.lit(False))
         .alias("alert"),
    )
