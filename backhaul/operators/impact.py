"""Customers by return behaviour and by financial impact."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul.functions import metrics as m
from backhaul.functions import segments
from backhaul.operators.load import RETURNED
from backhaul.plans.global_order import with_tile
from backhaul.plans.shared import stored
from backhaul.plans.totals import total_of_few

TILES = 5


def _classify(customers: DataFrame, min_orders: int, buckets: int | None) -> DataFrame:
    """Adds both segments; the quintile is taken over customers with enough orders.

    The summary per customer is stored; the quintile reads that and not the orders again.
    """
    customers = stored(customers, "customers")
    population = customers.filter(F.col("total_orders") >= min_orders)
    tiled = with_tile(customers, population, "return_loss", "customer_id", TILES, "_tile",
                      buckets)
    returns = F.col("total_returns")
    return tiled.select(
        "customer_id", "total_orders", "total_returns", "total_revenue", "return_loss",
        "return_rate",
        segments.behavior(F.col("return_rate"), returns).alias("behavior_segment"),
        F.when(returns == 0, "No Impact").when(F.col("_tile") == 1, "High Impact")
         .otherwise("Low Impact").alias("impact_segment"),
    )


def customer_impact_staging(staging: DataFrame, min_orders: int = 3,
                            buckets: int | None = None) -> DataFrame:
    """Segments straight from staging, duplicates included.

    Customers with returns need ``min_orders``; customers without returns always appear.
    The quintile covers both kinds, so it is fixed before rows are dropped.
    """
    came_back = F.col("returned") == RETURNED
    customers = (
        staging.groupBy("customer_id")
        .agg(m.order_count().alias("total_orders"),
             F.count_if(came_back).alias("total_returns"),
             F.sum("total_amount").alias("total_revenue"),
             F.sum(F.when(came_back, F.col("total_amount")).otherwise(F.lit(0)))
             .alias("return_loss"))
        .withColumn("return_rate", m.rate(F.col("total_returns"), F.col("total_orders")))
    )
    reported = (F.col("total_returns") == 0) | (F.col("total_orders") >= min_orders)
    return _classify(customers, min_orders, buckets).filter(reported)


def customer_impact(order_returns: DataFrame, min_orders: int = 3,
                    buckets: int | None = None) -> DataFrame:
    """Segments on clean orders; every reported customer has at least ``min_orders``."""
    customers = (
        order_returns.groupBy("customer_id")
        .agg(m.order_count().alias("total_orders"),
             m.return_count().alias("total_returns"),
             F.sum("total_amount").alias("total_revenue"),
             m.loss().alias("return_loss"))
        .filter(F.col("total_orders") >= min_orders)
        .withColumn("return_rate", m.rate(F.col("total_returns"), F.col("total_orders")))
    )
    return _classify(customers, min_orders, buckets)


def segment_summary(impact: DataFrame) -> DataFrame:
    """Customers, revenue and loss per behaviour segment; shares are of the segments' loss.

    The average rate is the mean of the customers' rates. They have 4 decimals, so summing
    them as decimals keeps the result independent of row order.
    """
    segments_ = (impact.groupBy("behavior_segment")
                 .agg(F.count(F.lit(1)).alias("customers"),
                      F.sum(F.col("return_rate").cast("decimal(10,4)")).alias("_rates"),
                      F.count("return_rate").alias("_rated"),
                      F.sum("total_revenue").alias("total_revenue"),
                      F.sum("return_loss").alias("return_loss")))
    return segments_.select(
        "behavior_segment", "customers",
        m.percent(F.col("_rates"), F.col("_rated")).alias("avg_return_rate_pct"),
        "total_revenue", "return_loss",
        m.percent(F.col("return_loss"), total_of_few("return_loss"))
         .alias("loss_share_pct"),
        F.round(m.quotient(F.col("return_loss"), F.col("customers")), 2)
         .alias("avg_loss_per_customer"),
    )
