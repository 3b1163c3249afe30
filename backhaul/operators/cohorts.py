"""Cohorts by month of first order."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backhaul.functions import metrics as m


def _activity(order_returns: DataFrame, *measures) -> DataFrame:
    """One row per customer and active month, with the cohort month and the month offset.

    Orders collapse to customer months before the window, so a customer's group is bounded
    by the number of months however many orders they placed.
    """
    months = (order_returns
              .filter(F.col("customer_id").isNotNull() & F.col("order_date").isNotNull())
              .groupBy("customer_id", F.trunc("order_date", "month").alias("_month"))
              .agg(F.count(F.lit(1)).alias("_orders"), *measures))
    first = F.min("_month").over(Window.partitionBy("customer_id"))
    offset = ((F.year("_month") - F.year("_cohort")) * 12
              + F.month("_month") - F.month("_cohort"))
    return (months.withColumn("_cohort", first)
            .withColumn("months_since_first_order", offset)
            .withColumn("cohort_month", F.date_format("_cohort", "yyyy-MM-dd")))


def cohort_retention(orders: DataFrame) -> DataFrame:
    """Share of each cohort that ordered again, per month after the first (month 0 dropped).

    The cohort's size is its month-0 cell, so no second pass over the orders is needed.
    """
    grid = (_activity(orders).groupBy("cohort_month", "months_since_first_order")
            .agg(F.count(F.lit(1)).alias("active_customers")))
    at_start = F.when(F.col("months_since_first_order") == 0, F.col("active_customers"))
    sized = grid.withColumn("cohort_customers",
                            F.max(at_start).over(Window.partitionBy("cohort_month")))
    return (sized.filter(F.col("months_since_first_order") > 0)
            .select("cohort_month", "cohort_customers", "months_since_first_order",
                    "active_customers",
                    m.percent(F.col("active_customers"), F.col("cohort_customers"))
                    .alias("retention_rate_pct")))


def cohort_size(orders: DataFrame) -> DataFrame:
    first = (orders.filter(F.col("customer_id").isNotNull())
             .groupBy("customer_id").agg(F.min("order_date").alias("_first"))
             .filter(F.col("_first").isNotNull()))
    return (first.groupBy(F.date_format(F.trunc("_first", "month"), "yyyy-MM-dd")
                          .alias("cohort_month"))
            .agg(F.count(F.lit(1)).alias("new_customers_acquired")))


def cohort_return_rate(order_returns: DataFrame) -> DataFrame:
    """Orders, returns and loss over the cohort grid, month 0 included."""
    activity = _activity(order_returns, m.order_count().alias("orders"),
                         m.return_count().alias("returns"),
                         F.sum("total_amount").alias("amount"), m.loss().alias("loss"))
    return (activity.groupBy("cohort_month", "months_since_first_order")
            .agg(F.count(F.lit(1)).alias("active_customers"),
                 F.sum("orders").alias("total_orders"),
                 F.sum("returns").alias("returned_orders"),
                 F.sum("amount").alias("gross_revenue"),
                 F.sum("loss").alias("return_loss"))
            .withColumn("return_rate", m.rate(F.col("returned_orders"), F.col("total_orders")))
            .withColumn("loss_rate", m.rate(F.col("return_loss"), F.col("gross_revenue"))))
