"""Category revenue, return rate and loss."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul.functions import metrics as m
from backhaul.operators.facts import categorised, returned_only


def category_revenue(facts: DataFrame) -> DataFrame:
    return (categorised(facts).groupBy("category")
            .agg(m.order_count().alias("total_orders"),
                 F.sum("total_amount").alias("total_revenue")))


def category_return_rate(facts: DataFrame) -> DataFrame:
    return (categorised(facts).groupBy("category")
            .agg(m.order_count().alias("total_orders"),
                 m.return_count().alias("return_orders"),
                 m.rate(m.return_count(), m.order_count()).alias("return_rate")))


def category_return_impact(facts: DataFrame) -> DataFrame:
    """Returned orders only: a category without returns has no row."""
    return (returned_only(categorised(facts)).groupBy("category")
            .agg(m.order_count().alias("return_orders"),
                 F.sum("total_amount").alias("return_loss")))


def category_summary(facts: DataFrame) -> DataFrame:
    return (categorised(facts).groupBy("category")
            .agg(m.order_count().alias("total_orders"),
                 m.return_count().alias("return_orders"),
                 F.sum("total_amount").alias("gross_revenue"),
                 m.loss().alias("return_loss"))
            .withColumn("return_rate", m.rate(F.col("return_orders"), F.col("total_orders")))
            .withColumn("loss_rate", m.rate(F.col("return_loss"), F.col("gross_revenue"))))


def category_loss_raw(facts: DataFrame) -> DataFrame:
    """Gross revenue and loss only; the loss is NULL where nothing came back."""
    return (categorised(facts).groupBy("category")
            .agg(F.sum("total_amount").alias("gross_revenue"),
                 m.returned_sum().alias("return_loss")))
