"""Cumulative distribution of return loss over products."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul.functions import metrics as m
from backhaul.operators.products import product_summary
from backhaul.plans.global_order import with_global_order
from backhaul.plans.shared import stored
from backhaul.plans.totals import grand_total


def pareto_loss(facts: DataFrame, buckets: int | None = None) -> DataFrame:
    """Products with a loss and the loss accumulated from the largest down.

    The summary per product is stored; ordering reads that and not the facts again.
    """
    return _cumulated(stored(_losses(product_summary(facts)), "product-losses"), buckets)


def _losses(summary: DataFrame) -> DataFrame:
    return (summary.select("product_id", "category", F.col("return_loss").alias("total_loss"))
            .filter(F.col("total_loss") > 0))


def pareto_of(summary: DataFrame, buckets: int | None = None) -> DataFrame:
    """``pareto_loss`` of a stored ``product_summary``."""
    return _cumulated(_losses(summary), buckets)


def _cumulated(losses: DataFrame, buckets: int | None) -> DataFrame:
    running = with_global_order(losses, "total_loss", "product_id",
                                running_total="cumulative_loss", buckets=buckets)
    return (running.withColumn("_all", grand_total(losses, "total_loss"))
            .select("product_id", "category", "total_loss", "cumulative_loss",
                    m.percent(F.col("cumulative_loss"), F.col("_all")).alias("cumulative_pct")))
