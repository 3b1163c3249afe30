"""Product revenue, return risk and revenue leakage."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backhaul.functions import metrics as m
from backhaul.functions import segments
from backhaul.operators.facts import categorised
from backhaul.plans.global_order import with_global_order
from backhaul.plans.shared import stored
from backhaul.plans.totals import grand_total


def product_summary(facts: DataFrame) -> DataFrame:
    return (categorised(facts).groupBy("product_id", "category")
            .agg(m.order_count().alias("total_orders"),
                 m.return_count().alias("return_orders"),
                 F.sum("total_amount").alias("gross_revenue"),
                 m.loss().alias("return_loss")))


def top_revenue_products(facts: DataFrame, k: int = 10) -> DataFrame:
    return (product_summary(facts)
            .select("product_id", "category", "total_orders", "gross_revenue")
            .orderBy(F.desc("gross_revenue"), "product_id")
            .limit(k))


def top_returned_products(facts: DataFrame, k: int = 10) -> DataFrame:
    """Products without returns stay eligible."""
    return (product_summary(facts)
            .select("product_id", "category", "return_orders", "return_loss")
            .orderBy(F.desc("return_orders"), F.desc("return_loss"), "product_id")
            .limit(k))


def product_return_risk(facts: DataFrame, min_orders: int = 3,
                        high: float = segments.HIGH,
                        moderate: float = segments.MODERATE) -> DataFrame:
    """Risk by the unrounded return rate."""
    return risk_of(product_summary(facts), min_orders, high, moderate)


def risk_of(summary: DataFrame, min_orders: int = 3, high: float = segments.HIGH,
            moderate: float = segments.MODERATE) -> DataFrame:
    """``product_return_risk`` of a ``product_summary``."""
    returns, orders = F.col("return_orders"), F.col("total_orders")
    return (summary
            .filter(orders >= min_orders)
            .withColumn("return_rate", m.rate(returns, orders))
            .withColumn("loss_rate", m.rate(F.col("return_loss"), F.col("gross_revenue")))
            .withColumn("risk_level", segments.risk(m.quotient(returns, orders), high, moderate)))


def full_return_products(facts: DataFrame, min_orders: int = 3) -> DataFrame:
    """Products whose every order came back, from a minimum sample up."""
    return (product_return_risk(facts, min_orders)
            .filter(F.col("return_orders") == F.col("total_orders")))


def product_leakage_rank(facts: DataFrame, min_orders: int = 3, k: int = 10) -> DataFrame:
    """The ``k`` largest losses with their rank among all eligible products.

    A rank depends only on the rows ahead, and those are all among the top ``k``, so the
    window sees ``k`` rows instead of every product.
    """
    return leakage_of(product_summary(facts), min_orders, k)


def leakage_of(summary: DataFrame, min_orders: int = 3, k: int = 10) -> DataFrame:
    """``product_leakage_rank`` of a ``product_summary``."""
    worst = (summary
             .filter(F.col("total_orders") >= min_orders)
             .orderBy(F.desc("return_loss"), "product_id")
             .limit(k))
    return worst.select(
        "product_id", "category", "total_orders", "gross_revenue", "return_orders", "return_loss",
        m.rate(F.col("return_loss"), F.col("gross_revenue")).alias("loss_rate"),
        F.rank().over(Window.orderBy(F.desc("return_loss"))).alias("loss_rank"),
    )


def product_loss_share(order_returns: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every product's loss, its global rank and its share of the total loss in percent.

    The loss per product is stored; ordering reads that and not the orders again.
    """
    losses = stored(order_returns.groupBy("product_id")
                    .agg(F.sum(F.when(F.col("returned"), F.col("total_amount"))
                               .otherwise(F.lit(0))).alias("return_loss")), "product-losses")
    ranked = with_global_order(losses, "return_loss", "product_id", rank="loss_rank",
                               buckets=buckets)
    return (ranked.withColumn("total_loss", grand_total(losses, "return_loss"))
            .select("product_id", "return_loss", "loss_rank", "total_loss",
                    m.quotient(F.col("return_loss").cast("double") * 100.0, F.col("total_loss"))
                    .alias("pct_of_total")))
