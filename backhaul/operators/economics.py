"""The full cost of returns: revenue, margin and shipping."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backhaul.functions import metrics as m
from backhaul.operators.facts import categorised, returned_only
from backhaul.plans.totals import total_of_few

# Margin bands in report order.
MARGIN_BANDS = ("Negative Margin", "Zero Margin", "Low Margin (0–10)", "Mid Margin (10–50)",
                "High Margin (50+)")


def _losses() -> list[Column]:
    """An order with any part missing is left out of the economic total only."""
    return [
        F.sum("total_amount").alias("revenue_loss"),
        F.sum("profit_margin").alias("margin_loss"),
        F.sum("shipping_cost").alias("shipping_loss"),
        F.sum("economic").alias("total_economic_loss"),
    ]


def _costed(facts: DataFrame) -> DataFrame:
    return returned_only(facts).withColumn("economic", m.economic_value())


def true_cost(order_returns: DataFrame) -> DataFrame:
    return _costed(order_returns).agg(
        m.order_count().alias("total_returns"),
        *_losses(),
        m.mean("total_amount").alias("avg_revenue_loss_per_return"),
        m.mean("economic").alias("avg_economic_loss_per_return"),
    )


def _category_costs(facts: DataFrame) -> DataFrame:
    hidden = F.col("margin_loss") + F.col("shipping_loss")
    costs = (_costed(categorised(facts)).groupBy("category")
             .agg(m.order_count().alias("return_count"), *_losses(),
                  m.mean("profit_margin").alias("avg_margin_per_return")))
    # One row per category from here on.
    by_economic = Window.orderBy(F.desc("total_economic_loss"))
    by_revenue = Window.orderBy(F.desc("revenue_loss"))
    return (costs
            .withColumn("hidden_ratio", m.quotient(hidden.cast("double") * 100.0,
                                                   F.col("total_economic_loss")))
            .withColumn("economic_loss_rank", F.rank().over(by_economic))
            .withColumn("revenue_loss_rank", F.rank().over(by_revenue)))


def category_true_cost(facts: DataFrame) -> DataFrame:
    """Cost per category, ranked by economic and by revenue loss."""
    return _category_costs(facts).select(
        "category", "return_count", "revenue_loss", "margin_loss", "shipping_loss",
        "total_economic_loss", "avg_margin_per_return",
        F.round("hidden_ratio", 2).alias("hidden_cost_pct"),
        "economic_loss_rank", "revenue_loss_rank",
    )


def category_true_cost_raw(facts: DataFrame) -> DataFrame:
    """The same from unrounded sums, without the average margin."""
    return _category_costs(facts).select(
        "category", "return_count", "revenue_loss", "margin_loss", "shipping_loss",
        "total_economic_loss", F.round("hidden_ratio", 2).alias("hidden_cost_pct"),
        "economic_loss_rank", "revenue_loss_rank",
    )


def margin_band(margin: Column) -> Column:
    """Bands with inclusive upper bounds; a NULL margin falls in the last band."""
    negative, zero, low, mid, high = MARGIN_BANDS
    return (F.when(margin < 0, negative).when(margin == 0, zero)
            .when(margin <= 10, low).when(margin <= 50, mid).otherwise(high))


def margin_bands(order_returns: DataFrame) -> DataFrame:
    bands = (_costed(order_returns)
             .groupBy(margin_band(F.col("profit_margin")).alias("margin_band"))
             .agg(F.count(F.lit(1)).alias("return_count"), *_losses(),
                  m.mean("total_amount").alias("avg_order_value")))
    report_order = F.array_position(F.array(*map(F.lit, MARGIN_BANDS)), F.col("margin_band"))
    return (bands
            .select("margin_band", "return_count",
                    m.percent(F.col("return_count"), total_of_few("return_count"))
                    .alias("pct_of_returns"),
                    "revenue_loss", "margin_loss", "shipping_loss", "total_economic_loss",
                    "avg_order_value")
            .orderBy(report_order))


def margin_adjusted_rate(facts: DataFrame) -> DataFrame:
    """Return rate per category by orders, by revenue and by margin."""
    return (categorised(facts).groupBy("category")
            .agg(m.order_count().alias("total_orders"),
                 m.return_count().alias("returned_orders"),
                 F.sum("total_amount").alias("gross_revenue"),
                 F.sum("profit_margin").alias("gross_margin"),
                 m.loss().alias("revenue_loss"),
                 m.zero_if_null(m.returned_sum("profit_margin")).alias("margin_loss"),
                 m.zero_if_null(m.returned_sum("shipping_cost")).alias("shipping_loss"))
            .withColumn("order_return_rate",
                        m.rate(F.col("returned_orders"), F.col("total_orders")))
            .withColumn("revenue_return_rate",
                        m.rate(F.col("revenue_loss"), F.col("gross_revenue")))
            .withColumn("margin_return_rate",
                        m.rate(F.col("margin_loss"), F.col("gross_margin"))))


def top_economic_losses(facts: DataFrame, k: int = 20) -> DataFrame:
    """The costliest returned orders among those sold at a profit."""
    return (returned_only(categorised(facts))
            .filter(F.col("profit_margin") > 0)
            .select("order_id", "customer_id", "category", "return_reason", "total_amount",
                    "profit_margin", "shipping_cost",
                    m.economic_value().alias("total_economic_loss"),
                    "order_date", "request_date")
            .orderBy(F.desc_nulls_last("total_economic_loss"), "order_id")
            .limit(k))
