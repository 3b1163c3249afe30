"""Why orders come back: by reason, category, region and customer segment."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backhaul.functions import metrics as m
from backhaul.functions import segments
from backhaul.operators.facts import categorised, returned_only
from backhaul.plans.totals import total_of_few

# The team and step recommended for each known reason.
ACTIONS = {
    "Defective":
        "Product / QA team — investigate manufacturing or supplier defects",
    "Not as described":
        "Content team — improve product descriptions, images, and sizing guides",
    "Missing/Wrong item":
        "Fulfilment / Ops team — audit pick-pack accuracy and shipping labels",
    "No longer needed":
        "Policy / CRM team — review return window length and return-rate customer flags",
    "Slow delivery":
        "Logistics team — review carrier SLAs and delivery estimates shown at checkout",
}
UNKNOWN_ACTION = "Unclassified — review manually"


def _by_reason(order_returns: DataFrame, *keys: str) -> DataFrame:
    return (returned_only(order_returns).groupBy(*keys, "return_reason")
            .agg(F.count(F.lit(1)).alias("return_count"),
                 F.sum("total_amount").alias("return_loss")))


def _with_share(grouped: DataFrame, key: str, share: str) -> DataFrame:
    within = F.sum("return_count").over(Window.partitionBy(key))
    return grouped.withColumn(share, m.percent(F.col("return_count"), within))


def reason_summary(order_returns: DataFrame) -> DataFrame:
    reasons = (returned_only(order_returns).groupBy("return_reason")
               .agg(F.count(F.lit(1)).alias("return_count"),
                    F.sum("total_amount").alias("return_loss"),
                    m.mean("total_amount").alias("avg_order_value")))
    return reasons.select(
        "return_reason", "return_count",
        m.percent(F.col("return_count"), total_of_few("return_count"))
         .alias("pct_of_returns"),
        "return_loss",
        m.percent(F.col("return_loss"), total_of_few("return_loss")).alias("pct_of_loss"),
        "avg_order_value",
    )


def reason_by_category(facts: DataFrame) -> DataFrame:
    return _with_share(_by_reason(categorised(facts), "category"),
                       "category", "pct_within_category")


def reason_by_region(order_returns: DataFrame) -> DataFrame:
    return _with_share(_by_reason(order_returns, "region"), "region", "pct_within_region")


def dominant_reason(facts: DataFrame) -> DataFrame:
    """The reason with the largest loss per category; ties give several rows."""
    by_loss = Window.partitionBy("category").orderBy(F.desc("return_loss"))
    return (_by_reason(categorised(facts), "category")
            .withColumn("_rank", F.rank().over(by_loss))
            .filter(F.col("_rank") == 1)
            .select("category", F.col("return_reason").alias("dominant_reason"),
                    "return_count", "return_loss"))


def reason_by_segment(order_returns: DataFrame, min_orders: int = 3,
                      high: float = segments.HIGH,
                      moderate: float = segments.MODERATE) -> DataFrame:
    """Return reasons per behaviour segment of the customer.

    Returns are reduced to one row per customer and reason before they meet the customer's
    segment, so the join sees no more rows than that for any customer.
    """
    rate = m.rate(F.col("returns"), F.col("orders"))
    segmented = (order_returns.groupBy("customer_id")
                 .agg(m.order_count().alias("orders"), m.return_count().alias("returns"))
                 .filter(F.col("orders") >= min_orders)
                 .select("customer_id", segments.behavior(rate, F.col("returns"), high, moderate)
                         .alias("behavior_segment")))
    return (_by_reason(order_returns, "customer_id").join(segmented, "customer_id")
            .groupBy("behavior_segment", "return_reason")
            .agg(F.sum("return_count").alias("return_count"),
                 F.sum("return_loss").alias("return_loss")))


def moderate_reason_crosstab(order_returns: DataFrame, min_orders: int = 3,
                             segment: str = segments.RISK_LABELS[1]) -> DataFrame:
    """Reasons of one segment, by default the moderate one, with shares of its returns."""
    reasons = (reason_by_segment(order_returns, min_orders)
               .filter(F.col("behavior_segment") == segment))
    return reasons.select(
        "return_reason", "return_count", "return_loss",
        m.percent(F.col("return_count"), total_of_few("return_count"))
         .alias("pct_of_returns"),
        m.percent(F.col("return_loss"), total_of_few("return_loss")).alias("pct_of_loss"),
    )


def reason_actions(order_returns: DataFrame, actions: Mapping[str, str] = ACTIONS,
                   fallback: str = UNKNOWN_ACTION) -> DataFrame:
    """Who should act on each reason; unknown and missing reasons get ``fallback``."""
    lookup = F.create_map(*[F.lit(text) for pair in actions.items() for text in pair])
    return _by_reason(order_returns).withColumn(
        "recommended_action",
        F.coalesce(F.try_element_at(lookup, F.col("return_reason")), F.lit(fallback)))
