"""How duplicate rows inflate a joined sum."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul.functions import metrics as m
from backhaul.operators.load import RETURNED


def _copies(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))


def fanout_inflated_loss(orders: DataFrame, staging: DataFrame) -> DataFrame:
    """Loss as the naive join to raw rows gives it: each duplicate counts again.

    Counting copies per order and multiplying equals the join's sum without producing its
    rows, however often an order is repeated.
    """
    copies = _copies(staging.filter(F.col("returned") == RETURNED), "order_id")
    return (orders.select("order_id", "total_amount").join(copies, "order_id")
            .agg(F.sum(F.col("total_amount") * F.col("copies")).alias("inflated_return_loss")))


def fanout_corrected_loss(orders: DataFrame, staging: DataFrame) -> DataFrame:
    returned = staging.filter(F.col("returned") == RETURNED).select("order_id").distinct()
    return (orders.join(returned, "order_id", "left_semi")
            .agg(F.sum("total_amount").alias("corrected_return_loss")))


def fanout_audit(left: DataFrame, right: DataFrame, key: str, measure: str) -> DataFrame:
    """Sum of ``measure`` joined once and joined per copy, and the worst multiplicity."""
    joined = left.select(key, measure).join(_copies(right, key), key)
    return (joined
            .agg(F.sum(F.col(measure) * F.col("copies")).alias("inflated_sum"),
                 F.sum(measure).alias("corrected_sum"),
                 F.max("copies").alias("max_copies"))
            .withColumn("inflation_rate",
                        m.rate(F.col("inflated_sum") - F.col("corrected_sum"),
                               F.col("corrected_sum"))))
