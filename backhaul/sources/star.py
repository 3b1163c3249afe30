"""Builds the wide staging table from a star schema of order lines.

Every order line becomes one staging row. Line numbers repeat within an order, so the
resulting order ids are duplicated the way raw order exports are; categories and return
flags conflict between duplicates too. Catalyst chooses the join strategies from file and
runtime sizes; nothing is hinted.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backhaul.schemas import INGEST_SEQ, MONEY, ORDER_GROUP

# Reason per supplier remainder; the last one is outside the known reasons.
REASONS = ("Defective", "Not as described", "Missing/Wrong item", "No longer needed",
           "Slow delivery", "Other")


#: Parts (a key, a type and a price each) that are sent to every task instead of moving the lines.
MOST_PARTS = 2_000_000
#: Lines that one group of orders should hold.
LINES_PER_GROUP = 500_000


def group_count(spark: SparkSession, directory: str) -> int:
    """Groups to deal the staging rows into: one per task at least; lines are counted from footers."""
    lines = spark.read.parquet(f"{directory}/lineitem.parquet").count()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines // LINES_PER_GROUP))


def read_staging(spark: SparkSession, directory: str, groups: int | None = None) -> DataFrame:
    """One row per order line; with ``groups``, dealt into so many by order, which is named in
    ``ORDER_GROUP``."""
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{directory}/{name}.parquet")

    geography = (table("nation")
                 .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                 .select("n_nationkey", "r_name"))
    buyers = (table("customer")
              .join(geography, F.col("c_nationkey") == F.col("n_nationkey"))
              .select("c_custkey", "r_name"))
    # orders get their buyer while they are short; the lines, the widest rows, are moved for orders,
    # which brings copies of an order id together, and for parts first unless those are few
    placed = table("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    of_part, of_order = F.col("l_partkey") == F.col("p_partkey"), F.col("l_orderkey") == F.col(
        "o_orderkey")
    parts = table("part")
    if not groups:
        rows = table("lineitem").join(parts, of_part).join(placed, of_order)
    elif parts.count() <= MOST_PARTS:
        rows = (table("lineitem").repartition(groups, "l_orderkey").join(placed, of_order)
                .join(F.broadcast(parts.select("p_partkey", "p_type", "p_retailprice")), of_part))
    else:
        rows = (table("lineitem").join(parts, of_part).repartition(groups, "l_orderkey")
                .join(placed, of_order))
    return rows.select(*_staging_columns(),
                       *([F.col("l_orderkey").alias(ORDER_GROUP)] if groups else []))


def _staging_columns() -> list[Column]:
    unit_price = F.col("p_retailprice").cast(MONEY)
    discount = F.col("l_discount").cast("decimal(4,2)")
    extended = F.col("l_extendedprice").cast(MONEY)
    hundredth = F.lit("0.01").cast("decimal(4,2)")
    thousandth = F.lit("0.001").cast("decimal(4,3)")
    one = F.lit(1).cast("decimal(4,2)")

    amount = F.round(extended * (one - discount) * hundredth, 2)
    margin = F.round(
        (extended - F.col("l_quantity").cast("decimal(6,0)")
         * F.col("p_retailprice").cast("decimal(8,2)")) * thousandth, 2)

    habit = F.col("o_custkey") % 20
    flag = F.col("l_returnflag")
    came_back = (
        ((habit == 0) & flag.isin("R", "A"))
        | (habit.between(1, 6) & (flag == "R"))
        | (habit.between(7, 12) & (flag == "R") & (F.col("l_linenumber") <= 2))
    )
    reason = F.element_at(F.array(*map(F.lit, REASONS)),
                          (F.col("l_suppkey") % 6 + 1).cast("int"))
    shipped = F.col("l_shipdate").cast("date")

    def text(day: Column) -> Column:
        return F.date_format(day, "d/M/yyyy")

    return [
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("order_id"),
        F.concat(F.lit("C"), "o_custkey").alias("customer_id"),
        F.concat(F.lit("P"), F.concat_ws("-", "l_partkey", "l_suppkey")).alias("product_id"),
        F.when(F.col("l_orderkey") % 10 == 0, F.lit("PROMO"))
         .otherwise(F.col("p_type")).alias("category"),
        unit_price.alias("price"),
        discount.alias("discount"),
        (F.col("o_custkey") % 60 + 18).cast("int").alias("customer_age"),
        F.when(F.col("o_custkey") % 2 == 0, "Female").otherwise("Male").alias("customer_gender"),
        text(F.col("o_orderdate").cast("date")).alias("order_date"),
        F.when(F.col("l_linestatus") == "F", text(shipped)).alias("delivered_date"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("o_orderpriority").alias("payment_method"),
        F.col("r_name").alias("region"),
        amount.cast(MONEY).alias("total_amount"),
        F.when(F.col("l_partkey") % 50 != 0,
               (F.col("l_linenumber") + 2).cast(MONEY)).alias("shipping_cost"),
        F.when(F.col("l_partkey") % 25 == 1, F.lit(0)).otherwise(margin)
         .cast(MONEY).alias("profit_margin"),
        F.when(came_back, "Yes").otherwise("No").alias("returned"),
        text(F.date_add(shipped, F.col("l_linenumber"))).alias("request_date"),
        reason.alias("return_reason"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
         .alias(INGEST_SEQ),
    ]
