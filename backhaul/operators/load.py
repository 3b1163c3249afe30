"""Staging to customers, products, orders and returns."""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backhaul.schemas import (CUSTOMERS, INGEST_SEQ, ORDER_GROUP, ORDERS, PRODUCTS, RETURNS,
                              conform)

DATE_FORMAT = "d/M/yyyy"
RETURNED = "Yes"
#: Of a product: its staging rows do not all name the same category.
CONTESTED = "contested"


def parse_date(column: str) -> Column:
    """``5/1/2023`` or ``05/01/2023``; NULL for anything that is not a calendar date."""
    return F.try_to_date(F.col(column), DATE_FORMAT)


def first_per_order(rows: DataFrame) -> DataFrame:
    """First row of each order in load order.

    The rank filter lets Spark drop all but one row per order and task before the shuffle,
    so an order id repeated any number of times stays cheap.
    """
    return (rows.withColumn("_copy", F.row_number().over(load_order(rows)))
            .filter(F.col("_copy") == 1)
            .drop("_copy"))


def _grouped_by(rows: DataFrame) -> list[str]:
    return [ORDER_GROUP] if ORDER_GROUP in rows.columns else []


def load_order(rows: DataFrame) -> WindowSpec:
    """The rows of an order; those of a grouped staging table are together, so nothing moves."""
    return Window.partitionBy(*_grouped_by(rows), "order_id").orderBy(INGEST_SEQ)


def customers_dim(staging: DataFrame) -> DataFrame:
    """One row per customer; the largest value wins where copies disagree."""
    rows = (staging.groupBy("customer_id")
            .agg(F.max(F.col("customer_age").cast("int")).alias("customer_age"),
                 F.max("customer_gender").alias("customer_gender")))
    return conform(rows, CUSTOMERS)


def _product_candidates(staging: DataFrame) -> DataFrame:
    """One row per product with its modal category (ties: alphabetically first) or NULL.

    Counting per (product, category) first spreads a hot product over its categories and
    leaves only one row per pair for the second step.
    """
    votes = (staging.groupBy("product_id", "category")
             .agg(F.count(F.lit(1)).alias("votes"),
                  F.max("price").alias("price"),
                  F.max("discount").alias("discount")))
    best = F.min(F.when(F.col("category").isNotNull(),
                        F.struct((-F.col("votes")).alias("rank"), F.col("category"))))
    return (votes.groupBy("product_id")
            .agg(best["category"].alias("category"),
                 F.max("price").alias("price"),
                 F.max("discount").alias("discount"),
                 (F.count(F.lit(1)) > 1).alias(CONTESTED)))


def products_dim(staging: DataFrame) -> DataFrame:
    """One row per product that has at least one category."""
    return marked_products(staging).drop(CONTESTED)


def marked_products(staging: DataFrame) -> DataFrame:
    """``products_dim`` and whether a product's rows differ in their category, or leave it out."""
    rows = _product_candidates(staging).filter(F.col("category").isNotNull())
    return conform(rows, T.StructType([*PRODUCTS.fields, T.StructField(CONTESTED, T.BooleanType())]))


def products_quarantine(staging: DataFrame) -> DataFrame:
    """Products left out of ``products_dim`` because no row names a category."""
    return _product_candidates(staging).filter(F.col("category").isNull()).drop(CONTESTED)


def category_conflicts(staging: DataFrame) -> DataFrame:
    """Products listed under more than one category, with the sorted category names."""
    pairs = (staging.filter(F.col("category").isNotNull())
             .select("product_id", "category").distinct())
    return (pairs.groupBy("product_id")
            .agg(F.count("category").alias("unique_category_count"),
                 F.array_join(F.array_sort(F.collect_list("category")), ",")
                 .alias("categories_seen"))
            .filter(F.col("unique_category_count") > 1))


def orders_dedup(staging: DataFrame) -> DataFrame:
    """Staging rows that survive deduplication, dates still as text."""
    return first_per_order(staging).drop(ORDER_GROUP)


def orders_clean(staging: DataFrame) -> DataFrame:
    return conform(_first_orders(staging), ORDERS)


def orders_with_own_category(staging: DataFrame) -> DataFrame:
    """``orders_clean`` with the category that the order's first row names."""
    category = T.StructField("category", T.StringType())
    return conform(_first_orders(staging, "category"), T.StructType([*ORDERS.fields, category]))


def _first_orders(staging: DataFrame, *more: str) -> DataFrame:
    return first_per_order(_order_rows(staging, *more))


def _order_rows(staging: DataFrame, *more: str) -> DataFrame:
    # dates are shorter to move than their texts
    dates = {c: parse_date(c) for c in ("order_date", "delivered_date")}
    return staging.select(
        *[dates[f.name].alias(f.name) if f.name in dates else f.name for f in ORDERS], *more,
        *_grouped_by(staging), INGEST_SEQ)


def orders_with_return(staging: DataFrame) -> DataFrame:
    """``facts.order_returns`` of ``orders_with_own_category`` with ``returns_clean``, in one pass.

    All rows of an order meet in its window, so this is for grouped staging, where they are
    together without a shuffle.
    """
    order = load_order(staging)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a join would not match an order without id
    confirmed = F.when((F.col("returned") == RETURNED) & F.col("order_id").isNotNull(),
                       F.struct("request_date", "return_reason"))
    rows = (_order_rows(staging, "category", "returned", "request_date", "return_reason")
            .withColumn("_return", F.first(confirmed, ignorenulls=True).over(whole))
            .withColumn("_copy", F.row_number().over(order))
            .filter(F.col("_copy") == 1))
    orders = [rows[f.name].cast(f.dataType).alias(f.name) for f in ORDERS]
    day = F.try_to_date(F.col("_return.request_date"), DATE_FORMAT)
    return rows.select(*orders, "category", day.alias("request_date"),
                       F.col("_return.return_reason").alias("return_reason"),
                       F.col("_return").isNotNull().alias("returned"))


def returns_clean(staging: DataFrame) -> DataFrame:
    """One return per order with at least one ``Yes`` row, described by the first such row.

    Filtering comes before deduplication on purpose: an order whose first row says ``No``
    still counts as returned, while its amounts come from that first row. ``return_id`` is a
    128-bit digest of the order id, so it needs no global counter, survives reloads and does
    not collide.
    """
    rows = (staging.filter(F.col("returned") == RETURNED)
            .select("order_id", "request_date", "return_reason", *_grouped_by(staging), INGEST_SEQ))
    rows = (first_per_order(rows)
            .withColumn("request_date", parse_date("request_date"))
            .withColumn("return_id", F.md5("order_id")))
    return conform(rows, RETURNS)


def unparsed_dates(staging: DataFrame) -> DataFrame:
    """How many non-empty date texts are not calendar dates, per column."""
    counts = [
        F.count_if(F.col(c).isNotNull() & (F.trim(c) != "") & parse_date(c).isNull()).alias(c)
        for c in ("order_date", "delivered_date", "request_date")
    ]
    return staging.agg(*counts)


def dedup_report(staging: DataFrame, orders: DataFrame, returns: DataFrame) -> DataFrame:
    """Rows, distinct ids and repeated ids before and after cleaning."""

    def layer(name: str, rows: DataFrame) -> DataFrame:
        per_id = rows.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
        return per_id.agg(
            F.lit(name).alias("layer"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.count("order_id").alias("distinct_order_ids"),
            F.count_if(F.col("n") > 1).alias("repeated_order_ids"),
        )

    confirmed = staging.filter(F.col("returned") == RETURNED)
    return (layer("staging", staging)
            .unionByName(layer("orders", orders))
            .unionByName(layer("staging returned", confirmed))
            .unionByName(layer("returns", returns)))
