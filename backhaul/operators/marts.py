"""Tables handed to reporting tools, grouped by report page."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backhaul.functions import metrics as m
from backhaul.operators import (categories, cohorts, customers, economics, impact, pareto,
                                products, reasons, revenue, trend)
from backhaul.plans.shared import stored
from backhaul.warehouse import Warehouse


def result_tables(w: Warehouse, segmented: DataFrame, sold: DataFrame
                  ) -> dict[str, dict[str, DataFrame]]:
    """Results by page; ``segmented`` is the stored customer impact and ``sold`` the stored product
    summary that others build on."""
    return {
        "revenue": {
            "net_revenue": revenue.net_revenue(w.order_returns),
            "return_rate": revenue.return_rate(w.order_returns),
            "monthly_trend": trend.monthly_trend(w.order_returns),
            "true_cost": economics.true_cost(w.order_returns),
        },
        "customers": {
            "segment_summary": impact.segment_summary(segmented),
            "top_value_customers": customers.top_value_customers(w.orders),
            "cohort_retention": cohorts.cohort_retention(w.orders),
        },
        "products": {
            "product_return_risk": products.risk_of(sold),
            "product_leakage_rank": products.leakage_of(sold),
            "pareto_loss": pareto.pareto_of(sold),
        },
        "categories": {
            "category_summary": categories.category_summary(w.order_facts),
            "category_true_cost": economics.category_true_cost(w.order_facts),
            "reason_by_category": reasons.reason_by_category(w.order_facts),
        },
    }


def write_marts(w: Warehouse, path: str) -> None:
    """Writes the normalised tables and the result tables as Parquet, replacing old ones.

    Orders are stored by month. The facts of a stored warehouse are by month already, so a task has
    few months. Else the rebalance hint gathers a month's rows in as few files as their size needs
    and splits a month that is too large for one.
    """
    for name, rows in {"customers": w.customers, "products": w.products,
                       "returns": w.returns}.items():
        rows.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    orders = w.orders.withColumn("order_month", m.month_key("order_date"))
    if w.path is None:
        orders = orders.hint("rebalance", "order_month")
    (orders.write.mode("overwrite").partitionBy("order_month").parquet(f"{path}/tables/orders"))
    spark = w.staging.sparkSession
    impact_path = f"{path}/customers/customer_impact"
    impact.customer_impact(w.order_returns).write.mode("overwrite").parquet(impact_path)
    sold = stored(products.product_summary(w.order_facts), "product-summary")
    for page, tables in result_tables(w, spark.read.parquet(impact_path), sold).items():
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{path}/{page}/{name}")


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file for a report-sized result."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


# Report pages and the results on them.
PAGES = {
    "revenue": ["net_revenue", "return_rate", "monthly_trend", "true_cost"],
    "customers": ["customer_impact", "segment_summary", "top_value_customers",
                  "cohort_retention"],
    "products": ["product_return_risk", "product_leakage_rank", "pareto_loss"],
    "categories": ["category_summary", "category_true_cost", "reason_by_category"],
}


def mart_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Stored row count per mart."""
    folders = [("tables", name) for name in ("customers", "products", "orders", "returns")]
    folders += [(page, name) for page, names in PAGES.items() for name in names]
    manifest = None
    for page, name in folders:
        counted = spark.read.parquet(f"{path}/{page}/{name}").agg(
            F.lit(page).alias("page"), F.lit(name).alias("mart"),
            F.count(F.lit(1)).alias("row_count"))
        manifest = counted if manifest is None else manifest.unionByName(counted)
    return manifest
