"""Data-quality checks: one row each with ``check_result`` and the measured values."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backhaul.functions import metrics as m
from backhaul.operators.audit import DATES, LATE, audit
from backhaul.operators.constraints import orphan_count, repeated_keys
from backhaul.operators.load import orders_dedup, unparsed_dates
from backhaul.schemas import INGEST_SEQ
from backhaul.warehouse import Warehouse

PASS = "PASS"
INFO = "INFO"


@dataclass(frozen=True)
class Check:
    """``metrics`` are the reported columns of the one row that ``measure`` returns.

    A check without a ``passes`` condition only informs.
    """

    name: str
    metrics: tuple[str, ...]
    measure: Callable[[Warehouse], DataFrame]
    passes: Callable[[Callable[[str], Column]], Column] | None = None
    failure: str = ""

    def verdict(self, metric: Callable[[str], Column] = F.col) -> Column:
        """PASS, INFO or the text of the failure; ``metric`` gives a metric's column."""
        if self.passes is None:
            return F.lit(INFO)
        return F.when(self.passes(metric), F.lit(PASS)).otherwise(F.lit(self.failure))

    def run(self, warehouse: Warehouse) -> DataFrame:
        measured = self.measure(warehouse)
        if self.passes is None:
            return measured.select(*self.metrics)
        return measured.select(self.verdict().alias("check_result"), *self.metrics)


def _count(rows: DataFrame, name: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias(name))


def _profile(w: Warehouse) -> DataFrame:
    """Everything one pass over the orders and one over staging can tell, as a single row.

    Checks pick their columns and Catalyst drops the rest; the report takes them all at once.
    Sums over an empty table are NULL, which fails the checks that compare them with 0.
    """
    missing = [F.sum(F.col(c).isNull().cast("long")).alias(f"missing_{c}")
               for c in ("customer_id", "product_id", "order_date")]
    orders = w.orders.agg(
        F.count(F.lit(1)).alias("orders_count"),
        F.sum("total_amount").alias("orders_revenue"),
        F.count_if(F.col("delivered_date") < F.col("order_date"))
         .alias("invalid_delivery_date_count"),
        F.count_if(F.col("total_amount").isNull()).alias("null_amount_count"),
        *missing,
    )
    unparsed = unparsed_dates(w.staging)
    return orders.select(
        "*",
        w.staging.agg(F.count_distinct("order_id")).scalar().alias("staging_unique_orders"),
        w.staging.agg(F.sum("total_amount")).scalar().alias("staging_revenue"),
        *[unparsed.select(c).scalar().alias(f"unparsed_{c}") for c in unparsed.columns],
    ).withColumn("difference", F.abs(F.col("staging_revenue") - F.col("orders_revenue")))


def _deduplicated_revenue(w: Warehouse) -> DataFrame:
    total = F.sum("total_amount")
    first_rows = orders_dedup(w.staging.select("order_id", "total_amount", INGEST_SEQ))
    return (w.orders.agg(total.alias("orders_revenue"))
            .select(first_rows.agg(total).scalar().alias("staging_revenue"), "orders_revenue")
            .withColumn("difference", F.abs(F.col("staging_revenue") - F.col("orders_revenue"))))


def _return_rate(w: Warehouse) -> DataFrame:
    rate = m.quotient(m.return_count(), m.order_count())
    return (w.order_returns.agg(rate.alias("_rate"))
            .withColumn("return_rate_pct", F.round(F.col("_rate") * 100.0, 2)))


def _category_conflicts(w: Warehouse) -> DataFrame:
    per_product = (w.staging.select("product_id", "category").distinct()
                   .groupBy("product_id").agg(F.count("category").alias("_categories")))
    conflicts = F.count_if(F.col("_categories") > 1)
    return per_product.agg(
        conflicts.alias("products_with_category_conflicts"),
        m.percent(conflicts, F.count("product_id")).alias("pct_of_all_products"),
    )


def _malformed_count(w: Warehouse) -> Column:
    """Records of the source files that could not be read; none where there were no files."""
    if w.malformed is None:
        return F.lit(0).cast("long")
    return w.malformed.agg(F.count(F.lit(1)).alias("n")).scalar()


def _malformed(w: Warehouse) -> DataFrame:
    return w.staging.sparkSession.range(1).select(
        _malformed_count(w).alias("malformed_record_count"))


def _is_zero(*columns: str) -> Callable[[Callable[[str], Column]], Column]:
    def condition(metric: Callable[[str], Column]) -> Column:
        result = F.lit(True)
        for column in columns:
            result = result & (metric(column) == 0)
        return result
    return condition


def _same_revenue(metric: Callable[[str], Column]) -> Column:
    return metric("difference") <= F.lit("0.01").cast("decimal(4,2)")


# Check texts and limits.
CHECKS = {
    "dq_01": Check(
        "row count reconciliation", ("staging_unique_orders", "orders_count"), _profile,
        lambda of: of("orders_count") <= of("staging_unique_orders"),
        "FAIL — more orders loaded than unique staging rows"),
    "dq_02": Check(
        "duplicate orders", ("duplicate_order_count",),
        lambda w: _count(repeated_keys(w.orders, "order_id"), "duplicate_order_count"),
        _is_zero("duplicate_order_count"),
        "FAIL — duplicate order_ids exist in orders table"),
    "dq_03": Check(
        "revenue reconciliation", ("staging_revenue", "orders_revenue", "difference"),
        _profile, _same_revenue,
        "FAIL — revenue mismatch between staging and orders table"),
    "dq_03_dedup": Check(
        "revenue reconciliation without duplicates",
        ("staging_revenue", "orders_revenue", "difference"), _deduplicated_revenue,
        _same_revenue, "FAIL — revenue mismatch between staging and orders table"),
    "dq_04": Check(
        "orphaned returns", ("orphaned_return_count",),
        lambda w: orphan_count(w.returns, w.orders, "order_id", "orphaned_return_count"),
        _is_zero("orphaned_return_count"),
        "FAIL — return records exist with no matching order"),
    "dq_05": Check(
        "missing keys", ("missing_customer_id", "missing_product_id", "missing_order_date"),
        _profile, _is_zero("missing_customer_id", "missing_product_id", "missing_order_date"),
        "FAIL — null values found in critical columns"),
    "dq_06": Check(
        "orphaned customers", ("orphaned_customer_count",),
        lambda w: orphan_count(w.orders, w.customers, "customer_id", "orphaned_customer_count"),
        _is_zero("orphaned_customer_count"),
        "FAIL — orders reference customer_ids not in customers table"),
    "dq_07": Check(
        "orphaned products", ("orphaned_product_count",),
        lambda w: orphan_count(w.orders, w.products, "product_id", "orphaned_product_count"),
        _is_zero("orphaned_product_count"),
        "FAIL — orders reference product_ids not in products table"),
    "dq_08": Check(
        "delivery before order", ("invalid_delivery_date_count",), _profile,
        _is_zero("invalid_delivery_date_count"),
        "FAIL — delivered_date is earlier than order_date on some rows"),
    "dq_09": Check(
        "return rate range", ("return_rate_pct",), _return_rate,
        lambda of: of("_rate").between(0.01, 0.30),
        "FAIL — return rate is outside expected range (1%–30%)"),
    "dq_10": Check(
        "discount range", ("invalid_discount_count",),
        lambda w: _count(w.products.filter((F.col("discount") < 0) | (F.col("discount") > 1)),
                         "invalid_discount_count"),
        _is_zero("invalid_discount_count"),
        "FAIL — products have discount values outside [0, 1]"),
    "dq_11": Check(
        "category conflicts", ("products_with_category_conflicts", "pct_of_all_products"),
        _category_conflicts),
    "dq_null_amount": Check(
        "orders without amount", ("null_amount_count",), _profile,
        _is_zero("null_amount_count"), "FAIL — null order amounts exist in orders table"),
    "dq_unparsed_dates": Check(
        "date texts that are not dates",
        ("unparsed_order_date", "unparsed_delivered_date", "unparsed_request_date"), _profile),
    "dq_malformed": Check(
        "malformed records", ("malformed_record_count",), _malformed,
        _is_zero("malformed_record_count"), "FAIL — source files hold records that cannot be read"),
}


def _from_audit(check_id: str) -> dict[str, Column]:
    """A check's metrics as expressions over the row of ``audit``."""
    def of(name: str) -> Column:
        return F.col(f"`{name}`")

    def if_any(name: str) -> Column:
        # like the sum over an empty table
        return F.when(of("orders_count") > 0, of(f"orders NOT NULL {name}"))

    revenue = of("first_revenue") if check_id == "dq_03_dedup" else of("staging_revenue")
    conflicts = of("conflicting_products")
    known = {
        "staging_unique_orders": of("staging_unique_orders"), "orders_count": of("orders_count"),
        "duplicate_order_count": of("duplicate_order_count"), "staging_revenue": revenue,
        "orders_revenue": of("orders_revenue"),
        "difference": F.abs(revenue - of("orders_revenue")),
        "orphaned_return_count": of("returns orphans order_id"),
        "orphaned_customer_count": of("orders orphans customer_id"),
        "orphaned_product_count": of("orders orphans product_id"),
        **{f"missing_{c}": if_any(c) for c in ("customer_id", "product_id", "order_date")},
        "invalid_delivery_date_count": of(f"orders {LATE}"),
        "return_rate_pct": F.round(
            m.quotient(of("joined_returns"), of("joined_orders")) * 100.0, 2),
        "_rate": m.quotient(of("joined_returns"), of("joined_orders")),
        "invalid_discount_count": of("products CHECK discount"),
        "products_with_category_conflicts": conflicts,
        "pct_of_all_products": m.percent(conflicts, of("staging_products")),
        "null_amount_count": of("orders NOT NULL total_amount"),
        **{f"unparsed_{c}": of(f"staging DATE {c}") for c in DATES},
        "malformed_record_count": of("malformed_record_count"),
    }
    return {name: known[name] for name in (*CHECKS[check_id].metrics, "_rate")}


def dq_report(warehouse: Warehouse) -> DataFrame:
    """All checks in long form: check_id, check_name, check_result, metric, value.

    Informational checks have the result ``INFO``. One pass over the tables gives everything.
    """
    w = warehouse
    staging = w.staging if w.grouped is None else w.grouped
    measured = audit(w.customers, w.products, w.orders, w.returns, staging).withColumn(
        "malformed_record_count", _malformed_count(w))
    # a struct per check, as two checks report a revenue of the same name
    measured = measured.select(*[
        F.struct(*[value.alias(name) for name, value in _from_audit(check_id).items()])
        .alias(check_id) for check_id in CHECKS])
    lines = []
    for check_id, check in CHECKS.items():
        def metric(name: str, check_id=check_id) -> Column:
            return F.col(f"{check_id}.{name}")

        lines += [
            F.struct(F.lit(check_id).alias("check_id"), F.lit(check.name).alias("check_name"),
                     check.verdict(metric).alias("check_result"), F.lit(name).alias("metric"),
                     metric(name).cast("double").alias("value"))
            for name in check.metrics]
    return measured.select(F.inline(F.array(*lines)))
