"""The join shape almost every analysis starts from: one row per order, return attached."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_returns(orders: DataFrame, returns: DataFrame) -> DataFrame:
    """Orders with ``returned``, ``request_date`` and ``return_reason``.

    There is at most one return per order, so the left join never multiplies rows.
    """
    marked = returns.select("order_id", "request_date", "return_reason",
                            F.lit(True).alias("_hit"))
    return (orders.join(marked, "order_id", "left")
            .withColumn("returned", F.coalesce("_hit", F.lit(False)))
            .drop("_hit"))


def with_category(order_returns: DataFrame, products: DataFrame) -> DataFrame:
    """Adds the product's category; NULL for an order whose product is unknown.

    Operators that need a category skip those orders, which is what an inner join to
    products would do. Where both sides are stored tables, a hot product is split at run time
    by adaptive skew handling: the products side has one row per key, so repeating its slice
    is cheap.
    """
    return order_returns.join(products.select("product_id", "category"), "product_id", "left")


def with_modal_category(order_returns: DataFrame, contested: DataFrame) -> DataFrame:
    """``with_category`` of orders that carry the ``category`` of their own row.

    That is the product's category unless the product's rows differ in it, so only the
    ``contested`` products are looked up, which need not move the orders.
    """
    columns = [c for c in order_returns.columns if c not in ("product_id", "category")]
    modal = contested.select("product_id", F.col("category").alias("_modal"))
    category = F.when(F.col("product_id").isNotNull(), F.coalesce("_modal", "category"))
    return (order_returns.join(modal, "product_id", "left")
            .select("product_id", *columns, category.alias("category")))


def order_facts(orders: DataFrame, products: DataFrame, returns: DataFrame) -> DataFrame:
    return with_category(order_returns(orders, returns), products)


def categorised(facts: DataFrame) -> DataFrame:
    """Orders whose product is known."""
    return facts.filter(F.col("category").isNotNull())


def returned_only(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("returned"))
