"""A warehouse stored in buckets of its keys, so that its joins move no rows.

Staging is dealt into buckets by order id once. Deduplication, returns and the join of orders with
their return then work bucket by bucket. The result is dealt by product id, as the products are, and
the category joins, as well as all analyses by product, again need no exchange. Of a table's bucket
files Spark knows which is which from their names, so a stored warehouse can be opened by another
session that is told keys and number of buckets (``open_table``).
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from backhaul.operators import facts as f
from backhaul.operators import load
from backhaul.plans.shared import store_table
from backhaul.schemas import ORDERS, RETURNS
from backhaul.warehouse import Warehouse

#: Rows that a bucket should hold.
ROWS_PER_BUCKET = 2_000_000


def open_table(spark: SparkSession, path: str, keys: list[str], buckets: int) -> DataFrame:
    """A table that another session stored with the same keys and number of buckets."""
    name, clustered = f"backhaul_{uuid4().hex}", ", ".join(f"`{k}`" for k in keys)
    columns = ", ".join(f"`{c.name}` {c.dataType.simpleString()}"
                        for c in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({clustered}) "
              f"SORTED BY ({clustered}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def load_clustered(staging: DataFrame, path: str, buckets: int | None = None) -> Warehouse:
    """Cleans ``staging`` into bucketed tables under ``path``.

    The number of buckets follows the number of rows; all tables have the same.
    """
    spark = staging.sparkSession
    if buckets is None:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                      -(-staging.count() // ROWS_PER_BUCKET))
    staged = store_table(staging, f"{path}/staging", ["order_id"], buckets)
    returns = store_table(load.returns_clean(staged), f"{path}/returns", ["order_id"], buckets)
    joined = f.order_returns(load.orders_clean(staged), returns)
    by_product = store_table(joined, f"{path}/order_returns", ["product_id"], buckets)
    products = store_table(load.products_dim(staged), f"{path}/products", ["product_id"], buckets)
    customers = store_table(load.customers_dim(staged), f"{path}/customers", ["customer_id"],
                            buckets)
    return Warehouse(staged, customers, products, by_product.select(*ORDERS.names),
                     returns.select(*RETURNS.names), by_product,
                     f.with_category(by_product, products), path)
