"""Typed schemas of the staging file and of the four normalised tables."""

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
FRACTION = T.DecimalType(4, 2)

# One wide row per (possibly duplicated) order; dates are still D/M/YYYY text.
STAGING = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("price", MONEY),
    T.StructField("discount", FRACTION),
    T.StructField("customer_age", T.IntegerType()),
    T.StructField("customer_gender", T.StringType()),
    T.StructField("order_date", T.StringType()),
    T.StructField("delivered_date", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("total_amount", MONEY),
    T.StructField("shipping_cost", MONEY),
    T.StructField("profit_margin", MONEY),
    T.StructField("returned", T.StringType()),
    T.StructField("request_date", T.StringType()),
    T.StructField("return_reason", T.StringType()),
])

# The load order of staging rows: any orderable type, unique within an order_id.
INGEST_SEQ = "ingest_seq"

# Staging may carry this: a function of the order id by which its rows are dealt, so that copies of
# an order are together already.
ORDER_GROUP = "order_group"

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("customer_age", T.IntegerType()),
    T.StructField("customer_gender", T.StringType()),
])

PRODUCTS = T.StructType([
    T.StructField("product_id", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("price", MONEY, False),
    T.StructField("discount", FRACTION, False),
])

ORDERS = T.StructType([
    T.StructField("order_id", T.StringType(), False),
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("product_id", T.StringType(), False),
    T.StructField("order_date", T.DateType(), False),
    T.StructField("delivered_date", T.DateType()),
    T.StructField("quantity", T.IntegerType(), False),
    T.StructField("payment_method", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("total_amount", MONEY, False),
    T.StructField("shipping_cost", MONEY),
    T.StructField("profit_margin", MONEY),
])

RETURNS = T.StructType([
    T.StructField("return_id", T.StringType(), False),
    T.StructField("order_id", T.StringType(), False),
    T.StructField("request_date", T.DateType()),
    T.StructField("return_reason", T.StringType()),
])


def conform(df, schema: T.StructType):
    """Project and cast ``df`` to ``schema`` (nullability is audited, not enforced)."""
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema])
