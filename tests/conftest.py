import datetime as dt
import os
import sys
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from backhaul.schemas import (CUSTOMERS, INGEST_SEQ, ORDERS, PRODUCTS, RETURNS,  # noqa: E402
                              STAGING)
from backhaul.operators.facts import order_facts  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "4g")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _convert(value, data_type):
    if value is None:
        return None
    if isinstance(data_type, T.DecimalType):
        return Decimal(str(value))
    if isinstance(data_type, T.DateType) and isinstance(value, str):
        return dt.date.fromisoformat(value)
    return value


def _frame(spark, schema, defaults, rows):
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    data = [tuple(_convert({**defaults, **row}.get(f.name), f.dataType) for f in loose)
            for row in rows]
    return spark.createDataFrame(data, loose)


class Make:
    """Small tables from dicts; anything not given has an unremarkable default."""

    def __init__(self, spark):
        self.spark = spark

    def staging(self, *rows):
        schema = T.StructType([*STAGING.fields, T.StructField(INGEST_SEQ, T.LongType())])
        defaults = dict(customer_id="C1", product_id="P1", category="Home", price=10, discount=0,
                        customer_age=30, customer_gender="Female", order_date="1/2/2023",
                        quantity=1, region="East", total_amount=10, shipping_cost=1,
                        profit_margin=1, returned="No")
        numbered = [{INGEST_SEQ: i, "order_id": f"O{i}", **row} for i, row in enumerate(rows)]
        return _frame(self.spark, schema, defaults, numbered)

    def customers(self, *rows):
        return _frame(self.spark, CUSTOMERS, dict(customer_age=30), rows)

    def products(self, *rows):
        return _frame(self.spark, PRODUCTS, dict(category="Home", price=10, discount=0), rows)

    def orders(self, *rows):
        defaults = dict(customer_id="C1", product_id="P1", order_date="2023-01-01", quantity=1,
                        region="East", total_amount=10, shipping_cost=1, profit_margin=1)
        numbered = [{"order_id": f"O{i}", **row} for i, row in enumerate(rows)]
        return _frame(self.spark, ORDERS, defaults, numbered)

    def returns(self, *rows):
        numbered = [{"return_id": i, **row} for i, row in enumerate(rows)]
        return _frame(self.spark, RETURNS, dict(request_date="2023-01-10"), numbered)

    def facts(self, *rows):
        """Orders with ``returned``, ``return_reason`` and ``category`` given on the row."""
        rows = [{"order_id": f"O{i}", "product_id": "P1", **row} for i, row in enumerate(rows)]
        categories = {row["product_id"]: row.get("category", "Home") for row in rows}
        return order_facts(
            self.orders(*rows),
            self.products(*[dict(product_id=p, category=c) for p, c in categories.items()
                            if c is not None]),
            self.returns(*[dict(order_id=row["order_id"],
                                request_date=row.get("request_date", "2023-01-10"),
                                return_reason=row.get("return_reason"))
                           for row in rows if row.get("returned")]))


@pytest.fixture(scope="session")
def make(spark):
    return Make(spark)


def plain(rows):
    """Rows as dicts with decimals as floats."""
    return [{k: float(v) if isinstance(v, Decimal) else v for k, v in row.asDict().items()}
            for row in rows]


@pytest.fixture(scope="session")
def collect():
    def run(df, key=None):
        rows = plain(df.collect())
        return {row[key]: row for row in rows} if key else rows
    return run
