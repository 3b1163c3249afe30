"""The tables every analysis reads, lazily derived or loaded once and read back."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backhaul.functions import metrics as m
from backhaul.operators import constraints
from backhaul.operators import facts as f
from backhaul.operators import load
from backhaul.plans.shared import remove, store_table, write_table
from backhaul.schemas import ORDER_GROUP, ORDERS, PRODUCTS, RETURNS
from backhaul.sources import staging as source

#: Contested products (a key and a category each) that are sent to every task of the orders.
MOST_CONTESTED = 1_000_000
MODES = ("audit", "quarantine", "fail")


@dataclass(frozen=True)
class Warehouse:
    """``order_returns`` is orders with the return attached, ``order_facts`` adds the category.

    ``path`` is where the tables are stored, if they are; ``malformed`` the records of the source
    files that could not be read, if the tables come from files. ``grouped`` is ``staging`` in
    ``groups`` buckets of its ``ORDER_GROUP``, if it was loaded so.
    """

    staging: DataFrame
    customers: DataFrame
    products: DataFrame
    orders: DataFrame
    returns: DataFrame
    order_returns: DataFrame
    order_facts: DataFrame
    path: str | None = None
    malformed: DataFrame | None = None
    grouped: DataFrame | None = None
    groups: int | None = None

    @classmethod
    def from_tables(cls, staging: DataFrame, customers: DataFrame, products: DataFrame,
                    orders: DataFrame, returns: DataFrame) -> Warehouse:
        joined = f.order_returns(orders, returns)
        return cls(staging, customers, products, orders, returns, joined,
                   f.with_category(joined, products))

    @classmethod
    def from_staging(cls, staging: DataFrame) -> Warehouse:
        """Nothing is computed or stored; every query starts from staging."""
        return cls.from_tables(staging, load.customers_dim(staging), load.products_dim(staging),
                               load.orders_clean(staging), load.returns_clean(staging))

    @classmethod
    def load(cls, staging: DataFrame, path: str, mode: str = "audit", groups: int | None = None
             ) -> Warehouse:
        """Full refresh: clean ``staging``, replace the tables under ``path``, read them.

        ``mode`` says what becomes of rows that break a constraint: "audit" keeps them for the
        reports, "quarantine" stores them under ``path``/quarantine instead, "fail" stores no
        facts and raises an error that counts them.

        Orders are stored with return and category attached and by order month, so the
        analyses scan one table, filters on dates skip months, and the plain ``orders`` are a
        choice of its columns.

        Staging that carries ``ORDER_GROUP``, dealt into ``groups`` by it, is stored in buckets of
        the groups. Copies of an order are not moved again then.

        Orders that are moved more than once, for return, category and month, are stored in between
        under ``path``/joined, so that the files of one move are gone before the next.
        """
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        if groups:
            staging = store_table(staging, f"{path}/staging", [ORDER_GROUP], groups)
        else:
            write_table(staging, f"{path}/staging")
            staging = staging.sparkSession.read.parquet(f"{path}/staging")
        return cls._derive(staging, path, mode, groups)

    @classmethod
    def _derive(cls, staging: DataFrame, path: str, mode: str, groups: int | None) -> Warehouse:
        """``load`` of staging that is stored under ``path`` already."""
        spark = staging.sparkSession

        def store(name: str, rows: DataFrame) -> DataFrame:
            write_table(rows, f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}")

        cleaned = {"customers": load.customers_dim(staging),
                   "products": load.products_dim(staging),
                   "returns": load.returns_clean(staging)}
        if mode == "audit":
            cleaned["products"] = load.marked_products(staging)
            kept = {name: store(name, rows) for name, rows in cleaned.items()}
            contested = kept["products"].filter(load.CONTESTED)
            few = contested.count() <= MOST_CONTESTED
            returned = (load.orders_with_return(staging) if groups else store(
                "joined/returned", f.order_returns(load.orders_with_own_category(staging),
                                                   kept["returns"])))
            facts = f.with_modal_category(returned, F.broadcast(contested) if few else contested)
            if not few:
                facts = store("joined/facts", facts)
        else:
            orders = load.orders_clean(staging)
            raw = {name: store(f"cleaned/{name}", rows) for name, rows in
                   {**cleaned, "orders": orders}.items()}
            kept, aside = constraints.enforce(raw["customers"], raw["products"], raw["orders"],
                                              raw["returns"])
            counts = {name: store(f"quarantine/{name}", rows).count()
                      for name, rows in aside.items()}
            if mode == "fail" and any(counts.values()):
                raise ValueError(f"rows that break a constraint: {counts}")
            orders = kept.pop("orders")
            kept = {name: store(name, rows) for name, rows in kept.items()}
            returned = store("joined/returned", f.order_returns(orders, kept["returns"]))
            remove(spark, f"{path}/cleaned")
            facts = store("joined/facts", f.with_category(returned, kept["products"]))
        write_table(facts.withColumn("order_month", m.month_key("order_date"))
                    .hint("rebalance", "order_month"), f"{path}/order_facts", "order_month")
        remove(spark, f"{path}/joined")
        loaded = cls.read(spark, path)
        return replace(loaded, grouped=staging, groups=groups) if groups else loaded

    @classmethod
    def load_csv(cls, spark: SparkSession, files: str, path: str, mode: str = "audit",
                 multi_line: bool = True) -> Warehouse:
        """``load`` from wide CSV files. Malformed records go to ``path``/malformed, as text with
        their file; the checks count them. What was parsed is stored, so it is parsed once, until it
        is divided into both."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        write_table(source.marked_csv(spark, files, multi_line=multi_line), f"{path}/parsed")
        rows, broken = source.divide(spark.read.parquet(f"{path}/parsed"))
        write_table(broken.select("file", "record"), f"{path}/malformed")
        write_table(rows, f"{path}/staging")
        remove(spark, f"{path}/parsed")
        loaded = cls._derive(spark.read.parquet(f"{path}/staging"), path, mode, None)
        return replace(loaded, malformed=spark.read.parquet(f"{path}/malformed"))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Warehouse:
        """Tables written by ``load``."""
        def table(name: str) -> DataFrame:
            return spark.read.parquet(f"{path}/{name}")

        # the month is text like the keys; it prunes and is no column of the facts
        facts = table("order_facts").drop("order_month")
        return cls(table("staging").drop(ORDER_GROUP), table("customers"),
                   table("products").select(*PRODUCTS.names),
                   facts.select(*ORDERS.names), table("returns").select(*RETURNS.names),
                   facts.drop("category"), facts, path)
