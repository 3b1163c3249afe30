"""The declared columns of the tables, checked against what the tables hold."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backhaul.schemas import CUSTOMERS, ORDERS, PRODUCTS, RETURNS, STAGING

DECLARED = {"staging": STAGING, "customers": CUSTOMERS, "products": PRODUCTS, "orders": ORDERS,
            "returns": RETURNS}


def _table_report(name: str, rows: DataFrame, declared: T.StructType) -> DataFrame:
    """One row per declared column; one pass counts the nulls of all of them."""
    found = {f.name: f.dataType for f in rows.schema}
    lines = [F.struct(
        F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"),
        F.lit(i + 1).cast("long").alias("position"),
        F.lit(f.dataType.simpleString()).alias("data_type"),
        F.lit(f.nullable).alias("nullable"),
        F.lit(found.get(f.name) == f.dataType).alias("as_declared"),
        (F.count_if(F.col(f.name).isNull()) if f.name in found else F.count(F.lit(1)))
        .alias("null_count"))
        for i, f in enumerate(declared)]
    return rows.agg(F.array(*lines).alias("lines")).select(F.inline("lines")).withColumn(
        "violations", F.when(~F.col("nullable"), F.col("null_count")).otherwise(0))


def schema_report(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, position, data_type, nullable, whether the stored type is the
    declared one, nulls, and nulls where none are allowed."""
    return reduce(DataFrame.unionByName, [
        _table_report(name, tables[name], declared) for name, declared in DECLARED.items()])
