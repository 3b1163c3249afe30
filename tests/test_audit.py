import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from backhaul import Warehouse
from backhaul.operators import audit, constraints, quality
from backhaul.schemas import ORDER_GROUP
from backhaul.sources import star
from conftest import DATA


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    return Warehouse.load(star.read_staging(spark, DATA), str(tmp_path_factory.mktemp("audited")))


def scans(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_every_table_is_read_once(loaded):
    assert scans(quality.dq_report(loaded)) == 5
    report = constraints.constraint_report(loaded.customers, loaded.products, loaded.orders,
                                           loaded.returns)
    assert scans(report) == 4


def test_report_equals_the_single_checks(loaded):
    lines = {(r["check_id"], r["metric"]): r for r in quality.dq_report(loaded).collect()}
    for check_id, check in quality.CHECKS.items():
        row = check.run(loaded).collect()[0]
        for metric in check.metrics:
            line = lines[check_id, metric]
            assert line["value"] == float(row[metric])
            assert line["check_result"] == (row["check_result"] if check.passes else "INFO")


def test_report_of_broken_tables_equals_the_single_checks(make):
    w = Warehouse.from_tables(
        staging=make.staging(dict(order_id="A", ingest_seq=2, total_amount=7, category="x"),
                             dict(order_id="A", ingest_seq=1, total_amount=None, category="y"),
                             dict(order_id=None, category=None), dict(order_date="31/2/2023")),
        customers=make.customers(dict(customer_id="C2"), dict(customer_id=None)),
        products=make.products(dict(product_id="P1", discount=2), dict(product_id="P1")),
        orders=make.orders(dict(order_id="A", total_amount=None), dict(order_id="A"),
                           dict(order_id=None, customer_id=None, product_id=None),
                           dict(order_id="Z", product_id="P9", delivered_date="2022-01-01")),
        returns=make.returns(dict(order_id="A"), dict(order_id="gone"), dict(order_id=None)))
    lines = {(r["check_id"], r["metric"]): r["value"] for r in quality.dq_report(w).collect()}
    for check_id, check in quality.CHECKS.items():
        row = check.run(w).collect()[0]
        for metric in check.metrics:
            expected = None if row[metric] is None else float(row[metric])
            assert lines[check_id, metric] == expected, (check_id, metric)


def test_a_hot_key_is_counted_in_its_task(spark, make):
    """Half of all rows carry one product; it reaches the shuffle once per task."""
    orders = (spark.range(0, 20_000, 1, 4)
              .select(F.col("id").cast("string").alias("order_id"), F.lit("C").alias("customer_id"),
                      F.when(F.col("id") % 2 == 0, "hot").otherwise("cold").alias("product_id"))
              .join(make.orders(dict(order_id="-")).drop("order_id", "customer_id", "product_id")))
    tables = {"orders": orders, "customers": make.customers(), "products": make.products(),
              "returns": make.returns()}
    found = {r["key"]: r["in_orders"] for r in
             audit.per_key(tables).filter("kind = 'product'").collect()}
    assert found == {"hot": 10_000, "cold": 10_000}


def test_entries_are_a_text_and_two_numbers(spark, loaded):
    """What a task holds and moves for a key of the tables."""
    report = constraints.constraint_report(loaded.customers, loaded.products, loaded.orders,
                                           loaded.returns)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        report._jdf.queryExecution(), "formatted")
    moved = re.findall(r"Exchange\nInput \[(\d+)\]: .*\nArguments: hashpartitioning", plan)
    assert moved == ["3"]


def test_orders_of_grouped_staging_are_not_moved(spark, tmp_path):
    w = Warehouse.load(star.read_staging(spark, DATA, 4), str(tmp_path), groups=4)
    report = quality.dq_report(w)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert not re.search(r"hashpartitioning\((order_id|order_group)", plan)
    lines = {(r["check_id"], r["metric"]): r["value"] for r in report.collect()}
    for check_id, check in quality.CHECKS.items():
        row = check.run(w).collect()[0]
        assert [lines[check_id, m] for m in check.metrics] == [float(row[m])
                                                               for m in check.metrics]


def test_first_rows_and_amounts_of_grouped_staging(make):
    staging = make.staging(
        dict(order_id="A", ingest_seq=2, total_amount="7.25"),
        dict(order_id="A", ingest_seq=1, total_amount=None, category="y", product_id=None),
        dict(order_id="B", ingest_seq=4, total_amount="-0.01", order_date="31/2/2023"),
        dict(order_id="B", ingest_seq=3, total_amount="-12.34"),
        dict(order_id=None, ingest_seq=6, total_amount="5"),
        dict(order_id=None, ingest_seq=5, total_amount="3.10", category=None),
        dict(order_id="", ingest_seq=7, total_amount="9999999999.99"))
    w = Warehouse.from_tables(
        staging, make.customers(dict(customer_id="C1")), make.products(dict(product_id="P1")),
        make.orders(dict(total_amount="9999999999.99"), dict(total_amount="9999999999.99"),
                    dict(total_amount="-12.34"), dict(total_amount="-123456.07"),
                    dict(total_amount=None)),
        make.returns(dict(order_id="O1")))
    grouped = replace(w, grouped=staging.withColumn(ORDER_GROUP, F.hash("order_id")))
    report = quality.dq_report(grouped).collect()
    assert report == quality.dq_report(w).collect()
    lines = {(r["check_id"], r["metric"]): r["value"] for r in report}
    assert lines["dq_01", "staging_unique_orders"] == 3
    assert lines["dq_03_dedup", "staging_revenue"] == 9999999990.75
    assert lines["dq_03", "staging_revenue"] == 10000000002.99
    assert lines["dq_03", "orders_revenue"] == 19999876531.57
    assert lines["dq_unparsed_dates", "unparsed_order_date"] == 1
