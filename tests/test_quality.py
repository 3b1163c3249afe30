import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from backhaul import Warehouse
from backhaul.operators import constraints, quality

GOOD = dict(
    staging=[dict(order_id="A", returned="Yes"), *[dict(order_id=f"B{i}") for i in range(9)]],
    customers=[dict(customer_id="C1")], products=[dict(product_id="P1")],
    orders=[dict(order_id="A"), *[dict(order_id=f"B{i}") for i in range(9)]],
    returns=[dict(order_id="A")])


@pytest.fixture
def build(make):
    def warehouse(**changes):
        given = {**GOOD, **changes}
        frames = {name: getattr(make, name)(*rows) if rows else
                  getattr(make, name)({}).limit(0) for name, rows in given.items()}
        return Warehouse.from_tables(**frames)
    return warehouse


def results(warehouse):
    rows = quality.dq_report(warehouse).collect()
    return {r["check_id"]: "PASS" if r["check_result"] == "PASS" else
            "INFO" if r["check_result"] == "INFO" else "FAIL" for r in rows}


def test_clean_tables_pass(build):
    found = results(build())
    assert {c for c, r in found.items() if r == "FAIL"} == set()
    assert found["dq_11"] == found["dq_unparsed_dates"] == "INFO"


ORDERS = GOOD["orders"]


@pytest.mark.parametrize("check, changes", [
    ("dq_01", dict(orders=[*ORDERS, dict(order_id="new")])),
    ("dq_02", dict(orders=[*ORDERS, dict(order_id="A")])),
    ("dq_03", dict(staging=[*GOOD["staging"], dict(order_id="A")])),
    ("dq_04", dict(returns=[dict(order_id="gone")])),
    ("dq_05", dict(orders=[*ORDERS[1:], dict(order_id="A", order_date=None)])),
    ("dq_06", dict(orders=[*ORDERS[1:], dict(order_id="A", customer_id="C9")])),
    ("dq_07", dict(orders=[*ORDERS[1:], dict(order_id="A", product_id="P9")])),
    ("dq_08", dict(orders=[*ORDERS[1:], dict(order_id="A", delivered_date="2022-12-31")])),
    ("dq_09", dict(returns=[dict(order_id=f"B{i}") for i in range(4)])),
    ("dq_10", dict(products=[dict(product_id="P1", discount=1.1)])),
    ("dq_null_amount", dict(orders=[*ORDERS[1:], dict(order_id="A", total_amount=None)])),
])
def test_each_check_can_fail(build, check, changes):
    row = quality.CHECKS[check].run(build(**changes)).collect()[0]
    assert row["check_result"] == quality.CHECKS[check].failure


def test_orphans_are_counted_by_row(build):
    w = build(orders=[dict(order_id=str(i), customer_id="C9") for i in range(5)]
              + [dict(order_id="n", customer_id=None)])
    assert quality.CHECKS["dq_06"].run(w).collect()[0]["orphaned_customer_count"] == 6


def test_empty_tables(build):
    found = results(build(staging=[], customers=[], products=[], orders=[], returns=[]))
    assert found["dq_05"] == "FAIL" and found["dq_09"] == "FAIL"
    assert found["dq_01"] == found["dq_02"] == "PASS"


def test_category_conflicts_and_dates(build, make):
    w = build(staging=[dict(product_id="P1", category="a"), dict(product_id="P1", category="b"),
                       dict(product_id="P2", order_date="2023-02-01")])
    assert quality.CHECKS["dq_11"].run(w).collect()[0].asDict() == dict(
        products_with_category_conflicts=1, pct_of_all_products=50.0)
    assert quality.CHECKS["dq_unparsed_dates"].run(w).collect()[0]["unparsed_order_date"] == 1


def test_revenue_check_without_duplicates(build):
    w = build(staging=[*GOOD["staging"], dict(order_id="A")])
    assert quality.CHECKS["dq_03_dedup"].run(w).collect()[0]["check_result"] == "PASS"


def test_constraint_report(make):
    report = constraints.constraint_report(
        make.customers(dict(customer_id="C1"), dict(customer_id="C1")),
        make.products(dict(product_id="P1", discount=-0.1), dict(product_id="P2", category=None)),
        make.orders(dict(quantity=0), dict(quantity=None), dict(customer_id="C8"),
                    dict(product_id="P8")),
        make.returns(dict(order_id="O1"), dict(order_id="O1"), dict(order_id="gone")))
    found = {(r["table_name"], r["kind"], r["column_name"]): r["violations"]
             for r in report.collect()}
    broken = {key: n for key, n in found.items() if n}
    assert broken == {
        ("customers", "UNIQUE", "customer_id"): 1, ("products", "CHECK", "discount"): 1,
        ("products", "NOT NULL", "category"): 1, ("orders", "CHECK", "quantity"): 1,
        ("orders", "NOT NULL", "quantity"): 1, ("orders", "FOREIGN KEY", "customer_id"): 1,
        ("orders", "FOREIGN KEY", "product_id"): 1, ("returns", "UNIQUE", "order_id"): 1,
        ("returns", "FOREIGN KEY", "order_id"): 1}
    assert len(found) == 23


def test_quarantine_and_fail(make):
    orders = make.orders(dict(order_id="ok"), dict(order_id="bad", quantity=0, order_date=None))
    valid, rejected = constraints.split_valid("orders", orders)
    assert [r["order_id"] for r in valid.collect()] == ["ok"]
    assert rejected.collect()[0]["violations"] == ["NOT NULL order_date", "CHECK quantity"]
    assert constraints.require_valid("orders", valid).count() == 1
    with pytest.raises(PySparkException):
        constraints.require_valid("orders", orders).select(F.max("order_id")).collect()
