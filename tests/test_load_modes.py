import pytest
from pyspark.sql import functions as F

from backhaul import Warehouse
from backhaul.operators import constraints, risk


def staged(make):
    return make.staging(
        dict(order_id="good", product_id="P1", returned="Yes", request_date="9/2/2023"),
        dict(order_id="undated", order_date="2023-01-02", returned="Yes",
             request_date="9/2/2023"),
        dict(order_id="none", quantity=0),
        dict(order_id="free", product_id="P2", discount=1.1),
        dict(order_id="nobody", customer_id=None),
        dict(order_id="nothing", product_id="P3", category=None))


def test_quarantine(spark, make, tmp_path):
    path = str(tmp_path)
    w = Warehouse.load(staged(make), path, mode="quarantine")
    assert [r["order_id"] for r in w.order_facts.collect()] == ["good"]
    assert [r["order_id"] for r in w.returns.collect()] == ["good"]
    aside = {name: {r[key]: r["violations"] for r in
                    spark.read.parquet(f"{path}/quarantine/{name}").collect()}
             for name, key in (("orders", "order_id"), ("returns", "order_id"),
                               ("products", "product_id"), ("customers", "customer_id"))}
    assert aside["orders"] == {
        "undated": ["NOT NULL order_date"], "none": ["CHECK quantity"],
        "nobody": ["NOT NULL customer_id"], "free": ["FOREIGN KEY product_id"],
        "nothing": ["FOREIGN KEY product_id"]}
    assert aside["returns"] == {"undated": ["FOREIGN KEY order_id"]}
    assert aside["products"] == {"P2": ["CHECK discount"]}
    assert aside["customers"] == {None: ["NOT NULL customer_id"]}


def test_fail_counts_them_and_audit_keeps_them(make, tmp_path):
    with pytest.raises(ValueError, match="'orders': 5"):
        Warehouse.load(staged(make), str(tmp_path / "a"), mode="fail")
    assert Warehouse.load(staged(make), str(tmp_path / "b")).order_facts.count() == 6
    with pytest.raises(ValueError, match="unknown mode"):
        Warehouse.load(staged(make), str(tmp_path / "c"), mode="other")


def test_repeated_keys_go_with_all_their_rows(make):
    kept, aside = constraints.enforce(
        make.customers(dict(customer_id="C1")), make.products(dict(product_id="P1")),
        make.orders(dict(order_id="A"), dict(order_id="A", quantity=2), dict(order_id="B")),
        make.returns(dict(order_id="A")).withColumn("return_id", F.lit("x")))
    assert [r["order_id"] for r in kept["orders"].collect()] == ["B"]
    assert [r["violations"] for r in aside["orders"].collect()] == [["UNIQUE order_id"]] * 2
    assert kept["returns"].count() == 0


def test_month_filter_prunes_partitions(make, tmp_path, capsys):
    Warehouse.load(staged(make), str(tmp_path))
    facts = make.spark.read.parquet(f"{tmp_path}/order_facts")
    facts.filter("order_month = '2023-02'").explain()
    assert "PartitionFilters: [isnotnull(order_month" in capsys.readouterr().out


def test_orders_without_a_date_keep_their_risk_row(make, collect):
    facts = make.facts(dict(order_id="a", customer_id="C"),
                       dict(order_id="b", customer_id="C", order_date=None))
    rows = collect(risk.order_risk_score(risk.order_risk_features(facts)), "order_id")
    assert set(rows) == {"a", "b"} and rows["b"]["risk_score"] is None


def test_stored_facts_look_up_contested_products_only(make, tmp_path):
    """The category of an order is that of its product, also where its own row names another."""
    rows = make.staging(
        dict(order_id="a", product_id="P1", category="Toys", ingest_seq=1),
        dict(order_id="b", product_id="P1", category="Home", ingest_seq=2),
        dict(order_id="c", product_id="P1", category="Home", ingest_seq=3),
        dict(order_id="d", product_id="P2", category=None, ingest_seq=4),
        dict(order_id="e", product_id="P2", category="Books", ingest_seq=5),
        dict(order_id="f", product_id="P3", category=None, ingest_seq=6),
        dict(order_id="g", product_id=None, category="Home", ingest_seq=7),
        dict(order_id="h", product_id="P4", category="Garden", ingest_seq=8))
    w = Warehouse.load(rows, str(tmp_path))
    stored = make.spark.read.parquet(f"{tmp_path}/products")
    assert {r["product_id"] for r in stored.filter("contested").collect()} == {"P1", "P2"}
    assert "contested" not in w.products.columns
    derived = Warehouse.from_staging(rows).order_facts
    for facts in (w.order_facts, derived):
        assert {r["order_id"]: r["category"] for r in facts.collect()} == dict(
            a="Home", b="Home", c="Home", d="Books", e="Books", f=None, g=None, h="Garden")


def test_rows_stay_where_they_are_when_constraints_are_enforced(make):
    tables = (make.customers(dict(customer_id="C1")), make.products(dict(product_id="P1")),
              make.orders(dict(order_id="a"), dict(order_id="a"), dict(order_id="b"),
                          dict(order_id="c", customer_id="C9"), dict(order_id="d", product_id="P9")),
              make.returns(dict(return_id="1", order_id="b"), dict(return_id="2", order_id="c")))
    kept, aside = constraints.enforce(*tables)
    for rows in (*kept.values(), *aside.values()):
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
    found = {name: sorted((r[0], *r["violations"]) for r in rows.collect())
             for name, rows in aside.items()}
    assert found["orders"] == [("a", "UNIQUE order_id"), ("a", "UNIQUE order_id"),
                               ("c", "FOREIGN KEY customer_id"), ("d", "FOREIGN KEY product_id")]
    assert [r["order_id"] for r in kept["orders"].collect()] == ["b"]
    assert [r["return_id"] for r in kept["returns"].collect()] == ["1"]
    assert [r["return_id"] for r in aside["returns"].collect()] == ["2"]
