import datetime as dt

from pyspark.sql import functions as F

from backhaul.operators import load
from backhaul.schemas import STAGING
from backhaul.sources import staging as source


def test_first_row_wins_whatever_the_partitioning(make, collect):
    rows = [dict(order_id="A", total_amount=5, ingest_seq=7),
            dict(order_id="A", total_amount=9, ingest_seq=3),
            dict(order_id="B", total_amount=1, ingest_seq=1)]
    for parts in (1, 8, 64):
        staging = make.staging(*rows).repartition(parts)
        found = collect(load.orders_clean(staging), "order_id")
        assert found["A"]["total_amount"] == 9 and found["B"]["total_amount"] == 1


def test_return_is_described_by_first_yes_row_but_amount_by_first_row(make, collect):
    staging = make.staging(
        dict(order_id="A", returned="No", total_amount=5, return_reason="x"),
        dict(order_id="A", returned="Yes", total_amount=9, return_reason="late",
             request_date="05/10/2023"),
        dict(order_id="B", returned="Yes", total_amount=1, return_reason="first"),
        dict(order_id="B", returned="No", total_amount=2),
        dict(order_id="C", returned="yes"))
    returns = collect(load.returns_clean(staging), "order_id")
    assert set(returns) == {"A", "B"}
    assert returns["A"]["return_reason"] == "late"
    assert returns["A"]["request_date"] == dt.date(2023, 10, 5)
    assert collect(load.orders_clean(staging), "order_id")["A"]["total_amount"] == 5
    assert len({row["return_id"] for row in returns.values()}) == 2


def test_dates(make, collect):
    texts = ["5/1/2023", "05/10/2023", "31/02/2023", "2023-10-05", "", None]
    staging = make.staging(*[dict(delivered_date=text) for text in texts])
    rows = collect(load.orders_clean(staging), "order_id")
    assert [rows[f"O{i}"]["delivered_date"] for i in range(6)] == [
        dt.date(2023, 1, 5), dt.date(2023, 10, 5), None, None, None, None]
    assert collect(load.unparsed_dates(staging))[0]["delivered_date"] == 2


def test_modal_category_with_alphabetical_ties(make, collect):
    def rows(product, *categories):
        return [dict(product_id=product, category=c, price=i + 1)
                for i, c in enumerate(categories)]
    staging = make.staging(*rows("mode", "b", "b", "a"), *rows("tie2", "b", "a"),
                           *rows("tie3", "c", "b", "a"), *rows("nulls", None, None, "z"),
                           *rows("none", None, None))
    found = collect(load.products_dim(staging), "product_id")
    assert {p: r["category"] for p, r in found.items()} == {
        "mode": "b", "tie2": "a", "tie3": "a", "nulls": "z"}
    assert found["nulls"]["price"] == 3
    assert [r["product_id"] for r in collect(load.products_quarantine(staging))] == ["none"]
    conflicts = collect(load.category_conflicts(staging), "product_id")
    assert set(conflicts) == {"mode", "tie2", "tie3"}
    assert conflicts["tie3"]["categories_seen"] == "a,b,c"


def test_customer_conflicts_take_the_largest_number(make, collect):
    staging = make.staging(dict(customer_age=9, customer_gender="Female"),
                           dict(customer_age=10, customer_gender="Male"))
    assert collect(load.customers_dim(staging)) == [
        dict(customer_id="C1", customer_age=10, customer_gender="Male")]


def test_dedup_report(make, collect):
    staging = make.staging(dict(order_id="A", returned="Yes"), dict(order_id="A"),
                           dict(order_id="B"))
    report = collect(load.dedup_report(staging, load.orders_clean(staging),
                                       load.returns_clean(staging)), "layer")
    assert report["staging"]["row_count"] == 3
    assert report["staging"]["repeated_order_ids"] == 1
    assert report["orders"]["row_count"] == report["orders"]["distinct_order_ids"] == 2
    assert report["returns"]["row_count"] == 1


def test_csv_keeps_file_order_across_splits(spark, tmp_path):
    """Later copies of an order lie in later splits of the file; the first must win."""
    names = STAGING.names
    lines = [",".join(names)]
    for i in range(2000):
        row = dict.fromkeys(names, "")
        row.update(order_id=f"O{i % 500}", total_amount=f"{i}.50", order_date="1/2/2023",
                   quantity="1", price="not a number")
        lines.append(",".join(row[n] for n in names))
    path = str(tmp_path / "wide.csv")
    with open(path, "w") as out:
        out.write("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        staging = source.read_csv(spark, path)
        first = load.orders_clean(staging)
        wrong = first.filter(F.col("total_amount")
                             != F.substring("order_id", 2, 9).cast("int") + F.lit(0.5))
        assert first.count() == 500 and wrong.count() == 0
        assert staging.filter(F.col("price").isNotNull()).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_csv_with_sequence_column(spark, tmp_path, collect):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("line_no", T.LongType()), *STAGING.fields])
    path = tmp_path / "numbered.csv"
    blank = "," * (len(STAGING.names) - 1)
    path.write_text(",".join(schema.names) + f"\n2,A{blank}\n1,A{blank}\n")
    staging = source.read_csv(spark, str(path), schema, sequence="line_no")
    assert [r["ingest_seq"] for r in collect(load.orders_dedup(staging))] == [1]


def test_hot_order_id_is_pruned_before_the_shuffle(make):
    plan = load.orders_clean(make.staging({}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.count("Exchange") == 1
