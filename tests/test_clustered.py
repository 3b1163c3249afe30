import pytest
from pyspark.sql import functions as F

from backhaul import Warehouse, clustered
from backhaul.operators import facts, load
from backhaul.sources import star
from conftest import DATA


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clustered"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield clustered.load_clustered(star.read_staging(spark, DATA), path, 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_joins_of_the_facts_move_no_rows(loaded):
    orders, returns = load.orders_clean(loaded.staging), loaded.returns
    joined = facts.order_returns(orders, returns)
    for frame in (orders, load.returns_clean(loaded.staging), joined, loaded.order_facts):
        assert exchanges(frame) == 0
    plan = loaded.order_facts._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_analyses_by_product_move_no_rows(loaded):
    by_product = (loaded.order_facts.groupBy("product_id", "category")
                  .agg(F.sum("total_amount"), F.count_if("returned")))
    assert exchanges(by_product) == 0


def test_same_as_the_plain_warehouse(spark, loaded):
    plain = Warehouse.from_staging(star.read_staging(spark, DATA))
    for name in ("customers", "products", "orders", "returns", "order_facts"):
        ours = getattr(loaded, name)
        theirs = getattr(plain, name).select(*ours.columns)
        assert ours.count() == theirs.count() and ours.exceptAll(theirs).count() == 0


def test_another_session_opens_the_buckets(spark, loaded):
    again = clustered.open_table(spark, f"{loaded.path}/products", ["product_id"], 8)
    facts_again = clustered.open_table(spark, f"{loaded.path}/order_returns", ["product_id"], 8)
    joined = facts.with_category(facts_again, again)
    assert exchanges(joined) == 0
    assert joined.exceptAll(loaded.order_facts.select(*joined.columns)).count() == 0


def test_the_number_of_buckets_follows_the_rows(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(clustered, "ROWS_PER_BUCKET", 2)
    rows = make.staging(*[{} for _ in range(30)])
    w = clustered.load_clustered(rows, str(tmp_path / "w"))
    assert "SelectedBucketsCount: 15 out of 15" in (
        w.order_facts._jdf.queryExecution().executedPlan().toString())
    assert w.order_facts.count() == 30
