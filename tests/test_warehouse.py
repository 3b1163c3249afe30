import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backhaul import Warehouse
from backhaul.operators import facts, load, marts, products, revenue
from backhaul.operators.facts import with_category
from backhaul.plans.shared import shared_folder
from backhaul.schemas import ORDER_GROUP
from backhaul.sources import star
from conftest import DATA


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warehouse"))
    staging = star.read_staging(spark, DATA)
    Warehouse.load(staging, path)
    return Warehouse.load(staging, path)  # a second load replaces the first


def test_known_totals(loaded, collect):
    assert loaded.staging.count() == 6000 and loaded.orders.count() == 4599
    assert loaded.returns.count() == 893 and loaded.products.count() == 1905
    assert collect(revenue.net_revenue(loaded.order_returns)) == [dict(
        total_revenue=2300523.84, return_loss=439219.95, net_revenue=1861303.89)]


def test_loaded_equals_derived(spark, loaded):
    derived = Warehouse.from_staging(star.read_staging(spark, DATA).repartition(5))
    columns = loaded.order_facts.columns
    ours, theirs = loaded.order_facts, derived.order_facts.select(*columns)
    assert ours.exceptAll(theirs).count() == 0 and theirs.exceptAll(ours).count() == 0


def test_reads_only_needed_columns(loaded):
    plan = revenue.return_loss(loaded.order_returns)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "ReadSchema: struct<total_amount:decimal(12,2),returned:boolean>" in text
    assert "EqualTo(returned,true)" in text or "IsNotNull(returned)" in text
    assert text.count("Exchange") == 1


def test_hot_product_is_split_at_run_time(spark, tmp_path):
    """A third of the orders share one product; adaptive execution splits its partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        orders = spark.range(0, 60000, 1, 8).select(
            F.col("id").cast("string").alias("order_id"),
            F.when(F.col("id") % 3 == 0, "hot")
             .otherwise(F.concat(F.lit("p"), F.col("id") % 3000)).alias("product_id"),
            F.sha2(F.col("id").cast("string"), 256).alias("filler"))
        (orders.select("product_id").distinct().withColumn("category", F.lit("c"))
         .write.parquet(str(tmp_path / "products")))
        joined = with_category(orders, spark.read.parquet(str(tmp_path / "products")))
        rows = joined.collect()
        assert len(rows) == 60000 and all(row["category"] == "c" for row in rows)
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_marts(spark, loaded, tmp_path):
    path = str(tmp_path)
    marts.write_marts(loaded, path)
    manifest = {(r["page"], r["mart"]): r["row_count"]
                for r in marts.mart_manifest(spark, path).collect()}
    assert manifest["tables", "orders"] == 4599 and manifest["revenue", "monthly_trend"] == 80
    january = spark.read.parquet(f"{path}/tables/orders").filter("order_month = '1996-01'")
    assert january.count() == loaded.orders.filter(
        F.date_format("order_date", "yyyy-MM") == "1996-01").count() > 0
    marts.write_csv(revenue.net_revenue(loaded.order_returns), f"{path}/csv")
    assert spark.read.csv(f"{path}/csv", header=True).count() == 1


class _Conf:
    def __init__(self, **values):
        self.conf = self
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


def test_shared_folder_follows_the_session():
    named = _Conf(**{"spark.checkpoint.dir": "hdfs://x/dir/", "spark.master": "yarn"})
    assert shared_folder(named, "a").startswith("hdfs://x/dir/backhaul-a-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(_Conf(**{"spark.master": "yarn"}), "a")
    assert shared_folder(_Conf(**{"spark.master": "local[2]"}), "a")


@pytest.fixture(scope="module")
def grouped(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grouped"))
    return Warehouse.load(star.read_staging(spark, DATA, 4), path, groups=4)


def test_grouped_load_equals_plain_load(loaded, grouped):
    for name in ("staging", "customers", "products", "orders", "returns", "order_facts"):
        ours, theirs = getattr(grouped, name), getattr(loaded, name)
        assert ours.schema.names == theirs.schema.names
        assert ours.exceptAll(theirs).count() == 0 and theirs.exceptAll(ours).count() == 0


def test_copies_of_a_grouped_order_are_not_moved(grouped):
    def exchanges(rows):
        rows.collect()
        return rows._jdf.queryExecution().executedPlan().toString().count("Exchange")

    assert exchanges(load.orders_dedup(grouped.grouped)) == 0
    assert exchanges(load.returns_clean(grouped.grouped)) == 0
    assert exchanges(load.orders_with_return(grouped.grouped)) == 0
    assert exchanges(load.orders_dedup(grouped.staging)) > 0


def test_grouped_staging_is_dealt_once(spark):
    plan = star.read_staging(spark, DATA, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(l_orderkey") == 1


def test_order_with_return_in_one_pass_equals_the_join(make):
    rows = make.staging(
        dict(order_id="1-1", ingest_seq=1, returned="No", request_date="1/1/2023"),
        dict(order_id="1-1", ingest_seq=3, returned="Yes", request_date="3/1/2023",
             return_reason=None, category="Toys"),
        dict(order_id="1-1", ingest_seq=2, returned="Yes", request_date="31/2/2023",
             return_reason="Defective"),
        dict(order_id="1-2", ingest_seq=1, returned=None),
        dict(order_id="2-1", ingest_seq=2, returned="Yes", request_date=None, return_reason=None),
        dict(order_id="2-1", ingest_seq=1, returned="No", category=None),
        dict(order_id=None, ingest_seq=1, returned="Yes", request_date="5/1/2023"),
        dict(order_id="3-1", ingest_seq=1, returned="yes"))
    dealt = rows.withColumn(ORDER_GROUP, F.substring_index("order_id", "-", 1).cast("long"))
    joined = facts.order_returns(load.orders_with_own_category(rows), load.returns_clean(rows))
    ours = load.orders_with_return(dealt).select(*joined.columns)
    assert ours.exceptAll(joined).count() == 0 and joined.exceptAll(ours).count() == 0
    assert load.orders_dedup(dealt).columns == rows.columns


def test_marts_summarise_products_once_and_do_not_move_the_orders(loaded, tmp_path, monkeypatch):
    summaries, hints = [], []
    summary, hint = products.product_summary, DataFrame.hint
    monkeypatch.setattr(products, "product_summary",
                        lambda rows: (summaries.append(1), summary(rows))[1])
    monkeypatch.setattr(DataFrame, "hint",
                        lambda self, *a: (hints.append(a[0]), hint(self, *a))[1])
    marts.write_marts(loaded, str(tmp_path / "marts"))
    assert len(summaries) == 1 and "rebalance" not in hints
