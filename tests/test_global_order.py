"""The bucketed forms must equal the plain windows, however the buckets fall."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from backhaul.plans.global_order import tile_cuts, with_global_order, with_tile


def frame(spark, values):
    rows = [(f"K{i:05d}", None if v is None else Decimal(v)) for i, v in enumerate(values)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "key string, value decimal(12,2)")


def cases():
    rnd = random.Random(7)
    hot = [0] * 700 + [rnd.randint(1, 40) for _ in range(800)]
    return {
        "distinct": [rnd.randint(-10**6, 10**6) for _ in range(1500)],
        "third of rows share a value": hot,
        "one value": [5] * 300,
        "with nulls": [None, 3, None, 1, 3, None, 2] * 30,
        "single row": [1],
    }


@pytest.mark.parametrize("name, buckets", [
    ("distinct", 16), ("third of rows share a value", 1), ("third of rows share a value", 2),
    ("third of rows share a value", 64), ("one value", 16), ("with nulls", 16),
    ("single row", 4)])
def test_equals_plain_windows(spark, name, buckets):
    df = frame(spark, cases()[name])
    order = Window.orderBy(F.desc_nulls_last("value"), "key")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    literal = (df.withColumn("n", F.row_number().over(order).cast("long"))
               .withColumn("r", F.rank().over(Window.orderBy(F.desc_nulls_last("value")))
                           .cast("long"))
               .withColumn("s", F.sum("value").over(running)))
    ours = with_global_order(df, "value", "key", row_number="n", rank="r", running_total="s",
                             buckets=buckets)
    pick = ["key", "value", "n", "r", "s"]

    def rows(frame):
        return sorted((tuple(row) for row in frame.select(*pick).collect()), key=lambda t: t[0])

    assert rows(ours) == rows(literal)


@pytest.mark.parametrize("n", [1, 3, 4, 5, 7, 14, 1500])
def test_tiles_equal_ntile(spark, n):
    rnd = random.Random(n)
    df = frame(spark, [rnd.randint(0, 9) for _ in range(n)])
    order = Window.orderBy(F.desc("value"), "key")
    both = with_tile(df, df, "value", "key", 5, "tile", buckets=8).withColumn(
        "expected", F.ntile(5).over(order))
    assert both.filter(F.col("tile") != F.col("expected")).count() == 0


def test_empty(spark):
    df = frame(spark, [])
    assert with_global_order(df, "value", "key", rank="r", running_total="s").count() == 0
    assert with_tile(df, df, "value", "key", 5, "tile").count() == 0


def test_hot_value_is_cut_into_even_buckets(spark):
    from backhaul.plans.global_order import with_bucket
    df = frame(spark, [0] * 3000 + list(range(1, 3001)))
    sizes = [r["count"] for r in with_bucket(df, "value", "key", 16)
             .groupBy("_bucket").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * 6000 / 16


def test_cuts_compare_rows_without_moving_them(spark):
    df = frame(spark, range(100))
    plan = with_tile(df, df, "value", "key", 5, "tile")._jdf.queryExecution().executedPlan()
    top = plan.toString().split("Subquery")[0]
    assert "Exchange" not in top and "Window" not in top
    assert tile_cuts(df, "value", "key", 5) is not None
