import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from backhaul.operators import risk


def brute(rows):
    """(customer orders, customer returns, category orders, category returns) before each order."""
    found = {}
    for r in rows:
        if r["order_date"] is None:
            found[r["order_id"]] = (None,) * 4
            continue
        found[r["order_id"]] = tuple(
            sum(o[key] == r[key] and (o["order_date"] or "9") < r["order_date"]
                if what == "orders" else
                o[key] == r[key] and o["returned"] and (o["request_date"] or "9") < r["order_date"]
                for o in rows)
            for key in ("customer_id", "category") for what in ("orders", "returns"))
    return found


def random_rows(n, seed):
    rng = random.Random(seed)

    def day():
        return str(dt.date(2022, 11, 20) + dt.timedelta(days=rng.randrange(150)))
    rows = []
    for i in range(n):
        p = rng.randrange(6)
        rows.append(dict(order_id=f"O{i}", product_id=f"P{p}", category="XYZ"[p % 3],
                         customer_id="hot" if i % 3 == 0 else f"C{rng.randrange(8)}",
                         order_date=None if i % 17 == 0 else day(), returned=rng.random() < 0.4,
                         request_date=None if i % 13 == 0 else day()))
    return rows


@pytest.mark.parametrize("few", [0, 500_000])
def test_history_against_brute_force(make, few):
    rows = random_rows(160, 3)
    got = risk.order_risk_features(make.facts(*rows), few).collect()
    assert len(got) == len(rows)
    assert {r["order_id"]: (r["customer_prior_orders"], r["customer_prior_returns"],
                            r["category_prior_orders"], r["category_prior_returns"])
            for r in got} == brute(rows)


def test_orders_are_shuffled_once_and_joined_to_few_totals(spark, make, tmp_path):
    make.facts(*random_rows(60, 5)).write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    plan = risk.order_risk_features(facts)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    by_customer = [line for line in plan.splitlines()
                   if "Exchange hashpartitioning(customer_id" in line]
    # the events, the totals per month and their running sum; none by category and day
    assert len(by_customer) <= 3 and "hashpartitioning(category" not in plan


def test_a_hot_customer_is_spread_over_months(make):
    plan = risk.with_customer_history(make.facts(dict())).\
        _jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(customer_id" in plan
    window = [line for line in plan.splitlines() if "Window" in line and "range" in line.lower()]
    assert any("month" in line for line in window)


def test_trained_score_beats_the_smoothed_rate(spark):
    scores = entry.queries()["order_risk_trained"](spark, "/root/testdata/sf0.01")
    row = scores.agg(risk.log_loss("risk_score").alias("trained"),
                     risk.log_loss("baseline_score").alias("rate"),
                     F.min("risk_score").alias("low"), F.max("risk_score").alias("high"),
                     F.count(F.lit(1)).alias("n")).first()
    assert row["n"] > 10_000 and 0 <= row["low"] < row["high"] <= 1
    assert row["trained"] < row["rate"], row


def test_training_does_not_look_ahead(make):
    """Returns asked for after the cutoff change nothing that is learned."""
    rows = random_rows(120, 8)
    features = risk.order_risk_features(make.facts(*rows)).cache()
    outcomes = make.facts(*rows).filter("returned").select("order_id", "request_date").cache()
    cutoff = risk.time_cutoff(features)
    model = risk.train_risk(features, outcomes)
    honest = risk.train_risk(features, outcomes.filter(F.col("request_date") < F.lit(cutoff)))
    a, b = ([round(r["risk_score"], 9) for r in
             risk.trained_risk_score(features, m).orderBy("order_id").collect()]
            for m in (model, honest))
    assert a == b and model.cutoff == cutoff
    later = {r["order_id"] for r in features.filter(F.col("order_date") >= F.lit(cutoff)).collect()}
    assert len(a) == len(later) > 0


def test_nothing_to_learn_from(make):
    features = risk.order_risk_features(make.facts(dict(order_date=None)))
    with pytest.raises(ValueError, match="no dated orders"):
        risk.train_risk(features, make.returns(dict(order_id="x")))
