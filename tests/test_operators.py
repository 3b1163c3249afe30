import datetime as dt

import pytest

from backhaul.operators import (categories, cohorts, customers, economics, fanout, impact, pareto,
                                products, reasons, revenue, risk, trend)


def orders_of(customer, n, returned, amount=10, **more):
    return [dict(order_id=f"{customer}-{i}", customer_id=customer, total_amount=amount,
                 returned=i < returned, **more) for i in range(n)]


def test_revenue_with_and_without_returns(make, collect):
    facts = make.facts(*orders_of("A", 4, 1))
    assert collect(revenue.net_revenue(facts)) == [
        dict(total_revenue=40, return_loss=10, net_revenue=30)]
    assert collect(revenue.return_rate(facts))[0]["return_rate"] == 0.25
    none = make.facts(*orders_of("A", 2, 0))
    assert collect(revenue.return_loss(none))[0]["return_loss"] is None
    assert collect(revenue.net_revenue(none))[0]["return_loss"] == 0


def test_ratios_of_empty_tables_are_null(make, collect):
    empty = make.facts(*orders_of("A", 1, 0)).limit(0)
    assert collect(revenue.return_rate(empty))[0]["return_rate"] is None
    assert collect(revenue.total_revenue(empty))[0]["total_revenue"] is None
    assert collect(economics.true_cost(empty))[0]["total_returns"] == 0
    assert collect(pareto.pareto_loss(empty)) == []


def test_top_customers_break_ties_by_id(make, collect):
    facts = make.facts(*[row for c in "DCBA" for row in orders_of(c, 1, 1)])
    top = collect(customers.top_loss_customers(facts, 2))
    assert sorted(r["customer_id"] for r in top) == ["A", "B"]


def test_customer_risk_uses_rounded_rate_products_the_raw_one(make, collect):
    # 5000 of 10001 is 0.49995: rounded to 0.5000, but below one half.
    rows = orders_of("A", 10001, 5000)
    facts = make.facts(*rows)
    customer = collect(customers.customer_return_risk(facts))[0]
    assert customer["return_rate"] == 0.5
    assert customer["behavior_segment"] == "High Return Risk"
    product = collect(products.product_return_risk(facts))[0]
    assert product["return_rate"] == 0.5 and product["risk_level"] == "Moderate Risk"


def test_risk_bounds_and_minimum_orders(make, collect):
    facts = make.facts(*orders_of("half", 4, 2), *orders_of("fifth", 5, 1),
                       *orders_of("none", 3, 0), *orders_of("few", 2, 2))
    found = collect(customers.customer_return_risk(facts), "customer_id")
    assert {c: r["behavior_segment"] for c, r in found.items()} == {
        "half": "High Return Risk", "fifth": "Moderate Return Risk", "none": "Low Return Risk"}


def test_every_customer_has_a_rate_row(make, collect):
    found = collect(customers.customer_return_rate_all(
        make.customers(dict(customer_id="A"), dict(customer_id="Z")),
        make.facts(*orders_of("A", 3, 1))), "customer_id")
    assert found["A"]["return_rate_pct"] == 33.33
    assert found["Z"] == dict(customer_id="Z", total_orders=0, total_returns=0,
                              return_rate_pct=None)


def test_product_rankings(make, collect):
    rows = []
    for product, loss in [("P1", 5), ("P2", 9), ("P3", 9), ("P4", 1), ("P5", 0)]:
        rows += [dict(order_id=f"{product}-{i}", product_id=product, returned=loss > 0 and i == 0,
                      total_amount=loss if i == 0 else 20) for i in range(3)]
    rows.append(dict(order_id="lost", product_id="P9", category=None, returned=True,
                     total_amount=99))
    facts = make.facts(*rows)
    ranks = collect(products.product_leakage_rank(facts, k=3), "product_id")
    assert {p: r["loss_rank"] for p, r in ranks.items()} == {"P2": 1, "P3": 1, "P1": 3}
    share = collect(products.product_loss_share(facts, buckets=4), "product_id")
    assert {p: r["loss_rank"] for p, r in share.items()} == {
        "P9": 1, "P2": 2, "P3": 2, "P1": 4, "P4": 5, "P5": 6}
    assert share["P9"]["total_loss"] == 123 and share["P9"]["pct_of_total"] == 9900 / 123
    curve = sorted(collect(pareto.pareto_loss(facts)), key=lambda r: r["cumulative_loss"])
    assert [(r["product_id"], r["cumulative_loss"], r["cumulative_pct"]) for r in curve] == [
        ("P2", 9, 37.5), ("P3", 18, 75.0), ("P1", 23, 95.83), ("P4", 24, 100.0)]
    assert collect(products.full_return_products(facts, 1)) == []


def test_categories(make, collect):
    facts = make.facts(dict(product_id="P1", category="A", returned=True),
                       dict(product_id="P1", category="A"), dict(product_id="P2", category="B"))
    assert [r["category"] for r in collect(categories.category_return_impact(facts))] == ["A"]
    summary = collect(categories.category_summary(facts), "category")
    assert summary["A"]["loss_rate"] == 0.5 and summary["B"]["return_loss"] == 0
    raw = collect(categories.category_loss_raw(facts), "category")
    assert raw["B"]["return_loss"] is None


def test_fanout(make, collect):
    orders = make.orders(dict(order_id="A", total_amount=7), dict(order_id="B", total_amount=3))
    staging = make.staging(*[dict(order_id="A", returned="Yes")] * 3,
                           dict(order_id="A"), dict(order_id="B"))
    assert collect(fanout.fanout_inflated_loss(orders, staging))[0]["inflated_return_loss"] == 21
    assert collect(fanout.fanout_corrected_loss(orders, staging))[0]["corrected_return_loss"] == 7
    audit = collect(fanout.fanout_audit(orders, staging, "order_id", "total_amount"))[0]
    assert audit == dict(inflated_sum=31, corrected_sum=10, max_copies=4, inflation_rate=2.1)


def test_staging_impact_drops_small_returners_but_keeps_small_buyers(make, collect):
    def copies(customer, n, yes):
        return [dict(customer_id=customer, returned="Yes" if i < yes else "No") for i in range(n)]
    staging = make.staging(*copies("few", 2, 1), *copies("quiet", 1, 0), *copies("high", 4, 2),
                           *copies("mid", 5, 1), *copies("low", 10, 1))
    found = collect(impact.customer_impact_staging(staging), "customer_id")
    assert {c: (r["behavior_segment"], r["impact_segment"]) for c, r in found.items()} == {
        "quiet": ("No Returns", "No Impact"), "high": ("High Risk", "High Impact"),
        "mid": ("Moderate Risk", "Low Impact"), "low": ("Low Risk", "Low Impact")}


def test_impact_quintile_counts_customers_without_returns(make, collect):
    # Ten customers, so the first tile holds two; eight never returned anything.
    facts = make.facts(*[row for i in range(8) for row in orders_of(f"N{i}", 3, 0)],
                       *orders_of("A", 3, 1), *orders_of("B", 3, 1))
    found = collect(impact.customer_impact(facts), "customer_id")
    assert [c for c, r in sorted(found.items()) if r["impact_segment"] == "High Impact"] == [
        "A", "B"]
    assert found["N0"]["impact_segment"] == "No Impact" and len(found) == 10


def test_segment_summary_shares(make, collect):
    facts = make.facts(*orders_of("A", 4, 2, amount=30), *orders_of("B", 4, 1, amount=20),
                       *orders_of("C", 5, 1, amount=20), *orders_of("D", 3, 0))
    found = collect(impact.segment_summary(impact.customer_impact(facts)), "behavior_segment")
    assert found["High Risk"]["loss_share_pct"] == 60.0
    assert found["Moderate Risk"] == dict(
        behavior_segment="Moderate Risk", customers=2, avg_return_rate_pct=22.5,
        total_revenue=180, return_loss=40, loss_share_pct=40.0, avg_loss_per_customer=20.0)
    assert found["No Returns"]["loss_share_pct"] == 0.0


def test_monthly_trend_and_monitor(make, collect):
    facts = make.facts(dict(order_date="2023-01-31", returned=True),
                       dict(order_date="2023-01-01"), dict(order_date="2023-01-02"),
                       dict(order_date="2023-03-01"))
    months = collect(trend.monthly_trend(facts), "month")
    assert set(months) == {"2023-01", "2023-03"}
    assert months["2023-01"]["return_rate"] == 0.3333 and months["2023-01"]["net_revenue"] == 20
    rows = collect(trend.sku_month_monitor(facts))
    january = [r for r in rows if r["month"] == "2023-01"]
    assert {r["level"]: r["product_id"] for r in january} == {"sku": "P1", "category": None}
    assert all(r["alert"] for r in january)
    assert not any(r["alert"] for r in rows if r["month"] == "2023-03")


def test_cohorts(make, collect):
    facts = make.facts(
        dict(customer_id="A", order_date="2022-12-31"),
        dict(customer_id="A", order_date="2023-01-01", returned=True),
        dict(customer_id="A", order_date="2023-01-20"),
        dict(customer_id="B", order_date="2022-12-01"),
        dict(customer_id="C", order_date="2023-01-05"))
    assert collect(cohorts.cohort_retention(facts)) == [
        dict(cohort_month="2022-12-01", cohort_customers=2, months_since_first_order=1,
             active_customers=1, retention_rate_pct=50.0)]
    sizes = collect(cohorts.cohort_size(facts), "cohort_month")
    assert {c: r["new_customers_acquired"] for c, r in sizes.items()} == {
        "2022-12-01": 2, "2023-01-01": 1}
    grid = [r for r in collect(cohorts.cohort_return_rate(facts))
            if r["months_since_first_order"] == 1]
    assert grid[0]["total_orders"] == 2 and grid[0]["return_rate"] == 0.5


def test_reasons(make, collect):
    facts = make.facts(
        dict(customer_id="A", returned=True, return_reason="Defective", total_amount=30),
        dict(customer_id="A", returned=True, return_reason=None, total_amount=10),
        dict(customer_id="A", returned=True, return_reason="Odd", total_amount=30),
        dict(customer_id="A"))
    summary = collect(reasons.reason_summary(facts), "return_reason")
    assert summary[None]["pct_of_returns"] == 33.33 and summary["Odd"]["pct_of_loss"] == 42.86
    dominant = collect(reasons.dominant_reason(facts))
    assert {r["dominant_reason"] for r in dominant} == {"Defective", "Odd"}
    actions = collect(reasons.reason_actions(facts), "return_reason")
    assert actions[None]["recommended_action"] == actions["Odd"]["recommended_action"] \
        == reasons.UNKNOWN_ACTION
    assert actions["Defective"]["recommended_action"] == reasons.ACTIONS["Defective"]
    segment = collect(reasons.reason_by_segment(facts))
    assert {r["behavior_segment"] for r in segment} == {"High Risk"} and len(segment) == 3
    assert collect(reasons.reason_by_segment(facts, min_orders=5)) == []
    assert collect(reasons.moderate_reason_crosstab(facts)) == []


def test_margin_bands(make, collect):
    margins = {"Negative Margin": [-1], "Zero Margin": [0], "Low Margin (0–10)": [0.01, 10],
               "Mid Margin (10–50)": [10.01, 50], "High Margin (50+)": [50.01, None]}
    facts = make.facts(*[dict(returned=True, profit_margin=v)
                         for values in margins.values() for v in values])
    rows = collect(economics.margin_bands(facts))
    assert [r["margin_band"] for r in rows] == list(margins)
    assert [r["return_count"] for r in rows] == [1, 1, 2, 2, 2]


def test_economic_total_leaves_out_incomplete_orders(make, collect):
    facts = make.facts(dict(returned=True, total_amount=10, profit_margin=2, shipping_cost=3),
                       dict(returned=True, total_amount=10, profit_margin=None),
                       dict(returned=True, total_amount=10, shipping_cost=None))
    cost = collect(economics.true_cost(facts))[0]
    assert cost["revenue_loss"] == 30 and cost["total_economic_loss"] == 15
    assert cost["avg_economic_loss_per_return"] == 15
    top = collect(economics.top_economic_losses(facts, 2))
    assert [r["total_economic_loss"] for r in top] == [15, None]


def test_negative_gross_margin_flips_the_sign(make, collect):
    facts = make.facts(dict(returned=True, profit_margin=2), dict(profit_margin=-6))
    assert collect(economics.margin_adjusted_rate(facts))[0]["margin_return_rate"] == -0.5


def test_risk_features_know_only_the_past(make, collect):
    facts = make.facts(
        dict(order_id="first", order_date="2023-01-01", returned=True,
             request_date="2023-01-05"),
        dict(order_id="same day", order_date="2023-01-01"),
        dict(order_id="before request", order_date="2023-01-05"),
        dict(order_id="after request", order_date="2023-01-06"),
        dict(order_id="stranger", order_date="2023-01-07", customer_id="C2"))
    found = collect(risk.order_risk_features(facts), "order_id")
    assert {o: (r["customer_prior_orders"], r["customer_prior_returns"])
            for o, r in found.items()} == {
        "first": (0, 0), "same day": (0, 0), "before request": (2, 0), "after request": (3, 1),
        "stranger": (0, 0)}
    assert found["first"]["customer_prior_rate"] is None
    assert found["stranger"]["category_prior_returns"] == 1
    scores = collect(risk.order_risk_score(risk.order_risk_features(facts)), "order_id")
    assert scores["first"]["risk_score"] == 0
    assert scores["stranger"]["risk_score"] == pytest.approx(0.25)
    assert scores["after request"]["risk_score"] == pytest.approx((1 + 5 / 3) / 8)


def test_identities(make, collect):
    rows = [dict(customer_id=f"C{i % 7}", product_id=f"P{i % 11}", category=f"G{i % 11 % 3}",
                 total_amount=i, profit_margin=i % 60 - 5, returned=i % 4 == 0,
                 return_reason=f"R{i % 3}", order_date=dt.date(2023, 1 + i % 12, 1))
            for i in range(200)]
    facts = make.facts(*rows).cache()
    loss = collect(revenue.return_loss(facts))[0]["return_loss"]
    for table, column in [
            (categories.category_return_impact(facts), "return_loss"),
            (reasons.reason_summary(facts), "return_loss"),
            (economics.margin_bands(facts), "revenue_loss"),
            (trend.monthly_trend(facts), "return_loss"),
            (cohorts.cohort_return_rate(facts), "return_loss"),
            (pareto.pareto_loss(facts), "total_loss")]:
        assert sum(r[column] for r in collect(table)) == loss
    curve = [r["cumulative_pct"] for r in sorted(collect(pareto.pareto_loss(facts)),
                                                 key=lambda r: r["cumulative_loss"])]
    assert curve == sorted(curve) and curve[-1] == 100.0
    facts.unpersist()
