"""What was known about an order's return risk when it was placed, and scores from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backhaul.functions import metrics as m
from backhaul.operators.facts import categorised
from backhaul.plans.shared import stored

#: Totals per category and day that may be broadcast.
FEW_TOTALS = 500_000
PLACED, BACK = "placed", "came_back"


def _sums_before(window) -> list[Column]:
    return [F.coalesce(F.sum(c).over(window), F.lit(0)).alias(c) for c in (PLACED, BACK)]


def _events(facts: DataFrame, key: str) -> DataFrame:
    """Orders on their day and known returns on theirs: before that nobody knew of them. An order
    event carries its row."""
    row = F.struct(*facts.columns)
    return (facts.select(key, F.inline(F.array(
        F.struct(F.col("order_date").alias("day"), F.lit(1).alias(PLACED), F.lit(0).alias(BACK),
                 row.alias("order")),
        F.struct(F.when(F.col("returned"), F.col("request_date")).alias("day"),
                 F.lit(0).alias(PLACED), F.lit(1).alias(BACK),
                 F.lit(None).cast(facts.select(row.alias("r")).schema["r"].dataType)
                 .alias("order")))))
        .filter(F.col("day").isNotNull()))


def with_customer_history(facts: DataFrame) -> DataFrame:
    """Dated orders with the customer's orders and known returns strictly before their day.

    Orders, returns and one carry row per customer and month, the totals of all earlier months,
    are one stream of events, sorted once by customer, month and day: a running sum over each
    month gives the history, and no order is joined back. The busiest customer is spread over its
    months; only its totals per month meet.
    """
    events = _events(facts, "customer_id").withColumn("month", F.trunc("day", "month"))
    so_far = (Window.partitionBy("customer_id").orderBy("month")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = (events.groupBy("customer_id", "month")
             .agg(F.sum(PLACED).alias(PLACED), F.sum(BACK).alias(BACK))
             .select("customer_id", F.date_sub("month", 1).alias("day"), *_sums_before(so_far),
                     "month")
             .withColumn("order", F.lit(None).cast(events.schema["order"].dataType)))
    stream = (events.withColumns({c: F.col(c).cast("long") for c in (PLACED, BACK)})
              .unionByName(carry).withColumn("_day", F.unix_date("day")))
    before = (Window.partitionBy("customer_id", "month").orderBy("_day")
              .rangeBetween(Window.unboundedPreceding, -1))
    prior_orders, prior_returns = _sums_before(before)
    return (stream.select("order", prior_orders.alias("customer_prior_orders"),
                          prior_returns.alias("customer_prior_returns"))
            .filter(F.col("order").isNotNull())
            .select("order.*", "customer_prior_orders", "customer_prior_returns"))


def category_totals(facts: DataFrame) -> DataFrame:
    """Orders and known returns of a category strictly before each day with an order.

    Events collapse to one row per category and day ahead of the running sum, so even the window
    of the busiest category is bounded by the number of days.
    """
    daily = (_events(facts.select("category", "order_date", "request_date", "returned"),
                     "category").groupBy("category", "day")
             .agg(F.sum(PLACED).alias(PLACED), F.sum(BACK).alias(BACK)))
    before = (Window.partitionBy("category").orderBy("day")
              .rowsBetween(Window.unboundedPreceding, -1))
    prior_orders, prior_returns = _sums_before(before)
    return (daily.select("category", F.col("day").alias("order_date"), PLACED,
                         prior_orders.alias("category_prior_orders"),
                         prior_returns.alias("category_prior_returns"))
            .filter(F.col(PLACED) > 0).drop(PLACED))


def order_risk_features(facts: DataFrame, few: int = FEW_TOTALS) -> DataFrame:
    """Per order: the customer's and the category's history, amount, region, payment.

    Prior rates are not rounded; they are NULL without prior orders. An order without a date
    has no before: it is kept, its history is NULL. The totals per category and day are stored and
    counted; up to ``few`` they are sent to the orders, beyond that both sides are shuffled.
    """
    known = categorised(facts).select(
        "order_id", "customer_id", "category", "order_date", "total_amount", "region",
        "payment_method", "returned", "request_date")
    totals = stored(category_totals(known), "category-days")
    if totals.count() <= few:
        totals = F.broadcast(totals)
    undated = known.filter(F.col("order_date").isNull())
    nothing = F.lit(None).cast("long")
    return (with_customer_history(known).join(totals, ["category", "order_date"], "left")
            .unionByName(undated.withColumns({f"{key}_prior_{what}": nothing
                                              for key in ("customer", "category")
                                              for what in ("orders", "returns")}))
            .select("order_id", "customer_id", "category", "order_date", "total_amount", "region",
                    "payment_method", "returned", "customer_prior_orders",
                    "customer_prior_returns", "category_prior_orders", "category_prior_returns",
                    m.quotient(F.col("customer_prior_returns"), F.col("customer_prior_orders"))
                    .alias("customer_prior_rate"),
                    m.quotient(F.col("category_prior_returns"), F.col("category_prior_orders"))
                    .alias("category_prior_rate")))


def _smoothed_rate(strength: float) -> Column:
    baseline = F.coalesce("category_prior_rate", F.lit(0.0))
    return ((F.col("customer_prior_returns") + F.lit(strength) * baseline)
            / (F.col("customer_prior_orders") + F.lit(strength)))


def order_risk_score(features: DataFrame, strength: float = 5.0) -> DataFrame:
    """The customer's prior return rate, smoothed towards the category's.

    ``strength`` is the number of imagined orders at the category's rate added to the
    customer's own history; a customer without history scores the category's rate. Orders
    without a date have no score.
    """
    return features.select("order_id", "customer_id", "category", "order_date", "returned",
                           _smoothed_rate(strength).alias("risk_score"))


# ---- a trained score -------------------------------------------------------------------------

@dataclass(frozen=True)
class RiskModel:
    """A fitted model and the first day that it has not seen."""

    pipeline: PipelineModel
    cutoff: object


#: Numbers of the model; each is 0 where there is nothing to know.
NUMBERS = {
    "log_amount": lambda: F.log1p(F.greatest(F.col("total_amount").cast("double"), F.lit(0.0))),
    "log_orders": lambda: F.log1p("customer_prior_orders"),
    "log_returns": lambda: F.log1p("customer_prior_returns"),
    "rate": lambda: _smoothed_rate(5.0),
    "rate_logit": lambda: F.log((_smoothed_rate(5.0) + 0.01) / (1.01 - _smoothed_rate(5.0))),
    "category_rate": lambda: F.col("category_prior_rate"),
    "no_history": lambda: (F.col("customer_prior_orders") == 0).cast("double"),
}
TEXTS = ("region", "payment_method")


def _model_input(features: DataFrame) -> DataFrame:
    return features.withColumns(
        {f"_{name}": F.coalesce(make().cast("double"), F.lit(0.0))
         for name, make in NUMBERS.items()}
        # no name of a category may be empty
        | {f"_{name}": F.concat(F.lit("="), F.coalesce(name, F.lit(""))) for name in TEXTS})


def time_cutoff(features: DataFrame, share: float = 0.7):
    """The first day after the earliest ``share`` of dated orders."""
    day = F.percentile_approx(F.unix_date("order_date"), F.lit(share), F.lit(100_000))
    return features.agg(F.date_from_unix_date(day).alias("day")).first()["day"]


def train_risk(features: DataFrame, outcomes: DataFrame, share: float = 0.7) -> RiskModel:
    """Logistic regression on the orders before the cutoff, with what was known on that day.

    ``outcomes`` (order_id, request_date of returned orders) tells which returns had been asked for
    by then; later ones are not looked at. The fit is distributed and sums over the rows.
    """
    cutoff = time_cutoff(features, share)
    if cutoff is None:
        raise ValueError("no dated orders to learn from")
    known = (outcomes.filter(F.col("request_date") < F.lit(cutoff))
             .select("order_id", F.lit(1.0).alias("_label")))
    rows = (_model_input(features.filter(F.col("order_date") < F.lit(cutoff)))
            .join(known, "order_id", "left")
            .withColumn("_label", F.coalesce("_label", F.lit(0.0)))
            .select("_label", *[f"_{name}" for name in (*NUMBERS, *TEXTS)]))
    rows = stored(rows, "risk-training")
    index = StringIndexer(inputCols=[f"_{t}" for t in TEXTS],
                          outputCols=[f"_{t}_index" for t in TEXTS], handleInvalid="keep",
                          stringOrderType="alphabetAsc")
    encode = OneHotEncoder(inputCols=index.getOutputCols(),
                           outputCols=[f"_{t}_vector" for t in TEXTS], handleInvalid="keep")
    gather = VectorAssembler(inputCols=[*[f"_{n}" for n in NUMBERS], *encode.getOutputCols()],
                             outputCol="_features")
    fit = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=1e-3,
                             maxIter=50, probabilityCol="_probability",
                             rawPredictionCol="_raw", predictionCol="_prediction")
    return RiskModel(Pipeline(stages=[index, encode, gather, fit]).fit(rows), cutoff)


def trained_risk_score(features: DataFrame, model: RiskModel) -> DataFrame:
    """Orders from the cutoff on: the probability of a return, and the smoothed rate beside it."""
    later = features.filter(F.col("order_date") >= F.lit(model.cutoff))
    return (model.pipeline.transform(_model_input(later))
            .select("order_id", "customer_id", "category", "order_date", "returned",
                    vector_to_array("_probability")[1].alias("risk_score"),
                    _smoothed_rate(5.0).alias("baseline_score")))


def log_loss(column: str) -> Column:
    """Mean log loss of a score against ``returned``, for ``agg``; scores are kept off 0 and 1."""
    p = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col(column)))
    return -F.avg(F.when(F.col("returned"), F.log(p)).otherwise(F.log(1 - p)))
