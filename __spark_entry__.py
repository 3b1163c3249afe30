"""Registered queries: each takes (spark, directory of the star tables) and returns a frame.

The tables are cleaned and loaded once per application and directory, like the load step that
precedes every analysis; the queries then read the loaded tables. They are kept in the folder
named by ``spark.checkpoint.dir``; without it there is one clear error, except in local mode.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from backhaul import Warehouse  # noqa: E402
from backhaul import clustered, versions  # noqa: E402
from backhaul.operators import (categories, cohorts, constraints, customers, dictionary,  # noqa: E402
                                economics, fanout, impact, load, marts, pareto, products, quality,
                                reasons, revenue, risk, trend)
from backhaul.plans.shared import RELEASE, remove, settings, shared_folder  # noqa: E402
from backhaul.schemas import INGEST_SEQ, STAGING  # noqa: E402
from backhaul.sources import star  # noqa: E402
from backhaul.streaming import chain, jobs  # noqa: E402

try:
    from backhaul.llm import queries as llm  # noqa: E402
except ImportError:
    llm = None
try:
    import corpus_pipeline as pipeline  # noqa: E402
except ImportError:
    pipeline = None

#: Micro-batches of the registered streams take so many files each.
STREAM_FILES = 16
#: Records of a compressed CSV file.
CSV_RECORDS = 500_000
_LOADED: dict[tuple, Warehouse] = {}
_STORED: dict[tuple, str] = {}


def _changed(spark: SparkSession, directory: str) -> tuple:
    """Modification times of the star tables, so changed input is loaded anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen())
                        for f in files.listStatus(path)))


def warehouse(spark: SparkSession, directory: str) -> Warehouse:
    key = (spark.conf.get("spark.app.id"), os.path.normpath(directory), _changed(spark, directory))
    if key not in _LOADED:
        groups = star.group_count(spark, directory)
        _LOADED[key] = Warehouse.load(star.read_staging(spark, directory, groups),
                                      shared_folder(spark, "warehouse"), groups=groups)
    return _LOADED[key]


def _present(rows: DataFrame) -> DataFrame:
    """Money as double, integers as bigint, dates as text, so results compare anywhere."""
    target = {T.DecimalType: "double", T.IntegerType: "bigint", T.DateType: "string"}
    return rows.select([
        F.col(f.name).cast(target[type(f.dataType)]).alias(f.name)
        if type(f.dataType) in target else F.col(f.name) for f in rows.schema
    ])


def _folder(w: Warehouse, purpose: str) -> str:
    return shared_folder(w.staging.sparkSession, purpose)


def _rows(w: Warehouse) -> DataFrame:
    """Staging, with its rows of an order together if it was loaded so."""
    return w.staging if w.grouped is None else w.grouped


def _once(w: Warehouse, purpose: str, store: Callable[[str], object]) -> str:
    """The folder that ``store`` filled, the first time anything of this warehouse asked."""
    if (w.path, purpose) not in _STORED:
        folder = _folder(w, purpose)
        store(folder)
        _STORED[w.path, purpose] = folder
    return _STORED[w.path, purpose]


def _marts(w: Warehouse) -> str:
    return _once(w, "marts", lambda folder: marts.write_marts(w, folder))


def _mart(page: str, name: str) -> Callable[[Warehouse], DataFrame]:
    """What was stored for a report page."""
    return lambda w: w.staging.sparkSession.read.parquet(f"{_marts(w)}/{page}/{name}")


def _quarantine(w: Warehouse) -> DataFrame:
    """Rows kept and set aside by a load that enforces the constraints, and which they broke."""
    spark = w.staging.sparkSession
    folder = _once(w, "enforced", lambda f: Warehouse.load(
        _rows(w), f, mode="quarantine", groups=w.groups))
    parts = []
    for name in ("customers", "products", "orders", "returns"):
        kept = "order_facts" if name == "orders" else name
        aside = spark.read.parquet(f"{folder}/quarantine/{name}")
        parts.append(spark.read.parquet(f"{folder}/{kept}").agg(
            F.lit(name).alias("table_name"), F.lit("kept").alias("rule"),
            F.count(F.lit(1)).alias("row_count")))
        parts.append(aside.select(F.explode("violations").alias("rule")).groupBy("rule")
                     .agg(F.count(F.lit(1)).alias("row_count"))
                     .select(F.lit(name).alias("table_name"), "rule", "row_count"))
    return reduce(DataFrame.unionByName, parts)


def _reloaded(w: Warehouse) -> DataFrame:
    """Row counts after a second full refresh over the first: the same tables again."""
    spark = w.staging.sparkSession

    def twice(folder: str) -> None:
        Warehouse.load(_rows(w), folder, groups=w.groups)
        Warehouse.load(_rows(w), folder, groups=w.groups)

    folder = _once(w, "reloaded", twice)
    return reduce(DataFrame.unionByName, [
        spark.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("table_name"),
                                                   F.count(F.lit(1)).alias("row_count"))
        for name in ("staging", "customers", "products", "returns", "order_facts")])


def _versioned(w: Warehouse) -> DataFrame:
    """Two versions, the second with other amounts in the last month: which version holds each
    part, and the revenue that readers of either version see."""
    spark = w.staging.sparkSession
    day = load.parse_date("order_date")

    def twice(folder: str) -> None:
        versions.refresh(_rows(w), folder, w.groups)
        last = w.order_facts.agg(F.trunc(F.max("order_date"), "month").alias("month")).scalar()
        changed = F.when(F.trunc(day, "month") == last, F.col("total_amount") + 1)
        versions.refresh(_rows(w).withColumn(
            "total_amount", F.coalesce(changed, "total_amount").cast("decimal(12,2)")),
            folder, w.groups)

    folder = _once(w, "versions", twice)
    parts = versions.manifest(spark, folder).select("table_name", "part", "version", "row_count")
    for version in (1, 2):
        revenue_then = (versions.read_table(spark, folder, "order_facts", version)
                        .groupBy("part").agg(F.sum("total_amount").alias(f"revenue_{version}"))
                        .withColumn("table_name", F.lit("order_facts")))
        parts = parts.join(revenue_then, ["table_name", "part"], "left")
    return parts


def _clustered_facts(w: Warehouse) -> DataFrame:
    """The facts of a load into buckets, whose joins need no exchange."""
    return clustered.load_clustered(w.staging, _folder(w, "clustered")).order_facts.filter(
        "category IS NOT NULL")


def _csv_warehouse(w: Warehouse) -> Warehouse:
    """Loaded from files: the staging rows as wide CSV in load order, with quotes and line breaks,
    and a record with an unreadable number after each row of quantity 13. The files are compressed and
    each is read by one task, so they hold a limited number of records."""
    spark = w.staging.sparkSession

    def store(folder: str) -> None:
        order = ["order_id", INGEST_SEQ, "broken"]
        texts = [F.col(f.name).cast("string").alias(f.name) for f in STAGING]
        rows = (w.staging.withColumn("broken", F.explode(
                    F.when(F.col("quantity") == 13, F.array(F.lit(False), F.lit(True)))
                    .otherwise(F.array(F.lit(False)))))
                .repartitionByRange(*order).sortWithinPartitions(*order)
                .select("broken", *texts))
        rows = (
            rows.withColumn("quantity", F.when(F.col("broken"), "many").otherwise(F.col("quantity")))
            .withColumn("order_id", F.when(F.col("broken"), F.concat("order_id", F.lit("-broken")))
                        .otherwise(F.col("order_id")))
            .withColumn("return_reason", F.regexp_replace("return_reason", "Not as ", "Not as\n"))
            .withColumn("payment_method", F.regexp_replace("payment_method", "URGENT", '"URGENT"'))
            .drop("broken"))
        with settings(spark, {RELEASE: "true"}):
            (rows.write.option("compression", "gzip").option("maxRecordsPerFile", CSV_RECORDS)
             .csv(f"{folder}/files", header=True, escape='"'))
        Warehouse.load_csv(spark, f"{folder}/files", f"{folder}/tables")
        remove(spark, f"{folder}/files")

    tables = _once(w, "csv", store) + "/tables"
    return replace(Warehouse.read(spark, tables),
                   malformed=spark.read.parquet(f"{tables}/malformed"))


def _arrivals(w: Warehouse, table: str, rows: DataFrame, day: Column) -> str:
    """The folder of the table's rows as files in the order of their quarters."""
    return _once(w, f"arrivals-{table}", lambda f: jobs.store_arrivals(rows, day, f))


def _streamed(w: Warehouse, purpose: str, job: Callable[..., DataFrame], *tables: str
              ) -> DataFrame:
    """What a job emits over the tables' arrivals; their last windows stay open."""
    spark = w.staging.sparkSession
    source = {"order_facts": (w.order_facts, F.col("order_date")),
              "returns": (w.returns, F.col("request_date"))}
    folders = [_arrivals(w, table, *source[table]) for table in tables]
    streams = [jobs.read_files(spark, f"{folder}/arrivals/*", source[table][0].schema, STREAM_FILES)
               for table, folder in zip(tables, folders)]
    return jobs.run_to_parquet(job(*streams), _folder(w, f"stream-{purpose}"),
                               partitions=jobs.state_partitions(spark, *folders))


def _ended(w: Warehouse, purpose: str, job: Callable[..., DataFrame],
           **sources: tuple[DataFrame, Column, dict]) -> DataFrame:
    """What a job has emitted after its streams have ended; a source is its rows, their day, and
    the columns of the row that ends it."""
    spark = w.staging.sparkSession
    streams, folders = [], []
    for name, (rows, day, _) in sources.items():
        # arrivals of this call alone: an ended stream takes no more rows
        folder = _folder(w, f"arrivals-{name}-{purpose}")
        jobs.store_arrivals(rows, day, folder)
        streams.append(jobs.read_files(spark, f"{folder}/arrivals/*", rows.schema, STREAM_FILES))
        folders.append(folder)
    out = _folder(w, f"stream-{purpose}")
    jobs.run_to_parquet(job(*streams), out, partitions=jobs.state_partitions(spark, *folders))
    for (rows, _, end), folder in zip(sources.values(), folders):
        jobs.end_arrivals(spark, rows.schema, folder, **end)
    emitted = jobs.run_to_parquet(job(*streams), out)
    # an ended stream is not run again
    for folder in (*folders, f"{out}/checkpoint"):
        remove(spark, folder)
    return emitted


def _stream_dedup(w: Warehouse) -> DataFrame:
    end = {"order_date": jobs.END.strftime("%d/%m/%Y")}
    return _ended(w, "dedup", jobs.dedup, staging=(
        w.staging, load.parse_date("order_date"), end)).drop(INGEST_SEQ)


def _windows(kpi: DataFrame) -> DataFrame:
    return (kpi.withColumn("window_start", F.to_date("window_start"))
            .withColumn("window_end", F.to_date("window_end")))


def _stream_loss_kpi(w: Warehouse) -> DataFrame:
    return _windows(_streamed(w, "kpi", jobs.loss_kpi, "order_facts"))


def _stream_loss_kpi_ended(w: Warehouse) -> DataFrame:
    return _windows(_ended(w, "kpi", jobs.loss_kpi, order_facts=(
        w.order_facts, F.col("order_date"), {"order_date": jobs.END})))


def _joined(rows: DataFrame) -> DataFrame:
    return rows.select("order_id", "customer_id", "total_amount",
                       F.to_date("order_time").alias("order_date"),
                       F.to_date("request_time").alias("request_date"),
                       "return_reason", "returned")


def _stream_order_returns(w: Warehouse) -> DataFrame:
    return _joined(_streamed(w, "returns", jobs.order_returns, "order_facts", "returns"))


def _stream_order_returns_ended(w: Warehouse) -> DataFrame:
    return _joined(_ended(
        w, "order-returns", jobs.order_returns,
        order_facts=(w.order_facts, F.col("order_date"), {"order_date": jobs.END}),
        returns=(w.returns, F.col("request_date"),
                 {"request_date": jobs.END, "order_id": "the end"})))


def _stream_chain(w: Warehouse) -> DataFrame:
    """From raw order and return rows to finished windows, in one query."""
    end = jobs.END.strftime("%d/%m/%Y")
    increments = _ended(
        w, "chain", chain.loss_increments,
        orders=(w.staging, load.parse_date("order_date"),
                {"order_date": end, "order_id": "the end"}),
        returns=(w.staging.filter(F.col("returned") == load.RETURNED),
                 load.parse_date("request_date"),
                 {"request_date": end, "order_id": "the end", "returned": load.RETURNED}))
    return _windows(chain.merged(increments))


def _stream_category_spike(w: Warehouse) -> DataFrame:
    return (_streamed(w, "spikes", jobs.category_spikes, "order_facts")
            .select(F.to_date("window_start").alias("window_start"),
                    F.to_date("window_end").alias("window_end"), "category", "total_orders",
                    "returned_orders", "total_revenue", "return_loss", "net_revenue",
                    "return_rate", "baseline_rate", "spike"))


def _trained_risk(w: Warehouse) -> DataFrame:
    """Scores of the later orders by a model of the earlier ones."""
    spark = w.staging.sparkSession
    features = _once(w, "risk-features", lambda folder: risk.order_risk_features(w.order_facts)
                     .write.parquet(folder))
    features = spark.read.parquet(features)
    outcomes = w.returns.select("order_id", "request_date")
    return risk.trained_risk_score(features, risk.train_risk(features, outcomes))


def _returned_rows(w: Warehouse) -> DataFrame:
    return w.staging.filter(F.col("returned") == load.RETURNED)


OPERATORS: dict[str, Callable[[Warehouse], DataFrame]] = {
    "staging": lambda w: w.staging.drop(INGEST_SEQ),
    "customers_dim": lambda w: load.customers_dim(w.staging),
    "products_dim": lambda w: load.products_dim(w.staging),
    "category_conflicts": lambda w: load.category_conflicts(w.staging),
    "orders_dedup": lambda w: load.orders_dedup(_rows(w)).drop(INGEST_SEQ),
    "orders_clean": lambda w: load.orders_clean(_rows(w)),
    "returns_clean": lambda w: load.returns_clean(_rows(w)),
    "constraint_report": lambda w: constraints.constraint_report(
        w.customers, w.products, w.orders, w.returns),
    "orders_dedup_report": lambda w: load.dedup_report(w.staging, w.orders, w.returns),
    "order_facts": lambda w: w.order_facts,
    "write_marts": lambda w: marts.mart_manifest(w.staging.sparkSession, _marts(w)),
    **{f"mart_{name}": _mart(page, name) for page, names in marts.PAGES.items()
       for name in names},
    "load_quarantine": _quarantine,
    "reload": _reloaded,
    "versioned_refresh": _versioned,
    "clustered_facts": _clustered_facts,
    "staging_csv": lambda w: _csv_warehouse(w).staging.drop(INGEST_SEQ),
    "csv_dq_report": lambda w: quality.dq_report(_csv_warehouse(w)),
    "schema_report": lambda w: dictionary.schema_report({
        "staging": w.staging, "customers": w.customers, "products": w.products,
        "orders": w.orders, "returns": w.returns}),

    "total_revenue": lambda w: revenue.total_revenue(w.orders),
    "return_loss": lambda w: revenue.return_loss(w.order_returns),
    "net_revenue": lambda w: revenue.net_revenue(w.order_returns),
    "return_rate": lambda w: revenue.return_rate(w.order_returns),

    "top_loss_customers": lambda w: customers.top_loss_customers(w.order_returns),
    "top_value_customers": lambda w: customers.top_value_customers(w.orders),
    "customer_return_risk": lambda w: customers.customer_return_risk(w.order_returns),
    "customer_return_rate_all": lambda w: customers.customer_return_rate_all(
        w.customers, w.order_returns),

    "top_revenue_products": lambda w: products.top_revenue_products(w.order_facts),
    "top_returned_products": lambda w: products.top_returned_products(w.order_facts),
    "product_return_risk": lambda w: products.product_return_risk(w.order_facts),
    "full_return_products": lambda w: products.full_return_products(w.order_facts),
    "product_leakage_rank": lambda w: products.product_leakage_rank(w.order_facts),
    "product_loss_share": lambda w: products.product_loss_share(w.order_returns),
    "pareto_loss": lambda w: pareto.pareto_loss(w.order_facts),

    "category_revenue": lambda w: categories.category_revenue(w.order_facts),
    "category_return_rate": lambda w: categories.category_return_rate(w.order_facts),
    "category_return_impact": lambda w: categories.category_return_impact(w.order_facts),
    "category_summary": lambda w: categories.category_summary(w.order_facts),
    "category_loss_raw": lambda w: categories.category_loss_raw(w.order_facts),

    "fanout_inflated_loss": lambda w: fanout.fanout_inflated_loss(w.orders, w.staging),
    "fanout_corrected_loss": lambda w: fanout.fanout_corrected_loss(w.orders, w.staging),
    "fanout_audit": lambda w: fanout.fanout_audit(w.orders, _returned_rows(w), "order_id",
                                                  "total_amount"),
    "monthly_trend": lambda w: trend.monthly_trend(w.order_returns),

    "customer_impact_staging": lambda w: impact.customer_impact_staging(w.staging),
    "customer_impact": lambda w: impact.customer_impact(w.order_returns),
    "segment_summary": lambda w: impact.segment_summary(
        impact.customer_impact_staging(w.staging)),

    "cohort_retention": lambda w: cohorts.cohort_retention(w.orders),
    "cohort_size": lambda w: cohorts.cohort_size(w.orders),
    "cohort_return_rate": lambda w: cohorts.cohort_return_rate(w.order_returns),

    "reason_summary": lambda w: reasons.reason_summary(w.order_returns),
    "reason_by_category": lambda w: reasons.reason_by_category(w.order_facts),
    "dominant_reason": lambda w: reasons.dominant_reason(w.order_facts),
    "reason_by_region": lambda w: reasons.reason_by_region(w.order_returns),
    "reason_by_segment": lambda w: reasons.reason_by_segment(w.order_returns),
    "moderate_reason_crosstab": lambda w: reasons.moderate_reason_crosstab(w.order_returns),
    "reason_actions": lambda w: reasons.reason_actions(w.order_returns),

    "true_cost": lambda w: economics.true_cost(w.order_returns),
    "category_true_cost": lambda w: economics.category_true_cost(w.order_facts),
    "category_true_cost_raw": lambda w: economics.category_true_cost_raw(w.order_facts),
    "margin_bands": lambda w: economics.margin_bands(w.order_returns),
    "margin_adjusted_rate": lambda w: economics.margin_adjusted_rate(w.order_facts),
    "top_economic_losses": lambda w: economics.top_economic_losses(w.order_facts),

    "order_risk_features": lambda w: risk.order_risk_features(w.order_facts),
    "order_risk_score": lambda w: risk.order_risk_score(risk.order_risk_features(w.order_facts)),
    "sku_month_monitor": lambda w: trend.sku_month_monitor(w.order_facts),

    "stream_dedup": _stream_dedup,
    "stream_loss_kpi": _stream_loss_kpi,
    "stream_order_returns": _stream_order_returns,
    "stream_category_spike": _stream_category_spike,
    "stream_loss_kpi_ended": _stream_loss_kpi_ended,
    "stream_order_returns_ended": _stream_order_returns_ended,
    "stream_chain": _stream_chain,

    "dq_report": quality.dq_report,
    **{name: check.run for name, check in quality.CHECKS.items()},
}


#: Results of trained models, which SQL cannot state; the tests measure them.
LEARNED: dict[str, Callable[[Warehouse], DataFrame]] = {"order_risk_trained": _trained_risk}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(operator: Callable[[Warehouse], DataFrame]):
        return lambda spark, directory: _present(operator(warehouse(spark, directory)))

    return {
        **{name: bind(operator) for name, operator in {**OPERATORS, **LEARNED}.items()},
        **(llm.queries() if llm else {}),
        **({"pipeline": pipeline.run} if pipeline else {}),
    }


def entry(spark: SparkSession) -> DataFrame:
    """Customers by return behaviour and financial impact."""
    return queries()["customer_impact"](spark, "/root/testdata/sf0.001")


def oracle_sql() -> dict[str, str]:
    from duckdb_twins import twins

    sql = {**twins(), **(llm.oracle_sql() if llm else {})}
    if pipeline and pipeline.ORACLE_SQL:
        sql["pipeline"] = pipeline.ORACLE_SQL
    return sql
