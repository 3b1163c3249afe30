"""Return indicators over arriving files, as Structured Streaming jobs.

Event time is the order date (or request date) at midnight UTC. A backlog is stored first in the
order of its quarters (``store_arrivals``), so no dated row is ever more than a quarter behind the newest
one before it. The jobs wait DELAY for late rows, which is more, so the result does not depend on
how the files are cut into batches. A run that nevertheless drops a row for being late fails.
Results in append mode appear once the watermark has passed them; ``end_arrivals`` makes it pass all.
"""

import datetime as dt
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from backhaul.functions import metrics as m
from backhaul.operators.load import parse_date
from backhaul.plans.shared import CODEC, RELEASE, remove, settings, write_table
from backhaul.schemas import INGEST_SEQ

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEFAULT_STORE = ("org.apache.spark.sql.execution.streaming.state."
                 "HDFSBackedStateStoreProvider")
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
PROGRESS_KEPT = "spark.sql.streaming.numRecentProgressUpdates"
#: A stream goes on from its last batch: older states are deleted, which Spark looks for at times, and
#: what left the state is not kept in its files.
STATES_KEPT = {"spark.sql.streaming.minBatchesToRetain": "2",
               "spark.sql.streaming.stateStore.rocksdb.compactOnCommit": "true",
               "spark.sql.streaming.stateStore.maintenanceInterval": "10s"}
PARTITIONS = "spark.sql.shuffle.partitions"
#: Stored bytes of a stream for each partition of its state.
BYTES_PER_PARTITION = 32_000_000
#: Longer than a quarter; half a day more, as all event times are midnights.
DELAY = "93 days 12 hours"
#: Folders of arrivals: rows without a date come first, the end of a stream last.
UNDATED, ENDED = "0000", "9999"
#: The date of the row that ends a stream.
END = dt.date(3000, 1, 1)


def store_arrivals(rows: DataFrame, day: Column, path: str) -> str:
    """Stores rows so that files are ordered by quarter; returns the folder to stream.

    One pass splits the rows by quarter, in files of the session's advisory size, then each quarter
    is copied in turn without another shuffle: a file source reads older files first. What was copied
    is deleted, so the rows are there once. Rows without a date have no place in time; they come first.
    """
    spark = rows.sparkSession
    quarter = F.concat(F.year(day), F.lit("-"), F.quarter(day))
    split = f"{path}/split"
    write_table(rows.withColumn("_quarter", F.coalesce(quarter, F.lit(UNDATED)))
                .hint("rebalance", "_quarter"), split, "_quarter", mode="error")
    schema = T.StructType([*rows.schema.fields, T.StructField("_quarter", T.StringType())])
    stored = spark.read.schema(schema).parquet(split)
    # one row per quarter, whatever the number of rows
    for found in sorted(r["_quarter"] for r in stored.select("_quarter").distinct().collect()):
        write_table(stored.filter(F.col("_quarter") == found).drop("_quarter"),
                    f"{path}/arrivals/{found}", mode="error")
        remove(spark, f"{split}/_quarter={found}")
    remove(spark, split)
    return f"{path}/arrivals/*"


def end_arrivals(spark: SparkSession, schema: T.StructType, path: str, **end: object) -> None:
    """One more file, with a row so late that everything before it is finished.

    ``end`` gives its date and what a job asks not to be null (a join its key), all its other
    columns are null; it is itself never emitted, as nothing comes after it. Jobs that are run
    again then bring out the windows and orders still open. A stream that has ended takes no more
    rows.
    """
    row = tuple(end.get(f.name) for f in schema)
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    spark.createDataFrame([row], loose).write.parquet(f"{path}/arrivals/{ENDED}")


def read_files(spark: SparkSession, path: str, schema: T.StructType,
               files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; new files are picked up as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _midnight(date: Column) -> Column:
    return date.cast("timestamp")


def dedup(staging: DataFrame, delay: str = DELAY, undated_as: str = "1970-01-01") -> DataFrame:
    """The first row in load order of each order id, as the batch load keeps it.

    Copies of an order may have different dates: all that lie within ``delay`` of each other are
    one group, and the row appears once the watermark has passed the last of them by ``delay``.
    Rows without a date count as of ``undated_as``, the time before the stream; they have to come
    first.
    """
    first = F.min_by(F.struct(*staging.columns), F.col(INGEST_SEQ))
    day = F.coalesce(parse_date("order_date"), F.lit(undated_as).cast("date"))
    return (staging.withColumn("event_time", _midnight(day))
            .withWatermark("event_time", delay)
            .groupBy(F.session_window("event_time", delay), "order_id")
            .agg(first.alias("first"))
            .select("first.*"))


def loss_kpi(orders: DataFrame, width: str = "30 days", slide: str | None = None,
             delay: str = DELAY, by: tuple[str, ...] = ()) -> DataFrame:
    """Orders, returns, gross, loss, net and return rate per window of order time.

    An order without a date is in no window; ``dq_report`` counts those.
    """
    windows = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    gross = F.sum("total_amount")
    return (orders.filter(F.col("order_date").isNotNull())
            .withColumn("event_time", _midnight(F.col("order_date")))
            .withWatermark("event_time", delay)
            .groupBy(windows, *by)
            .agg(m.order_count().alias("total_orders"),
                 m.return_count().alias("returned_orders"),
                 gross.alias("total_revenue"),
                 m.loss().alias("return_loss"),
                 (gross - m.loss()).alias("net_revenue"),
                 m.rate(m.return_count(), m.order_count()).alias("return_rate"))
            .select(F.col("window.start").alias("window_start"),
                    F.col("window.end").alias("window_end"), *by,
                    "total_orders", "returned_orders", "total_revenue", "return_loss",
                    "net_revenue", "return_rate"))


def order_returns(orders: DataFrame, returns: DataFrame, within: str = "90 days",
                  delay: str = DELAY) -> DataFrame:
    """Orders with the return requested up to ``within`` after the order, if any.

    An order without one is emitted when the watermark shows that none can follow; its state
    is dropped then, so state is bounded by ``within`` plus ``delay``. Orders and requests
    without a date cannot be placed and are left out, as ``dq_report`` says.
    """
    orders = orders.filter(F.col("order_date").isNotNull())
    returns = returns.filter(F.col("request_date").isNotNull())
    placed = (orders.select("order_id", "customer_id", "total_amount",
                            _midnight(F.col("order_date")).alias("order_time"))
              .withWatermark("order_time", delay))
    requested = (returns.select(F.col("order_id").alias("returned_id"), "return_reason",
                                _midnight(F.col("request_date")).alias("request_time"))
                 .withWatermark("request_time", delay))
    limit = F.col("order_time") + F.expr(f"INTERVAL {within}")
    matches = ((F.col("order_id") == F.col("returned_id"))
               & (F.col("request_time") >= F.col("order_time"))
               & (F.col("request_time") <= limit))
    return (placed.join(requested, matches, "left_outer")
            .select("order_id", "customer_id", "total_amount", "order_time", "request_time",
                    "return_reason", F.col("returned_id").isNotNull().alias("returned")))


class TrailingWindows(StatefulProcessor):
    """Gives each finished window of a category the totals of the ``trailing`` ones before it.

    The state of a category is a list of that many pairs, however long the stream runs.
    """

    def __init__(self, trailing: int):
        self.trailing = trailing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "returned_orders long, total_orders long")

    def handleInputRows(self, key, rows, timerValues):
        # windows of one width finish in their order; within a batch they come in any
        batch = pd.concat(rows).sort_values("window_start", ignore_index=True)
        seen = [(int(r), int(t)) for r, t in self.seen.get()]
        before = []
        for returned, total in zip(batch["returned_orders"], batch["total_orders"]):
            before.append((sum(r for r, _ in seen), sum(t for _, t in seen)))
            seen = [*seen, (int(returned), int(total))][-self.trailing:]
        self.seen.put(seen)
        yield batch.assign(earlier_returned=[r for r, _ in before],
                           earlier_orders=[t for _, t in before])

    def close(self) -> None:
        pass


def category_spikes(facts: DataFrame, width: str = "30 days", delay: str = DELAY,
                    trailing: int = 6, factor: float = 1.5) -> DataFrame:
    """Finished windows of each category, as a stream, marked where the return rate exceeds
    ``factor`` times the trailing baseline.

    The baseline is the pooled return rate of the category's ``trailing`` earlier windows that had
    orders; a category's first window has none and is never a spike. Two stateful operators follow
    each other: open windows, and per category the totals of its last finished ones.
    """
    known = facts.filter(F.col("category").isNotNull())
    finished = loss_kpi(known, width, delay=delay, by=("category",))
    counted = T.StructType([*finished.schema.fields, T.StructField("earlier_returned", T.LongType()),
                            T.StructField("earlier_orders", T.LongType())])
    scored = finished.groupBy("category").transformWithStateInPandas(
        TrailingWindows(trailing), counted, "append", "None")
    baseline = m.quotient(F.col("earlier_returned"), F.col("earlier_orders"))
    current = m.quotient(F.col("returned_orders"), F.col("total_orders"))
    return (scored.withColumn("baseline_rate", F.round(baseline, 4))
            .withColumn("spike", F.coalesce(current > F.lit(factor) * baseline, F.lit(False)))
            .drop("earlier_returned", "earlier_orders"))


class LateRows(RuntimeError):
    """Rows that came after the watermark: the input is less ordered than ``delay`` allows."""


def state_partitions(spark: SparkSession, *folders: str) -> int:
    """How many partitions the state of jobs over stored arrivals needs.

    Each partition of each stateful operator is a store that is opened and committed in every
    micro-batch, whether it got rows or not. So a small stream has one for each core, or the
    session's number if that is less, and a large one as many as its bytes ask for.
    """
    size = 0
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/arrivals")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        size += files.getContentSummary(path).getLength()
    return max(-(-size // BYTES_PER_PARTITION),
               min(int(spark.conf.get(PARTITIONS)), spark.sparkContext.defaultParallelism))


def _run(stream: DataFrame, path: str, start: Callable, allow_late: bool = False,
         partitions: int | None = None) -> None:
    """Processes all files there are; rows dropped as late are an error unless allowed.

    State lives in RocksDB unless the session names a store: it may exceed memory. A job that is
    run again keeps the ``partitions`` of its first run.
    """
    spark = stream.sparkSession
    wanted = {PROGRESS_KEPT: "100000", RELEASE: "true", **STATES_KEPT}
    # Spark reports its default store for an unset key, so ask what was set
    named = STATE_STORE in {k for k, _ in spark.sparkContext.getConf().getAll()}
    if not named and spark.conf.get(STATE_STORE, None) in (None, DEFAULT_STORE):
        wanted[STATE_STORE] = ROCKSDB
    if partitions:
        wanted[PARTITIONS] = str(partitions)
    with settings(spark, wanted):
        query = start(stream.writeStream.outputMode("append")
                      .option("checkpointLocation", f"{path}/checkpoint")
                      .trigger(availableNow=True))
        query.awaitTermination()
        late = sum(operator.numRowsDroppedByWatermark for progress in query.recentProgress
                   for operator in progress.stateOperators)
    if late and not allow_late:
        raise LateRows(f"{late} rows came after the watermark; allow a longer delay")


def run_to_parquet(stream: DataFrame, path: str, allow_late: bool = False,
                   partitions: int | None = None) -> DataFrame:
    """Processes all files there are, then returns what has been emitted so far."""
    _run(stream, path, lambda writer: writer.format("parquet").option("compression", CODEC)
         .start(f"{path}/data"), allow_late, partitions)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")
