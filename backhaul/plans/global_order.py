"""Exact ordered calculations over a whole table without a single-task sort.

``SUM/RANK/NTILE OVER (ORDER BY value DESC, key)`` has no partition key, so Spark would sort
everything in one task. Here rows are cut into ordered buckets at split points taken from a
hash sample, each bucket is handled by its own task, and a small per-bucket table carries the
offset of everything ahead. Split points are pairs of value and key, so a value shared by a
third of all rows is cut as well. Any split points give the exact result; the sample only
decides how even the buckets are. Bucket membership is a pure function of the data, so
recomputing a lost task cannot change it.

``value`` sorts descending with NULL last, ``key`` ascending; ``key`` must be unique.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES_PER_BUCKET = 32
#: Rows that one task should order.
ROWS_PER_BUCKET = 1_000_000


def position(value: str, key: str) -> Column:
    """Ascending sort position of a row under ``value DESC NULLS LAST, key``."""
    return F.struct(F.col(value).isNull().alias("missing"),
                    (-F.col(value)).alias("value"),
                    F.col(key).alias("key"))


def bucket_count(df: DataFrame, buckets: int | None = None) -> int:
    """A power of two: enough for all tasks, and for buckets of ROWS_PER_BUCKET.

    Counts ``df``, which is cheap for the stored tables this is meant for.
    """
    wanted = buckets or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                            -(-df.count() // ROWS_PER_BUCKET))
    count = 1
    while count < wanted:
        count *= 2
    return count


def split_points(df: DataFrame, value: str, key: str, buckets: int) -> Column:
    """Scalar subquery: ``buckets - 1`` ascending positions that cut ``df`` evenly.

    The sample keeps about ``SAMPLES_PER_BUCKET * buckets`` rows however large ``df`` is.
    """
    wanted = buckets * SAMPLES_PER_BUCKET
    # Counting through the value column reads what the other steps read of `df`, so Spark can
    # reuse one exchange for all of them.
    rows = F.count(value) + F.count_if(F.col(value).isNull())
    keep_one_in = df.agg(F.greatest(F.lit(1), F.floor(rows / wanted)).alias("n")).scalar()
    sample = (df.filter(F.pmod(F.xxhash64(key), keep_one_in) == 0)
              .agg(F.array_sort(F.collect_list(position(value, key))).alias("seen")))
    cuts = F.transform(
        F.sequence(F.lit(1), F.lit(buckets - 1)),
        lambda i: F.get("seen", F.floor(F.size("seen") * i / buckets).cast("int")))
    return sample.select(cuts.alias("cuts")).scalar()


def with_bucket(df: DataFrame, value: str, key: str, buckets: int) -> DataFrame:
    """Adds ``_bucket``: the number of split points before the row.

    Binary search, one projection per step, which keeps it in generated code; a higher-order
    function over the split points would be interpreted row by row.
    """
    if buckets == 1:
        return df.withColumn("_bucket", F.lit(0))
    steps, low, step = [], F.lit(0), buckets // 2
    while step:
        beyond = F.get(F.col("_cuts"), low + (step - 1)) < F.col("_position")
        name = "_bucket" if step == 1 else f"_step_{step}"
        steps.append((low + F.when(beyond, F.lit(step)).otherwise(F.lit(0))).alias(name))
        low, step = F.col(name), step // 2
    # Each step refers to the one before by its alias; Spark nests the projections itself.
    return (df.select("*", split_points(df, value, key, buckets).alias("_cuts"),
                      position(value, key).alias("_position"), *steps)
            .select(*df.columns, "_bucket"))


def with_global_order(df: DataFrame, value: str, key: str, *, row_number: str | None = None,
                      rank: str | None = None, running_total: str | None = None,
                      buckets: int | None = None) -> DataFrame:
    """Adds the requested columns, each equal to its window over the whole of ``df``."""
    buckets = bucket_count(df, buckets)
    bucketed = with_bucket(df, value, key, buckets)

    offsets = _rank_offsets(bucketed, value) if rank else _offsets(bucketed, value)
    local = Window.partitionBy("_bucket").orderBy(F.desc_nulls_last(value), key)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    result = bucketed.join(F.broadcast(offsets), "_bucket")
    if row_number:
        result = result.withColumn(row_number, F.col("_rows_ahead") + F.row_number().over(local))
    if running_total:
        here = F.sum(value).over(upto)
        result = result.withColumn(running_total, F.coalesce(F.col("_sum_ahead") + here,
                                                             here, "_sum_ahead"))
    if rank:
        ties = Window.partitionBy("_bucket").orderBy(F.desc_nulls_last(value))
        result = result.withColumn(
            rank, F.when(F.col(value).eqNullSafe(F.col("_top")), F.col("_top_rank"))
            .otherwise(F.col("_rows_ahead") + F.rank().over(ties)))
    return result.select(*df.columns, *filter(None, (row_number, running_total, rank)))


# The per-bucket tables below have at most `buckets` rows, so their one-task windows and
# their broadcast are bounded by that number and not by the data.

def _ahead():
    return Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)


def _offsets(bucketed: DataFrame, value: str) -> DataFrame:
    """Per bucket: how many rows lie ahead of it and what they add up to."""
    return (bucketed.groupBy("_bucket")
            .agg(F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_sum"))
            .select("_bucket",
                    F.coalesce(F.sum("_rows").over(_ahead()), F.lit(0)).alias("_rows_ahead"),
                    F.sum("_sum").over(_ahead()).alias("_sum_ahead")))


def _rank_offsets(bucketed: DataFrame, value: str) -> DataFrame:
    """``_offsets`` plus the first value of each bucket and the rank of that value.

    A run of equal values can begin in an earlier bucket and cover several. It begins in the
    first bucket that ends with its value, at that bucket's end less the equal rows there. Those
    are counted in a second pass once the ends are known: both passes shuffle a row per task
    and bucket.
    """
    ends = bucketed.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(value).alias("_sum"),
        F.max(value).alias("_top"),
        F.when(F.count(value) == F.count(F.lit(1)), F.min(value)).alias("_bottom"))
    equal = (bucketed.join(F.broadcast(ends.select("_bucket", "_bottom")), "_bucket")
             .filter(F.col(value).eqNullSafe(F.col("_bottom")))
             .groupBy("_bucket").agg(F.count(F.lit(1)).alias("_bottom_rows")))
    totals = ends.join(equal, "_bucket")
    in_order = Window.orderBy("_bucket")
    run_start = (F.min(F.col("_rows_ahead") + F.col("_rows") - F.col("_bottom_rows") + 1)
                 .over(Window.partitionBy("_bottom")))
    continues = ((F.col("_rows_ahead") > 0)
                 & F.lag("_bottom").over(in_order).eqNullSafe(F.col("_top")))
    return (totals
            .withColumn("_rows_ahead", F.coalesce(F.sum("_rows").over(_ahead()), F.lit(0)))
            .withColumn("_sum_ahead", F.sum("_sum").over(_ahead()))
            .withColumn("_run_start", run_start)
            .withColumn("_top_rank", F.when(continues, F.lag("_run_start").over(in_order))
                        .otherwise(F.col("_rows_ahead") + 1))
            .select("_bucket", "_rows_ahead", "_sum_ahead", "_top", "_top_rank"))


def tile_cuts(df: DataFrame, value: str, key: str, tiles: int,
              buckets: int | None = None) -> Column:
    """Scalar subquery: positions of the last row of tiles 1 to ``tiles - 1``.

    Tile sizes follow NTILE: with ``n`` rows the first ``n % tiles`` tiles hold one row more.
    Only the few buckets that contain such a last row are sorted; all others are just counted.
    """
    buckets = bucket_count(df, buckets)
    bucketed = with_bucket(df.select(value, key), value, key, buckets)
    in_order = Window.orderBy("_bucket")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = F.array(*[
        ((F.col("_total") - F.col("_total") % tiles) / tiles).cast("long") * i
        + F.least(F.lit(i), F.col("_total") % tiles)
        for i in range(1, tiles)
    ])
    wanted = (
        bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_ahead", F.sum("_rows").over(in_order) - F.col("_rows"))
        .withColumn("_total", F.sum("_rows").over(everything))
        .withColumn("_ends", F.filter(F.array_distinct(ends), lambda e: (
            (e > F.col("_ahead")) & (e <= F.col("_ahead") + F.col("_rows")))))
        .filter(F.size("_ends") > 0)
        .select("_bucket", "_ahead", "_ends")
    )
    local = Window.partitionBy("_bucket").orderBy(F.desc_nulls_last(value), key)
    return (bucketed.join(F.broadcast(wanted), "_bucket")
            .withColumn("_number", F.col("_ahead") + F.row_number().over(local))
            .filter(F.array_contains("_ends", F.col("_number")))
            .agg(F.array_sort(F.collect_list(position(value, key))).alias("cuts"))
            .scalar())


def with_tile(df: DataFrame, population: DataFrame, value: str, key: str, tiles: int,
              column: str, buckets: int | None = None) -> DataFrame:
    """``NTILE(tiles)`` of ``population`` by comparing each row of ``df`` with the cuts.

    ``df`` itself is neither shuffled nor sorted. Its rows outside ``population`` get the
    tile their position would fall in.
    """
    here = position(value, key)
    return (df.withColumn("_cuts", tile_cuts(population, value, key, tiles, buckets))
            .withColumn("_position", here)
            .withColumn(column, F.size(F.filter("_cuts", lambda cut: cut < F.col("_position")))
                        + 1)
            .drop("_cuts", "_position"))
