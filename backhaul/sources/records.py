"""Lines of delimited files put together to records, without one task per file.

A quoted field may hold line breaks. A file is nevertheless read in splits: a line is inside a quoted
field if the quotes before it in its file are odd in number, so a first pass counts the quotes of
each split, and a second one, told which splits begin inside a field, joins lines to records as it
goes. Only the pieces of a record that crosses a split, two for each split at most, meet in a shuffle;
they come from a third pass over the few splits that begin or end inside a field.
A quote within a quoted field is written twice, as in RFC 4180.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'
WHOLE, HEAD, TAIL = 0, 1, 2
PIECES = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("split", T.LongType()),
    T.StructField("row", T.LongType()), T.StructField("first", T.BooleanType()),
    T.StructField("kind", T.IntegerType()), T.StructField("record", T.StringType())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the start of their split and an id that grows within a split."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))


def open_splits(lines: DataFrame) -> list[tuple[str, int, bool]]:
    """Splits that begin or end inside a quoted field, and whether they begin there.

    The driver gets less than one row per split; it planned those splits itself.
    """
    quotes = F.length("line") - F.length(F.translate("line", QUOTE, ""))
    earlier = (Window.partitionBy("file").orderBy("split")
               .rowsBetween(Window.unboundedPreceding, -1))
    states = (lines.groupBy("file", "split").agg((F.sum(quotes) % 2).alias("odd"))
              .withColumn("inside", F.coalesce(F.sum("odd").over(earlier) % 2, F.lit(0)))
              .filter("inside = 1 OR odd = 1").select("file", "split", "inside"))
    return [(r["file"], r["split"], r["inside"] == 1) for r in states.collect()]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Columns file, split, row, first and record; in the order of the first three, as in the files.

    ``first`` marks the first record of a file. Only the splits that begin or end inside a field are
    read once more for the pieces of records that cross them.
    """
    lines = _lines(spark, path)
    found = open_splits(lines)
    inside = spark.sparkContext.broadcast(frozenset((f, s) for f, s, began in found if began))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        held: list[str] = []
        start_row, first_row, is_open, began_inside = 0, 0, False, False

        def rows(file, split, row, kind, record) -> pa.RecordBatch:
            first = (split.to_numpy() == 0) & (row.to_numpy() == start_row)
            return pa.RecordBatch.from_arrays(
                [file, split, row, pa.array(first),
                 pa.array(np.full(len(row), kind, np.int32)), record], names=PIECES.names)

        def piece(kind: int) -> pa.RecordBatch:
            return rows(pa.array([at[0]], pa.string()), pa.array([at[1]], pa.int64()),
                        pa.array([first_row], pa.int64()), kind,
                        pa.array(["\n".join(held)], pa.string()))

        for batch in batches:
            files, starts = batch.column("file"), batch.column("split").to_numpy()
            # a task may read several splits, one after the other
            new = np.flatnonzero(np.append(True, (starts[1:] != starts[:-1]) | pc.not_equal(
                files[1:], files[:-1]).to_numpy(zero_copy_only=False)))
            for low, high in zip(new, [*new[1:], batch.num_rows]):
                part = batch.slice(low, high - low)
                file, split, row, line = map(part.column, ("file", "split", "row", "line"))
                here = (files[int(low)].as_py(), int(starts[low]))
                if here != at:
                    if held:
                        # the split ended within a record
                        yield piece(TAIL if began_inside else HEAD)
                    at, held = here, []
                    start_row = first_row = row[0].as_py()
                    is_open = began_inside = here in inside.value
                quotes = pc.count_substring(line, QUOTE).to_numpy() % 2
                before = np.append(int(is_open), (np.cumsum(quotes) + int(is_open)) % 2)
                is_open = bool(before[-1])
                # lines that begin a record; those ahead of the first one continue a record
                begin = np.flatnonzero(before[:-1] == 0)
                ahead = int(begin[0]) if len(begin) else part.num_rows
                if ahead:
                    held += line.slice(0, ahead).to_pylist()
                    if before[ahead] == 0:
                        yield piece(TAIL if began_inside else WHOLE)
                        held, began_inside = [], False
                bounds = np.append(begin, part.num_rows)
                if is_open and len(begin):
                    last = int(begin[-1])
                    held, first_row = line.slice(last).to_pylist(), row[last].as_py()
                    bounds = begin
                whole = pa.array(bounds[:-1])
                if len(whole):
                    of_record = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), line)
                    yield rows(file.take(whole), split.take(whole), row.take(whole), WHOLE,
                               pc.binary_join(of_record, "\n"))
        if held:
            yield piece(TAIL if began_inside else HEAD)

    kept = ("file", "split", "row", "first", "record")
    whole = lines.mapInArrow(run, PIECES).filter(F.col("kind") == WHOLE).select(*kept)
    if not found:
        return whole
    crossed = spark.createDataFrame([(f, s) for f, s, _ in found], "file string, split long")
    pieces = (lines.join(F.broadcast(crossed), ["file", "split"], "left_semi")
              .mapInArrow(run, PIECES))
    # a head is followed by the tails of its record, up to the next head of the file
    in_order = Window.partitionBy("file").orderBy("split", "row")
    parts = F.array_sort(F.collect_list(F.struct("split", "row", "first", "record")))
    crossing = (pieces.filter(F.col("kind") != WHOLE)
                .withColumn("head", F.sum((F.col("kind") == HEAD).cast("int")).over(in_order))
                .groupBy("file", "head").agg(parts.alias("parts"))
                .select("file", *[F.col("parts")[0][c].alias(c) for c in ("split", "row", "first")],
                        F.array_join(F.col("parts")["record"], "\n").alias("record")))
    return whole.unionByName(crossing)
