"""Bounded, reproducible samples of labelled documents for training, and the single fit on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backhaul.llm.batches import crc_fold


def hash_share(column: Column) -> Column:
    """A number in [0, 1) that depends on the value only."""
    return F.pmod(F.xxhash64(column.cast("string")), F.lit(1 << 30)) / (1 << 30)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, max_rows: int,
                    held_out: tuple[int, int] | None, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """Columns id, text and label of about ``max_rows`` labelled documents at most.

    ``held_out`` = (folds, remainder) leaves out ids whose crc32 has that remainder. Rows of
    labels without a value are no labels; of several for one id the largest holds. The choice
    depends on ids only. The chosen ids number ``max_rows`` on average and are broadcast.
    """
    known = (labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("label"))
             .filter("id IS NOT NULL AND label IS NOT NULL"))
    if held_out:
        known = known.filter(crc_fold("id", held_out[0]) != held_out[1])
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    share = max_rows / max(known.count(), 1)
    if share < 1:
        known = known.filter(hash_share(F.col("id")) < share)
    return (documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
            .join(F.broadcast(known), "id"))


def fit_once(sample: DataFrame, train: Callable[[pa.Table], bytes]) -> bytes:
    """``train`` on a bounded sample, in one task; the model comes to the driver.

    Rows reach ``train`` in any order. An empty sample still trains.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([train(pa.Table.from_batches(got) if got else None)], pa.binary())],
            names=["model"])

    schema = T.StructType([T.StructField("model", T.BinaryType())])
    models = sample.repartition(1).mapInArrow(run, schema).collect()
    return models[0].model if models else train(None)
