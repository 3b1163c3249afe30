"""Near-duplicate embeddings: random-hyperplane signs in several tables, checked by cosine.

Equal vectors are one class, found by a digest. Each class has one sign pattern per table; classes
that share a pattern of a table meet, in blocks of bounded size, where matrix products give their
cosines in double precision. The numbers of signs and tables follow from the number of classes,
so that buckets stay of one size and a pair at the threshold is missed with probability
``miss`` at most. A pair found in several tables counts in the first. Blocks return link counts
and a spanning forest, never pairs, and connected components follow from the forests.

Vectors that are null, empty, zero or have null or non-finite components link with nothing, nor
do rows with a null id; vectors of different lengths never link. Rows that repeat are vectors of
their own. Of equal ids that could name a component the smallest does. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backhaul.llm.components import connected_components
from backhaul.llm.scratch import Scratch

#: Classes that should meet in one bucket, and at most in one side of a block.
BUCKET, BLOCK = 1000, 2048


def layout(classes: int, threshold: float, miss: float) -> tuple[int, int]:
    """Signs per table and tables."""
    agree = 1 - math.acos(threshold) / math.pi
    signs = max(2, math.ceil(math.log2(max(classes, 1) / BUCKET))) if classes > 2 * BUCKET else 2
    return signs, math.ceil(math.log(miss) / math.log(1 - agree ** signs))


def planes(dimension: int, signs: int, tables: int) -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((dimension, signs * tables))


def _usable(column: pa.ListArray) -> list[np.ndarray | None]:
    out = []
    for x in column:
        v = None
        if x.is_valid and len(x) and not x.values.null_count:
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(v).all() or not (v != 0).any():
                v = None
        out.append(v)
    return out


def classes_of(rows: DataFrame) -> DataFrame:
    """``rows`` (id, vec) with ``key``, a digest of the vector; null where it links with nothing."""
    schema = T.StructType([*rows.schema.fields, T.StructField("key", T.BinaryType())])

    def run(batches):
        for batch in batches:
            keys = [None if v is None or not i.is_valid else
                    hashlib.sha256((v + 0.0).tobytes()).digest()[:16]
                    for v, i in zip(_usable(batch.column("vec")), batch.column("id"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())],
                                             names=[*batch.schema.names, "key"])

    return rows.mapInArrow(run, schema)


def signed(classes: DataFrame, signs: int, tables: int) -> DataFrame:
    """Classes with ``patterns``, their sign pattern in each table."""
    schema = T.StructType([*classes.schema.fields,
                           T.StructField("patterns", T.ArrayType(T.IntegerType()))])

    def run(batches):
        weights = (1 << np.arange(signs)).astype(np.int64)
        for batch in batches:
            patterns = []
            for x in batch.column("vec"):
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                v = v / np.abs(v).max()
                bits = (v @ planes_of(len(v), signs, tables) >= 0).reshape(tables, signs)
                patterns.append((bits @ weights).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(patterns, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "patterns"])

    return classes.mapInArrow(run, schema)


_PLANES: dict[tuple[int, int, int], np.ndarray] = {}


def planes_of(dimension: int, signs: int, tables: int) -> np.ndarray:
    key = (dimension, signs, tables)
    if key not in _PLANES:
        _PLANES.clear()
        _PLANES[key] = planes(*key)
    return _PLANES[key]


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def linked_pairs(x: np.ndarray, patterns: np.ndarray, side: np.ndarray, table: int,
                 threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one block with a cosine of ``threshold`` or more, first met in ``table``.

    ``side`` tells a block's halves apart: if there are two, only pairs across them are its own.
    """
    u, two = unit(x), side.any() and not side.all()
    left = np.flatnonzero(side == 0) if two else np.arange(len(x))
    right = np.flatnonzero(side == 1) if two else left
    found = []
    for at in range(0, len(left), 512):
        rows = left[at:at + 512]
        a, b = np.nonzero(u[rows] @ u[right].T >= threshold)
        a, b = rows[a], right[b]
        if not two:
            a, b = a[a < b], b[a < b]
        first = ~(patterns[a, :table] == patterns[b, :table]).any(axis=1)
        found.append((a[first], b[first]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected with each index by the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def near_duplicates(rows: DataFrame, threshold: float = 0.95, miss: float = 1e-4,
                    id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per row: the id, ``n_links``, ``component_id`` (smallest id reachable) and ``kept``."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    vectors = scratch.keep(classes_of(rows.select(F.col(id_column).alias("id"),
                                                  F.col(vector_column).alias("vec"))))
    classes = scratch.keep(vectors.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("first_id"), F.count("*").alias("members"), F.first("vec").alias("vec")))
    signs, tables = layout(classes.count(), threshold, miss)
    patterns = scratch.keep(signed(classes, signs, tables))

    bucketed = patterns.select(
        "key", "members", "vec", "patterns", F.size("vec").alias("length"),
        F.posexplode("patterns").alias("table", "pattern"))
    place = ["table", "pattern", "length"]
    groups = (bucketed.groupBy(place).count()
              .select(*place, F.ceil(F.col("count") / BLOCK).cast("int").alias("groups")))
    spread = (bucketed.join(groups, place)
              .withColumn("group", F.pmod(F.xxhash64("key", "table"), "groups").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
              .withColumn("low", F.least("group", "other"))
              .withColumn("high", F.greatest("group", "other"))
              .withColumn("side", (F.col("group") > F.col("other")).cast("int")))

    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("links", T.LongType()),
                           T.StructField("root", T.BinaryType())])

    def block(t: pa.Table) -> pa.Table:
        keys = t.column("key").to_pylist()
        n = len(keys)
        order = np.array(sorted(range(n), key=keys.__getitem__))
        x = t.column("vec").combine_chunks().values.to_numpy(zero_copy_only=False).astype(
            np.float64).reshape(n, -1)[order]
        p = t.column("patterns").combine_chunks().values.to_numpy().reshape(n, -1)[order]
        members = t.column("members").to_numpy()[order]
        table = t.column("table")[0].as_py()
        across = t.column("low")[0] != t.column("high")[0]
        side = t.column("side").to_numpy()[order] if across else np.zeros(n, int)
        if across and (side.all() or not side.any()):
            a = b = np.zeros(0, int)
        else:
            a, b = linked_pairs(x, p, side, table, threshold)
        links = np.bincount(a, members[b], n) + np.bincount(b, members[a], n)
        label = forest(n, a, b)
        hit = np.flatnonzero(links)
        keys = [keys[i] for i in order]
        return pa.table({"key": pa.array([keys[i] for i in hit], pa.binary()),
                         "links": pa.array(links[hit].astype(np.int64)),
                         "root": pa.array([keys[label[i]] for i in hit], pa.binary())})

    found = scratch.keep(
        spread.select("key", "members", "vec", "patterns", "side", "low", "high", *place)
        .groupBy(*place, "low", "high").applyInArrow(block, schema))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")),
                                 scratch)
    placed = scratch.keep(classes.select("key", "first_id", "members")
                          .join(links, "key", "left")
                          .join(roots.withColumnRenamed("node", "key"), "key", "left")
                          .withColumn("root", F.coalesce("root", "key")))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component"))
    per_class = scratch.keep(placed.join(smallest, "root").select(
        "key", "component", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    return (vectors.select("id", "key").join(per_class, "key", "left")
            .select(F.col("id").alias(id_column),
                    F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id"))))
