"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of its words, adjacent pairs and triples, and pairs with one
or two words between, hashed into 2^BITS buckets. Training visits a bounded sample one row at a
time; each coordinate has its own learning rate, and the L1 term leaves most weights at zero, so
the model is small enough to broadcast whatever the corpus size. Buckets that fewer than
``min_rows`` training rows hold are left out. Only the text enters a score.

A null text scores as an empty one, by the bias alone. Without any training row the scores are 0.
Rows that repeat are scored each; of several labels for one id the largest holds. Ties of the order in
which rows are fitted are broken by their sizes and labels. Texts of any length are read whole. An
empty table gives no rows.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backhaul.llm import words as w
from backhaul.llm.batches import filter_text, id_and_text, map_text
from backhaul.llm.samples import fit_once, labelled_sample

BITS = 20
#: Steps between the words of a feature: pairs, triples, pairs with one and two words skipped.
PATTERNS = ((1,), (1, 2), (2,), (3,))


@dataclass(frozen=True)
class Settings:
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 4
    min_rows: int = 2
    #: At most about so many labelled rows are fitted.
    max_rows: int = 18_000


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every feature occurrence; occurrences of a text may repeat."""
    hashes, offsets = w.word_hashes(texts)
    parts = [(hashes, np.repeat(np.arange(len(texts)), np.diff(offsets)))]
    parts += [w.ngrams(hashes, offsets, p) for p in PATTERNS]
    shift = np.uint64(64 - BITS)
    return (np.concatenate([(h >> shift).astype(np.int32) for h, _ in parts]),
            np.concatenate([o for _, o in parts]))


def distinct(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, and offsets."""
    bucket, owner = features(texts)
    keys = np.unique(owner.astype(np.int64) << BITS | bucket)
    return ((keys & ((1 << BITS) - 1)).astype(np.int32),
            np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.int64) << BITS))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias after ``s.epochs`` passes over ``rows`` in the given order."""
    held = np.zeros(1 << BITS, np.int32)
    for index in rows:
        held[index] += 1  # the buckets of a row are distinct
    for i, index in enumerate(rows):
        rows[i] = index[held[index] >= s.min_rows]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= s.l1, 0.0,
                        -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def bias():
        return -bias_z / ((s.beta + np.sqrt(bias_n)) / s.alpha)

    for _ in range(s.epochs):
        for index, label in zip(rows, labels, strict=True):
            zi, ni = z[index], n[index]
            wi, b = weights(zi, ni), bias()
            g = 1 / (1 + np.exp(-np.clip(wi.sum() + b, -35, 35))) - label
            root = np.sqrt(ni + g * g)
            z[index] = zi + g - (root - np.sqrt(ni)) / s.alpha * wi
            n[index] = ni + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / s.alpha * b
            bias_n += g * g
    return weights(z, n), bias()


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic",
          held_out: tuple[int, int] | None = (5, 0), settings: Settings = Settings(),
          id_column: str = "doc_id", text_column: str = "text") -> bytes:
    """The model, as the non-zero weights by bucket and the bias."""
    sample = labelled_sample(documents, labels, label, settings.max_rows, held_out, id_column,
                             text_column)
    schema = T.StructType([T.StructField("id", T.StringType()),
                           T.StructField("label", T.IntegerType()),
                           T.StructField("buckets", T.ArrayType(T.IntegerType()))])

    def start():
        def work(piece):
            flat, ends = distinct(piece.column("text").to_pylist())
            return [piece.column("id"), piece.column("label"),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))]
        return work

    def fit(table: pa.Table | None) -> bytes:
        weights, bias = np.zeros(0), -40.0
        if table is not None:
            ids = table.column("id").to_pylist()
            y = table.column("label").to_numpy().astype(float)
            # views of the batches, which are not copied together
            rows = [chunk.values.to_numpy()[a:b] for chunk in table.column("buckets").chunks
                    for ends in [chunk.offsets.to_numpy()] for a, b in zip(ends[:-1], ends[1:])]
            order = sorted(range(len(ids)),
                           key=lambda i: (int(w.mix(np.uint64([hash_id(ids[i])]))[0]), len(rows[i]),
                                          y[i]))
            weights, bias = ftrl([rows[i] for i in order], (y > 0)[order].astype(float), settings)
        out = io.BytesIO()
        at = np.flatnonzero(weights)
        np.savez_compressed(out, at=at.astype(np.int32), weights=weights[at].astype(np.float32),
                            bias=bias)
        return out.getvalue()

    examples = map_text(sample.select(F.col("id").cast("string"), "text", "label"), "text", schema,
                        start)
    return fit_once(examples, fit)


def hash_id(value: str) -> int:
    """A stable number for an id, for the order of training."""
    return int.from_bytes(value.encode()[-8:], "little")


def load(model: bytes) -> tuple[np.ndarray, float]:
    with np.load(io.BytesIO(model)) as m:
        weights = np.zeros(1 << BITS, np.float32)
        weights[m["at"]] = m["weights"]
        return weights, float(m["bias"])


def scores(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    bucket, owner = features(texts)
    used = np.flatnonzero(weights[bucket])  # few: presence is sorted out for these only
    keys = np.unique(owner[used].astype(np.int64) << BITS | bucket[used])
    total = np.bincount(keys >> BITS, weights[keys & ((1 << BITS) - 1)], len(texts)) + bias
    return np.where(total <= -40, 0.0, 1 / (1 + np.exp(-np.clip(total, -35, 35))))


def score(documents: DataFrame, model: bytes, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """Per row: the id, ``score`` and ``predicted``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", documents.schema[id_column].dataType),
                           T.StructField("score", T.DoubleType())])

    def start():
        weights, bias = load(shared.value)
        return lambda piece: [piece.column("id"),
                              pa.array(scores(piece.column("text").to_pylist(), weights, bias))]

    return (map_text(id_and_text(documents, id_column, text_column), "text", schema, start)
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
            .withColumnRenamed("id", id_column))


def keep_clean(documents: DataFrame, model: bytes, threshold: float = 0.5,
               text_column: str = "text") -> DataFrame:
    """The documents that score below ``threshold``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def start():
        weights, bias = load(shared.value)
        return lambda texts: (scores(texts, weights, bias) < threshold).tolist()

    return filter_text(documents, text_column, start)
