"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

P(grade <= k | text) = sigmoid(threshold_k - w.x). All grades share the weights w over hashed
features of the text; the thresholds rise strictly, as each is the one before plus an
exponential. From them come the expected grade and the tail probability that a text has at least
a wanted grade, by which texts are selected.

Features: words present; symbols by how densely they occur; and steps of length, word variety,
line variety, capitals and digits. Grades are the distinct rating values in order, whatever
their number. Null texts count as empty. Without two grades to tell apart, every text gets the
only grade, or null. Rows that repeat are scored each, of several ratings for one id the largest
holds; equal scores need no order. Texts of any length are read whole. An empty table gives no rows.
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
from backhaul.llm.batches import id_and_text, map_text
from backhaul.llm.samples import fit_once, labelled_sample

BITS = 18


@dataclass(frozen=True)
class Settings:
    #: At most about so many rated rows are fitted.
    max_rows: int = 16_000
    epochs: int = 6
    batch: int = 64
    rate: float = 0.2
    l2: float = 1e-5
    min_rows: int = 2


def _steps(values: np.ndarray, salt: int) -> np.ndarray:
    """One bucket hash per value, for values in rising steps."""
    return w.mix(values.astype(np.int64).astype(np.uint64), salt)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, and offsets."""
    n = len(texts)
    hashes, offsets = w.word_hashes(texts)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    words = np.unique(owner.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    found = [(words << np.uint64(24), (words >> np.uint64(40)).astype(np.int64))]

    lengths = np.array([len(t or "") for t in texts])
    codes = w.code_points("".join(t or "" for t in texts))
    of = np.repeat(np.arange(n), lengths)
    symbol = ~(w.alphanumeric()[codes] | (codes == 32) | (codes == 10))
    keys, counts = np.unique(of[symbol] << 21 | codes[symbol], return_counts=True)
    density = np.log2(1 + counts * 1000 / lengths[keys >> 21]).astype(np.int64)
    found.append((_steps((keys & 0x1FFFFF) << 5 | density, 1), keys >> 21))

    def per_text(values, salt):
        found.append((_steps(np.asarray(values), salt), np.arange(n)))

    size = np.maximum(lengths, 1)
    per_text(np.log2(size), 2)
    distinct = np.bincount(found[0][1], minlength=n)
    per_text(distinct * 20 // np.maximum(np.diff(offsets), 1), 3)
    lines = [(t or "").split("\n") for t in texts]
    per_text([len(set(x)) * 20 // len(x) for x in lines], 4)
    for salt, kind in ((5, (codes >= 65) & (codes <= 90)), (6, (codes >= 48) & (codes <= 57)),
                       (7, symbol)):
        per_text(np.bincount(of[kind], minlength=n) * 40 // size, salt)

    shift = np.uint64(64 - BITS)
    buckets = np.concatenate([(h >> shift).astype(np.int64) for h, _ in found])
    keys = np.unique(np.concatenate([o for _, o in found]) << BITS | buckets)
    return ((keys & ((1 << BITS) - 1)).astype(np.int32),
            np.searchsorted(keys, np.arange(n + 1) << BITS))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def thresholds(free: np.ndarray) -> np.ndarray:
    """Rising thresholds from free parameters."""
    return np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])


def gradients(eta: np.ndarray, grade: np.ndarray, free: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log likelihood by eta = w.x, and summed by the free parameters."""
    cut = np.concatenate([[-np.inf], thresholds(free), [np.inf]])
    high, low = cut[grade + 1] - eta, cut[grade] - eta
    p_high, p_low = (np.where(np.isinf(v), (v > 0) * 1.0, sigmoid(np.where(np.isinf(v), 0, v)))
                     for v in (high, low))
    mass = np.maximum(p_high - p_low, 1e-12)
    d_high, d_low = p_high * (1 - p_high) / mass, p_low * (1 - p_low) / mass
    by_cut = np.zeros(len(cut))
    np.add.at(by_cut, grade + 1, -d_high)
    np.add.at(by_cut, grade, d_low)
    inner = by_cut[1:-1]
    by_free = np.cumsum(inner[::-1])[::-1].copy()
    by_free[1:] *= np.exp(free[1:])
    return d_high - d_low, by_free


def fit(flat: np.ndarray, ends: np.ndarray, grade: np.ndarray, n_grades: int, s: Settings
        ) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by AdaGrad over mini-batches, rows in the given order."""
    held = np.bincount(flat, minlength=1 << BITS)
    weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    share = np.cumsum(np.bincount(grade, minlength=n_grades))[:-1] / max(len(grade), 1)
    start = np.log((share + 1e-3) / (1 - share + 1e-3))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    free_seen = np.full(len(free), 1e-8)
    scale = 1 / np.sqrt(np.maximum(np.diff(ends), 1))
    for _ in range(s.epochs):
        for at in range(0, len(grade), s.batch):
            rows = np.arange(at, min(at + s.batch, len(grade)))
            index = flat[ends[rows[0]]:ends[rows[-1] + 1]]
            owner = np.repeat(rows - at, np.diff(ends)[rows])
            use = held[index] >= s.min_rows
            index, owner = index[use], owner[use]
            eta = np.bincount(owner, weights[index], len(rows)) * scale[rows]
            by_eta, by_free = gradients(eta, grade[rows], free)
            touched, back = np.unique(index, return_inverse=True)
            g = np.bincount(back, (by_eta * scale[rows])[owner], len(touched)) \
                + s.l2 * len(rows) * weights[touched]
            seen[touched] += g * g
            weights[touched] -= s.rate * 5 * g / np.sqrt(seen[touched])
            free_seen += by_free ** 2
            free -= s.rate * by_free / np.sqrt(free_seen)
    return weights, thresholds(free)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality",
          held_out: tuple[int, int] | None = (5, 0), settings: Settings = Settings(),
          id_column: str = "doc_id", text_column: str = "text") -> bytes:
    sample = labelled_sample(documents, labels, label, settings.max_rows, held_out, id_column,
                             text_column)
    schema = T.StructType([T.StructField("order", T.LongType()),
                           T.StructField("label", T.IntegerType()),
                           T.StructField("buckets", T.ArrayType(T.IntegerType()))])

    def start():
        def work(piece):
            flat, ends = features(piece.column("text").to_pylist())
            return [piece.column("order"), piece.column("label"),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))]
        return work

    def learn(table: pa.Table | None) -> bytes:
        grades, weights, cuts = np.zeros(0, int), np.zeros(0), np.zeros(0)
        if table is not None:
            y = table.column("label").to_numpy()
            grades = np.unique(y)
        if len(grades) > 1:
            lists = table.column("buckets").combine_chunks()
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            order = np.lexsort((y, np.diff(ends), table.column("order").to_numpy()))
            sizes = np.diff(ends)[order]
            flat = np.concatenate([flat[ends[i]:ends[i + 1]] for i in order])
            weights, cuts = fit(flat, np.concatenate([[0], np.cumsum(sizes)]),
                                np.searchsorted(grades, y[order]), len(grades), settings)
        out = io.BytesIO()
        at = np.flatnonzero(weights)
        np.savez_compressed(out, at=at.astype(np.int32), weights=weights[at].astype(np.float32),
                            cuts=cuts, grades=grades)
        return out.getvalue()

    rows = map_text(sample.select(F.xxhash64(F.col("id").cast("string")).alias("order"), "text",
                                  "label"), "text", schema, start)
    return fit_once(rows, learn)


def load(model: bytes):
    with np.load(io.BytesIO(model)) as m:
        weights = np.zeros(1 << BITS, np.float32)
        weights[m["at"]] = m["weights"]
        return weights, m["cuts"], m["grades"]


def probabilities(texts: list[str | None], weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade <= k) for each text and all k but the last."""
    flat, ends = features(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    eta = np.bincount(owner, weights[flat], len(texts)) / np.sqrt(np.maximum(np.diff(ends), 1))
    return sigmoid(cuts[None, :] - eta[:, None])


def score(documents: DataFrame, model: bytes, at_least: int | None = None, select_at: float = 0.5,
          id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, ``expected_grade``, ``tail_probability`` of the grade ``at_least``
    (the highest unless given) and whether it is ``selected``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", documents.schema[id_column].dataType),
                           T.StructField("expected_grade", T.DoubleType()),
                           T.StructField("tail_probability", T.DoubleType())])

    def start():
        weights, cuts, grades = load(shared.value)

        def work(piece):
            texts = piece.column("text").to_pylist()
            if len(grades) < 2:
                only = float(grades[0]) if len(grades) else None
                tail = None if only is None else float(at_least is None or only >= at_least)
                return [piece.column("id"), [only] * len(texts), [tail] * len(texts)]
            below = probabilities(texts, weights, cuts)
            expected = grades[-1] - below @ np.diff(grades)
            wanted = len(grades) - 1 if at_least is None else int(
                np.searchsorted(grades, at_least))
            tail = (np.ones(len(texts)) if wanted == 0 else np.zeros(len(texts))
                    if wanted == len(grades) else 1 - below[:, wanted - 1])
            return [piece.column("id"), pa.array(expected), pa.array(tail)]
        return work

    return (map_text(id_and_text(documents, id_column, text_column), "text", schema, start)
            .withColumn("selected", F.coalesce(F.col("tail_probability") >= select_at,
                                               F.lit(False)))
            .withColumnRenamed("id", id_column))
