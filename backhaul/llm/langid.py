"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the cosine of their presence vectors over hashed character n-grams of
one to four characters. Nyström landmarks span its feature space; one kernel ridge regression
per language, one against the rest, is fitted there. A score is K(x, landmarks) A. As K is itself
a product with the landmarks' presence vectors, those are multiplied with A once, and texts are
scored by products of their presence matrix with the result, batch by batch.

Texts without a letter, and null ones, get ``und`` with score 0, as does everything without any
training row. Ties go to the alphabetically first language. Rows that repeat are predicted each.
Texts of any length are read whole. An empty table gives no rows.
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
from backhaul.llm.batches import crc_fold, id_and_text, map_text
from backhaul.llm.samples import fit_once, hash_share

BITS = 16
LENGTHS = (1, 2, 3, 4)
#: Presence rows multiplied at once.
ROWS = 64
UNKNOWN = "und"
#: Rows that may be broadcast.
FEW = 10_000


@dataclass(frozen=True)
class Settings:
    landmarks: int = 192
    #: At most about so many texts are fitted, evenly over the languages.
    max_rows: int = 2000
    ridge: float = 1e-3


def _letters() -> np.ndarray:
    """For each code point, whether Unicode has it as a letter; numerals of any script are none."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def presence(texts: list[str | None], out: np.ndarray) -> np.ndarray:
    """Fills ``out`` (rows x 2^BITS) with the n-grams of each text; returns their numbers.

    Everything but letters counts as a space, runs of spaces as one.
    """
    letters = _LETTERS if len(_LETTERS) else _fill_letters()
    out[:] = 0
    for row, text in enumerate(texts):
        if not text:
            continue
        codes = w.code_points(text.lower()).astype(np.uint64)
        is_letter = letters[codes]
        if not is_letter.any():
            continue
        codes = np.where(is_letter, codes, np.uint64(32))
        codes = codes[np.concatenate(([True], is_letter[1:] | is_letter[:-1]))]
        h = np.zeros(len(codes), np.uint64)
        for k, length in enumerate(LENGTHS):
            h = h[:len(codes) - k] * np.uint64(w.BASE) + codes[k:] + np.uint64(length)
            if not len(h):
                break
            out[row, (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                >> np.uint64(64 - BITS)] = 1
    return out.sum(axis=1)


_LETTERS = np.zeros(0, bool)


def _fill_letters() -> np.ndarray:
    global _LETTERS
    _LETTERS = _letters()
    return _LETTERS


def batches(texts: list[str | None]):
    """Normalised presence matrices of ROWS texts at a time; rows without n-grams are zero."""
    matrix = np.zeros((min(ROWS, max(len(texts), 1)), 1 << BITS), np.float32)
    for at in range(0, len(texts), ROWS):
        chunk = texts[at:at + ROWS]
        part = matrix[:len(chunk)]
        n = presence(chunk, part)
        yield at, part, n


def fit(texts: list[str], languages: list[str], s: Settings) -> bytes:
    """Weights by n-gram and language."""
    names = sorted(set(languages))
    weights = np.zeros((1 << BITS, len(names)), np.float32)
    if names:
        order = sorted(range(len(texts)), key=lambda i: (w.mix(w.slice_hashes(
            w.code_points(texts[i]), np.array([0]), np.array([len(texts[i])])))[0], languages[i]))
        texts, languages = [texts[i] for i in order], [languages[i] for i in order]
        land = np.zeros((min(s.landmarks, len(texts)), 1 << BITS), np.float32)
        n = presence(texts[:len(land)], land)
        land /= np.sqrt(np.maximum(n, 1))[:, None]
        values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        phi = np.concatenate([(part @ land.T / np.sqrt(np.maximum(n, 1))[:, None]) @ root
                              for _, part, n in batches(texts)])
        target = np.where(np.array(languages)[:, None] == np.array(names), 1.0, -1.0)
        phi1 = np.hstack([phi, np.ones((len(phi), 1))])
        gram = phi1.T @ phi1 + s.ridge * len(phi) * np.diag([1.0] * phi.shape[1] + [0.0])
        beta = np.linalg.solve(gram + 1e-9 * np.eye(len(gram)), phi1.T @ target)
        weights = (land.T @ (root @ beta[:-1])).astype(np.float32)
        bias = beta[-1]
    else:
        bias = np.zeros(0)
    out = io.BytesIO()
    np.savez(out, weights=weights, bias=bias, names=np.array(names, dtype=str))
    return out.getvalue()


def train(documents: DataFrame, held_out: tuple[int, int] | None = (3, 1),
          settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text",
          language_column: str = "lang") -> bytes:
    """The model, from a hash sample with about as many texts of every language."""
    known = documents.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"),
        F.col(language_column).cast("string").alias("lang")).filter(
        r"id IS NOT NULL AND lang IS NOT NULL AND text RLIKE '\\p{L}'")
    if held_out:
        known = known.filter(crc_fold("id", held_out[0]) != held_out[1])
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    each = settings.max_rows / max(languages, 1)
    # a text is only shuffled for a table of languages that is too large to send around
    sample = (known.join(F.broadcast(counts) if languages <= FEW else counts, "lang")
              .filter(hash_share(F.col("id")) < each / F.col("n")).select("lang", "text"))
    return fit_once(sample, lambda t: fit(*(
        ([], []) if t is None else (t.column("text").to_pylist(), t.column("lang").to_pylist())),
        settings))


def load(model: bytes):
    with np.load(io.BytesIO(model)) as m:
        return m["weights"], m["bias"], m["names"].tolist()


def predict_texts(texts: list[str | None], weights: np.ndarray, bias: np.ndarray,
                  names: list[str]) -> tuple[list[str], np.ndarray]:
    languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if names:
        for at, part, n in batches(texts):
            values = (part @ weights) / np.sqrt(np.maximum(n, 1))[:, None] + bias
            best = values.argmax(axis=1)
            for i in np.flatnonzero(n):
                languages[at + i] = names[best[i]]
                scores[at + i] = min(1.0, max(0.0, (values[i, best[i]] + 1) / 2))
    return languages, scores


def predict(documents: DataFrame, model: bytes, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """Per row: the id, ``lang_pred`` and ``score``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", documents.schema[id_column].dataType),
                           T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def start():
        loaded = load(shared.value)

        def work(piece):
            return [piece.column("id"), *predict_texts(piece.column("text").to_pylist(), *loaded)]
        return work

    return (map_text(id_and_text(documents, id_column, text_column), "text", schema, start)
            .withColumnRenamed("id", id_column))
