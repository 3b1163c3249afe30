"""SentencePiece encoding by Viterbi over an Aho-Corasick automaton, and exact decoding.

The pieces of a model file form one automaton. A single pass over the text yields, at each
position, every piece that ends there (the automaton's output links), and each relaxes the best
score of that position. Ties go to the longer last piece. Characters that no piece covers cost
less than any piece can gain and become byte pieces.

No piece has the space mark after another character, so a best path always passes the start of
each run of space marks: texts are cut there, and short parts are remembered.

Encoding loses nothing: a space mark that stands in the text itself becomes byte pieces. A null
text gives null, an empty one no pieces. Rows that repeat are encoded each. A text of any length is
encoded whole, in memory that grows with it. An empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from backhaul.llm.batches import map_text

MARK = "▁"
PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Parts up to this length are remembered, so many at a time.
REMEMBER_CHARS, REMEMBER_PARTS = 48, 250_000
NEVER = float("-inf")
#: What an uncovered character costs beyond the worst piece, as the library has it.
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


class Pieces:
    """The vocabulary of a model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.automaton = ahocorasick.Automaton()
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        self.single: set[str] = set()
        worst, self.unknown_id = 0.0, 0
        for i, p in enumerate(proto.pieces):
            surface = b""
            if p.type == BYTE:
                value = int(p.piece[1:-1], 16)
                self.byte_id[value], surface = i, bytes([value])
            elif p.type in (NORMAL, USER):
                if MARK in p.piece.lstrip(MARK):
                    raise ValueError(f"piece {p.piece!r} spans a space; parts cannot be cut")
                surface = p.piece.replace(MARK, " ").encode()
                self.automaton.add_word(p.piece, (len(p.piece), p.score, i))
                worst = min(worst, p.score)
                if len(p.piece) == 1:
                    self.single.add(p.piece)
            elif p.type == UNKNOWN:
                self.unknown_id = i
            self.bytes_of.append(surface)
        if not all(self.byte_id):
            raise ValueError("the model has no byte pieces; encoding would lose characters")
        self.automaton.make_automaton()
        self.unknown_score = worst - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, ...]] = {}

    def best_path(self, part: str) -> tuple[int, ...]:
        """Ids of the best-scored pieces whose concatenation is ``part``."""
        n = len(part)
        best = [0.0] + [NEVER] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        single, unknown = self.single, self.unknown_score
        at = n if single.issuperset(part) else 0
        for end, (length, score, piece) in self.automaton.iter(part):
            while at <= end:
                if part[at] not in single and best[at] + unknown > best[at + 1]:
                    best[at + 1], back[at + 1] = best[at] + unknown, (1, -1)
                at += 1
            total = best[end + 1 - length] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, (length, piece)
        while at < n:
            if part[at] not in single and best[at] + unknown > best[at + 1]:
                best[at + 1], back[at + 1] = best[at] + unknown, (1, -1)
            at += 1
        ids: list[int] = []
        while n:
            length, piece = back[n]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.byte_id[b] for b in reversed(part[n - 1].encode("utf-8"))]
            n -= length
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        known = self.known
        for k, stretch in enumerate(text.split(MARK)):
            if k:
                ids += [self.byte_id[b] for b in MARK.encode()]
            for part in PARTS.findall((stretch if k else f" {stretch}").replace(" ", MARK)):
                found = known.get(part)
                if found is None:
                    found = self.best_path(part)
                    if len(part) <= REMEMBER_CHARS:
                        if len(known) >= REMEMBER_PARTS:
                            known.clear()
                        known[part] = found
                ids += found
        return ids

    def decode(self, ids) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")[1:]


@lru_cache(2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def read_model(path: str) -> bytes:
    """A model file of the driver; its few hundred kilobytes travel with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _lists(ids: list[list[int] | None]) -> pa.ListArray:
    """Lists of ids as one Arrow array, without a Python object per id in it."""
    flat = np.concatenate([np.asarray(x or [], np.int32) for x in ids])
    ends = np.cumsum([0, *(len(x or []) for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(ends), pa.array(flat),
        mask=pa.array([x is None for x in ids]) if None in ids else None)


def encode(rows: DataFrame, model: bytes, text_column: str = "text", into: str = "token_ids",
           decoded: str | None = None) -> DataFrame:
    """``rows`` with the ids as column ``into``, in place of one that has that name.

    With ``decoded`` the ids are decoded again, into a column of that name. One Python worker a
    core does both, on pieces of bounded size.
    """
    rows = rows.drop(into, *filter(None, [decoded]))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields,
                           T.StructField(into, T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add(decoded, T.StringType())

    def start():
        pieces = _pieces(shared.value)

        def work(piece):
            ids = [None if t is None else pieces.encode(t)
                   for t in piece.column(text_column).to_pylist()]
            columns = [*piece.columns, _lists(ids)]
            if decoded:
                columns.append(pa.array([None if x is None else pieces.decode(x) for x in ids],
                                        pa.string()))
            return columns
        return work

    return map_text(rows, text_column, schema, start)


def decode(rows: DataFrame, model: bytes, ids_column: str = "token_ids",
           into: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids_column`` as column ``into``, in place of one of that name."""
    rows = rows.drop(into)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])

    def start():
        pieces = _pieces(shared.value)

        def work(piece):
            texts = [None if not x.is_valid else
                     pieces.decode(x.values.to_numpy(zero_copy_only=False).tolist())
                     if len(x) else "" for x in piece.column(ids_column)]
            return [*piece.columns, pa.array(texts, pa.string())]
        return work

    return map_text(rows, ids_column, schema, start)
