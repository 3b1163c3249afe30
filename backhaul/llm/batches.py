"""Running a function over Arrow batches of chosen columns, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Texts are handed on in pieces of about so many characters; one longer text is one piece.
PIECE_CHARS = 1 << 20


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` whose ``text``, or list of as many items, has about PIECE_CHARS
    bytes each."""
    column = batch.column(text)
    sizes = pc.list_value_length(column) if pa.types.is_list(column.type) else (
        pc.binary_length(column))
    sizes = pc.fill_null(sizes, 0).to_numpy()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > PIECE_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def map_text(rows: DataFrame, text: str, schema: T.StructType,
             start: Callable[[], Callable[[pa.RecordBatch], Sequence]]) -> DataFrame:
    """``rows`` through Python in bounded pieces.

    ``start`` runs once per task and returns the function from a piece to its result columns,
    given as lists or Arrow arrays in the order of ``schema``.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for piece in pieces(batch, text):
                columns = work(piece)
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray))
                     else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)],
                    schema=arrow)

    return rows.mapInArrow(run, schema)


def filter_text(rows: DataFrame, text: str,
                start: Callable[[], Callable[[list[str | None]], Sequence[bool]]]) -> DataFrame:
    """The rows, with all their columns, whose ``text`` the function given by ``start`` keeps."""
    schema = rows.schema

    def begin():
        keep = start()

        def work(piece):
            mask = pa.array(keep(piece.column(text).to_pylist()), pa.bool_())
            return piece.filter(mask).columns
        return work

    return map_text(rows, text, schema, begin)


def id_and_text(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only the two columns an operator reads, so further columns cannot clash with its own."""
    return rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))


def crc_fold(id_column: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string") if isinstance(id_column, str)
                   else id_column.cast("string")) % folds
