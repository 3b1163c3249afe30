"""Exact removal of repeated passages, by interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same
text or another. Texts count as UTF-8 bytes, strings never cross texts, null texts are empty.

How the work is cut: every string of ``length`` bytes (a window) has a smallest hash among the
short strings in it, its anchor. Equal windows have equal anchors, so only windows of one anchor
need comparing. Adjacent windows with the anchor in one place form a segment; every window lies in
exactly one, and no two windows of a segment are equal. Equal segments are one class with a multiplicity, and an anchor met once is dropped, both
before anything but hashes is shuffled. Anchors with several classes are ordered: tasks build the
Burrows-Wheeler transform of the classes of whole anchors and derive common prefixes from it in
rising order (``repeated_windows``). An anchor with more than ``CLASSES`` classes, a passage in
that many contexts, would not fit in a task's memory: its windows are counted by digest instead.

Rows are told apart by a digest of id and text, so ids may be null or repeated; rows that repeat
count as texts of their own. An empty table gives no rows. A single text is cut into segments in one
task, in about 75 bytes of memory a byte: 8 MB take 600 MB, and a text of 40 MB needs a larger worker
than 3 GB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backhaul.llm import words as w
from backhaul.llm.batches import map_text
from backhaul.llm.scratch import Scratch

LENGTH = 200
#: Bytes of the strings that anchors are chosen from.
GRAM = 64
#: Classes of an anchor ordered in one task (6 MB at most), and bytes after which a task orders
#: what it has; 60 bytes of memory go with each.
CLASSES, COLLECTION = 20_000, 2 << 20


def segments(data: bytes, ends: np.ndarray, length: int, gram: int
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last+1 window start of each segment of the texts that end at ``ends``."""
    codes = np.frombuffer(data, np.uint8)
    none = np.zeros(0, np.int64)
    if len(codes) < length:
        return none.astype(np.uint64), none, none
    n, span = len(codes), length - gram + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * w.powers(w.BASE, n), out=sums[1:])
    h = w.mix((sums[gram:] - sums[:-gram]) * w.powers(w.INVERSE, n - gram + 1))
    del sums
    # minimum over each span of h: suffix minima of a block against prefix minima of the next
    m = len(h)
    blocks = np.concatenate([h, np.full(-m % span, np.iinfo(np.uint64).max)]).reshape(-1, span)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(suffix[:m - span + 1], prefix[span - 1:m])
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(len(least) + 1, np.int8)
    long = ends - starts >= length
    inside[starts[long]] += 1
    np.add.at(inside, ends[long] - length + 1, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    change = np.ones(len(least), bool)
    # an anchor is a place: of equal values the leftmost, until it leaves the window
    change[1:] = ((least[1:] != least[:-1]) | (h[:m - span] == least[:-1])
                  | (inside[1:] != inside[:-1]))
    change[starts[long]] = True
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(least))
    first, last = first[inside[first]], last[inside[first]]
    return least[first], first, last


def _bytes(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def occurrences(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Every segment: ``anchor``, ``digest`` of its bytes, the row it is in, its windows."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "digest")]
                          + [T.StructField("row", T.BinaryType()),
                             T.StructField("at", T.LongType()),
                             T.StructField("windows", T.IntegerType())])

    def start():
        def work(piece):
            texts = _bytes(piece.column("text"))
            keys = piece.column("row").to_numpy(zero_copy_only=False)
            data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
            anchor, first, last = segments(data, ends, length, gram)
            owner = np.searchsorted(ends, first, "right")
            begin = np.concatenate([[0], ends[:-1]])[owner] if len(ends) else first
            tail = length - 1
            digests = b"".join([hashlib.blake2b(data[a:b + tail], digest_size=8).digest()
                                for a, b in zip(first.tolist(), last.tolist(), strict=True)])
            return [pa.array(anchor.view(np.int64)), pa.array(np.frombuffer(digests, np.int64)),
                    pa.array(keys[owner].tolist(), pa.binary()), pa.array(first - begin),
                    pa.array((last - first).astype(np.int32))]
        return work

    return map_text(rows, "text", schema, start)


def suffix_order(symbols: np.ndarray, end_of: np.ndarray, longest: int) -> np.ndarray:
    """Positions of ``symbols`` in the order of the suffixes that start there.

    Zeros end segments and differ from each other by their place; ``end_of`` gives each
    position's zero. Prefix doubling, on what is still tied.
    """
    n, step = len(symbols), 7
    key, place = np.zeros(n, np.int64), np.arange(n, dtype=np.int32)
    for k in range(step):
        key <<= 9
        inside = np.flatnonzero(place + k <= end_of)
        key[inside] |= symbols[inside + k]
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(new)[np.cumsum(new, dtype=np.int32) - 1]
    while step < longest:
        group = np.append(new, True)
        tied = np.flatnonzero(~(group[:-1] & group[1:]))
        if not len(tied):
            break
        at = order[tied]
        follow = at + step
        second = np.where(follow <= end_of[at], rank[np.minimum(follow, n - 1)] + 1, 0)
        key = rank[at].astype(np.int64) << 31 | second
        sort = np.argsort(key, kind="stable")
        order[tied] = at[sort]
        key = key[sort]
        new[tied] = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        rank[order[tied]] = starts[np.cumsum(new)[tied] - 1]
        step *= 2
    return order


def repeated_windows(parts: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each part, the starts whose ``length`` bytes occur twice, parts counting ``weights``.

    Common prefixes come from the Burrows-Wheeler transform alone, in rising order. Breadth
    first, every interval of suffixes with a common prefix of some length is extended backward
    by each symbol before it; an extended interval whose right border has no value yet fixes it
    and goes on to the next length. At ``length`` the expansion stops: borders without a value
    separate suffixes with at least ``length`` symbols in common. An interval is read run by
    run, so copies cost no more than one text.
    """
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int16) + np.int16(1)
    symbols[ends] = 0
    n, m = len(symbols), len(parts)
    end_of = np.repeat(ends.astype(np.int32), sizes + 1)
    order = suffix_order(symbols, end_of, int(sizes.max()) + 1)
    before = np.where(order > 0, symbols[order - 1], 0)  # the transform

    # LF: where the suffix one symbol longer stands
    lf = np.empty(n, np.int32)
    lf[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    run_start = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
    run_of = np.repeat(np.arange(len(run_start), dtype=np.int32),
                       np.diff(np.append(run_start, n)))
    run_end = np.append(run_start[1:], n) - 1

    known = np.zeros(n + 1, bool)  # borders with a common prefix below the current length
    known[[0, n]] = True
    known[:m + 1] = True
    first = np.flatnonzero(np.append(True, np.diff(symbols[order]) != 0))
    first = first[first >= m]
    del end_of
    low = np.concatenate([np.arange(m), first])
    high = np.concatenate([np.arange(m), np.append(first[1:], n)[:len(first)] - 1])
    known[first] = True
    for _ in range(1, length):
        if not len(low):
            break
        runs = run_of[high] - run_of[low] + 1
        interval = np.repeat(np.arange(len(low)), runs)
        run = np.arange(len(interval)) - np.repeat(np.cumsum(runs) - runs, runs) \
            + run_of[low][interval]
        a = np.maximum(run_start[run], low[interval])
        b = np.minimum(run_end[run], high[interval])
        symbol = before[a]
        used = symbol > 0
        interval, a, b, symbol = interval[used], a[used], b[used], symbol[used]
        key = interval * 257 + symbol
        if (runs > 1).any():
            sort = np.argsort(key, kind="stable")
            key, a, b = key[sort], a[sort], b[sort]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        stop = np.append(start[1:], len(key)) - 1 if len(key) else key
        low, high = lf[a[start]], lf[b[stop]]
        new = ~known[high + 1]
        low, high = low[new], high[new]
        known[high + 1] = True

    group = np.cumsum(known[:n]) - 1
    part = np.searchsorted(ends, order)
    offset = order - (ends - sizes)[part]
    whole = offset + length <= sizes[part]
    count = np.bincount(group[whole], weights[part[whole]], group[-1] + 1)
    hit = whole & (count[group] >= 2)
    place = np.sort(part[hit] * (int(sizes.max()) + 1) + offset[hit])
    cut = np.searchsorted(place, np.arange(m + 1) * (int(sizes.max()) + 1))
    return [place[cut[i]:cut[i + 1]] - i * (int(sizes.max()) + 1) for i in range(m)]


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 of each run of adjacent numbers."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + 1


PIECE = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("digest", T.LongType()),
                      T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())])


def ordered(classes: DataFrame, length: int) -> DataFrame:
    """Repeated windows of classes (anchor, digest, members, bytes), anchors not split."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            out = [[], [], [], []]
            found = repeated_windows([r[3] for r in rows], np.array([r[2] for r in rows], float),
                                     length)
            for r, starts in zip(rows, found, strict=True):
                for a, b in zip(*(x.tolist() for x in runs(starts)), strict=True):
                    for column, value in zip(out, (r[0], r[1], a, b), strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=PIECE.names)

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in
                             ("anchor", "digest", "members", "bytes")), strict=True):
                if size > COLLECTION and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush(held)

    return (classes.select("anchor", "digest", "members", "bytes")
            .repartition("anchor").sortWithinPartitions("anchor", "digest")
            .mapInArrow(run, PIECE))


def counted(classes: DataFrame, length: int) -> DataFrame:
    """The same by digests of all windows, for anchors of any number of classes."""
    schema = T.StructType([*PIECE.fields[:3], T.StructField("window", T.BinaryType()),
                           T.StructField("members", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column("bytes")[row].as_py()
                n = len(data) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("anchor")[row].as_py()] * n, pa.int64()),
                     pa.array([batch.column("digest")[row].as_py()] * n, pa.int64()),
                     pa.array(range(n), pa.int32()),
                     pa.array([hashlib.blake2b(data[i:i + length], digest_size=16).digest()
                               for i in range(n)], pa.binary()),
                     pa.array([batch.column("members")[row].as_py()] * n, pa.int64())],
                    names=schema.names)

    windows = classes.select("anchor", "digest", "members", "bytes").mapInArrow(run, schema)
    # of a window met in several classes, only pairs of count and one place are shuffled at first
    total = windows.groupBy("window").agg(F.sum("members").alias("n")).filter("n > 1")
    return (windows.join(total, "window")
            .select("anchor", "digest", "low", (F.col("low") + 1).alias("high")))


def repeated_spans(rows: DataFrame, scratch: Scratch, length: int, gram: int) -> DataFrame:
    """Byte ranges to remove from each row, as lists by ``row``; rows are (row, text)."""
    found = occurrences(rows, length, gram)
    anchors = scratch.keep(
        found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("low"),
                                    F.max("digest").alias("high"))
        .filter("n > 1").select("anchor", (F.col("low") == F.col("high")).alias("alike")))
    repeated = scratch.keep(found.join(anchors, "anchor"))
    alike = repeated.filter("alike").select(
        "row", "at", (F.col("at") + F.col("windows") + length - 1).alias("end"))

    mixed = repeated.filter("NOT alike")
    classes = scratch.keep(
        mixed.groupBy("anchor", "digest").agg(
            F.count("*").alias("members"), F.min(F.struct("row", "at", "windows")).alias("one"))
        .select("anchor", "digest", "members", "one.*"))
    many = (classes.groupBy("anchor").count().filter(F.col("count") > CLASSES)
            .select("anchor", F.lit(True).alias("many")))
    cut = scratch.keep(
        classes.join(rows.withColumnRenamed("row", "key").select("key", "text"),
                     F.col("row") == F.col("key"))
        .select("anchor", "digest", "members",
                F.expr(f"substring(cast(text as binary), cast(at + 1 as int), "
                       f"windows + {length - 1})").alias("bytes"))
        .dropDuplicates(["anchor", "digest"])
        .join(many, "anchor", "left"))
    pieces = scratch.keep(ordered(cut.filter("many IS NULL"), length)
                          .union(counted(cut.filter("many"), length)))
    partly = mixed.join(pieces, ["anchor", "digest"]).select(
        "row", (F.col("at") + F.col("low")).alias("at"),
        (F.col("at") + F.col("high") + length - 1).alias("end"))
    # touching ranges are joined in Python, where a row's few ranges come together with its text
    return scratch.keep(alike.union(partly).distinct().groupBy("row").agg(
        F.collect_list(F.struct("at", "end")).alias("ranges")))


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def deduplicate(rows: DataFrame, length: int = LENGTH, gram: int = GRAM,
                id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, ``n_bytes``, the ``removed`` ranges (start, end) and the ``kept`` bytes."""
    scratch = Scratch(rows.sparkSession, "suffix")
    keyed = rows.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"),
        F.unhex(F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("-")),
                               F.lit("\0"), F.coalesce(F.col(text_column), F.lit("")))
                      )).alias("row"))
    spans = repeated_spans(keyed.select("row", "text"), scratch, length, gram)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([
        T.StructField("id", rows.schema[id_column].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])

    def start():
        def work(piece):
            texts = _bytes(piece.column("text"))
            removed = [merge([(r["at"], r["end"]) for r in x or []])
                       for x in piece.column("ranges").to_pylist()]
            kept = []
            for t, spans in zip(texts, removed, strict=True):
                edges = [0, *(e for s in spans for e in s), len(t)]
                kept.append(b"".join(t[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)))
            return [piece.column("id"), [len(t) for t in texts],
                    [[{"start": a, "end": b} for a, b in s] for s in removed], kept]
        return work

    return (map_text(keyed.join(spans, "row", "left").select("id", "text", "ranges"), "text",
                     schema, start).withColumnRenamed("id", id_column))
