"""Mixing sources to target weights: how often every document is taken.

Each source has a target, in words. Its documents are all taken the same whole number of times,
and each once more with the same probability, what is left of target by size. Which ones is decided
by the **cube method**: probabilities that are still between 0 and 1 are moved along a line on which
the sums of probabilities and of expected words do not change (the null space of the two
constraints), to one of the two points where a probability becomes 0 or 1, chosen so that none
changes on average. A document that is decided makes room for the next. Of the lines, the one is
taken that moves the largest of the documents at hand most, so that small ones take up the
difference and are what remains at the end; where no line keeps both sums and moves it, words are
kept. The last two are the landing: of the ways to decide them that keep both probabilities, the one
least off on average. A few documents that make up much of a source, each over 1 / WINDOW of its
words, are decided first by themselves, and the probability of all others follows from the words still
wanted. So the words taken of a source differ from its target by two of the other documents at most,
as a rule small ones.

**At scale.** A source is dealt by hash into parts of PART documents on average, each flown by itself,
streaming from the largest document, with WINDOW of them in memory. Those that remain go into the next round, part by part,
until a source has one part, which lands. Targets, ranks and totals are computed over the table of
sources, of any number, by aggregates and sorted ranges; a few sums reach the driver.

Choices are by hashes of id and text, so the same rows give the same result, however they are
partitioned. Rows equal in id, source and text are told apart by a running number.

Defined cases: a null or empty text has no words and takes none. Documents without a source are a
source of their own, the last one. A source without words has target 0. Null ids are ids like others.
Texts of any length are counted whole, further columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from itertools import chain, count, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from backhaul.llm.scratch import Scratch
from backhaul.plans.global_order import with_global_order

#: Documents of a part, on average.
PART = 4096
#: Weights of the sources in their order, repeated; share of all words; most times of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents whose probabilities are moved at a time.
WINDOW = 64
#: A probability this close to 0 or 1 is decided.
EPSILON = 1e-9

# What separates words.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: str | Column) -> Column:
    """The number of words; each becomes one character, so no list of them is built."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), SPACE, "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


# ---- the cube method, in plain Python --------------------------------------------------------

def _line(slack: np.ndarray, sizes: np.ndarray, which: int, documents: bool) -> np.ndarray:
    """The direction that keeps words, and the number of documents if asked, and moves ``which``
    most; a document with less ``slack`` moves less."""
    line = np.zeros_like(slack)
    line[which] = slack[which]
    if documents:
        total = slack.sum()
        apart = sizes - slack @ sizes / total
        spread = slack @ (apart * apart)
        line -= slack * (slack[which] / total)
        if spread > 1e-18:
            line -= slack * apart * (slack[which] * apart[which] / spread)
    else:
        words = slack @ (sizes * sizes)
        if words > 0:
            line -= slack * sizes * (slack[which] * sizes[which] / words)
    return line


def _move(p: np.ndarray, sizes: np.ndarray, chance: float, more: bool) -> np.ndarray | None:
    """``p`` moved until one is 0 or 1; none if nothing can move without changing the words, or,
    if there are ``more`` documents to come, their number."""
    slack = p * (1 - p)
    largest = int(np.argmax(sizes))
    scaled = sizes / max(float(sizes[largest]), 1.0)
    others = slack.copy()
    others[largest] = 0.0
    second = int(np.argmax(np.where(others > 0, sizes, -1.0)))
    for part, which, documents in ((slack, largest, True), (slack, largest, False),
                                   (others, second, True)):
        if more and not documents:
            continue
        line = _line(part, scaled, which, documents)
        # what rounding leaves must not pass for a direction
        if line[which] > 1e-6 * part[which]:
            break
    else:
        return None
    line[np.abs(line) < 1e-12 * np.abs(line).max()] = 0.0
    room = np.where(line > 0, 1 - p, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(line != 0, room / np.abs(line), np.inf)
        back = np.where(line != 0, (1 - room) / np.abs(line), np.inf)
    up, down = reach.min(), back.min()
    # the mean of the two points is the point itself
    forward = chance * (up + down) < down
    end = int(np.argmin(reach if forward else back))
    moved = np.clip(p + (up if forward else -down) * line, 0.0, 1.0)
    moved[end] = float((line[end] > 0) == forward)
    return moved


def _land(p: list[float], sizes: list[float], chance: float) -> list[bool]:
    """Decides two documents at most, each with its probability, with the least mean error."""
    if len(p) < 2:
        return [chance < q for q in p]
    (p1, p2), (a, b) = p, sizes

    def error(x: int, y: int) -> float:
        return ((x - p1) * a + (y - p2) * b) ** 2 + ((x - p1) + (y - p2)) ** 2

    least, most = max(0.0, p1 + p2 - 1), min(p1, p2)
    both = least if error(1, 1) + error(0, 0) > error(1, 0) + error(0, 1) else most
    if chance < both:
        return [True, True]
    if chance < p1:
        return [True, False]
    return [False, chance < p1 + p2 - both]


def fly(rows: Iterable[tuple], rng: random.Random, land: bool, window: int = WINDOW
        ) -> Iterator[tuple]:
    """Decides rows of (document, probability, size).

    Gives (document, probability): 0 or 1, or, unless they ``land``, in between for the last
    ``window`` at most.
    """
    rows = iter(rows)
    held: list = []
    p, sizes = np.zeros(0), np.zeros(0)
    more, room = True, window
    while True:
        if more and len(held) < room:
            new = list(islice(rows, room - len(held)))
            more = bool(new)
            held += [r[0] for r in new]
            p = np.append(p, [float(r[1]) for r in new])
            sizes = np.append(sizes, [float(r[2]) for r in new])
        if not more and not land or len(held) <= 2:
            break
        moved = _move(p, sizes, rng.random(), more)
        if moved is None and more:
            room += window
            continue
        if moved is None:
            break
        room = window
        open_ = (moved > EPSILON) & (moved < 1 - EPSILON)
        for i in np.flatnonzero(~open_):
            yield held[i], float(round(moved[i]))
        held = [held[i] for i in np.flatnonzero(open_)]
        p, sizes = moved[open_], sizes[open_]
    for at in range(0, len(held), 2):
        pair = slice(at, at + 2)
        now = [float(x) for x in p[pair]]
        yield from zip(held[pair], map(float, _land(now, list(sizes[pair]), rng.random()))
                       if land else now)


# ---- targets ---------------------------------------------------------------------------------

def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """``target`` of each source (columns source_key, in whose order weights repeat, and
    source_size), from a stored table.

    The sources share ``share`` times all words by weight. None gets more than ``most`` times its
    size; what is over goes to the others by weight, until none is above.
    """
    ranked = with_global_order(sources.withColumn("_one", F.lit(0)), "_one", "source_key",
                               row_number="_rank").drop("_one")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))),
                          ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight).withColumn(
        "_cap", most * F.col("source_size").cast("double")).drop("_rank")
    total = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        # a source without words is full from the start
        under = F.col("_cap") <= F.col("_weight") * level
        used, free, now = ranked.agg(
            F.sum(F.when(under, F.col("_cap")).otherwise(0.0)),
            F.sum(F.when(under, 0.0).otherwise(F.col("_weight"))), F.count_if(under)).first()
        if now == full or not free:
            break
        full, level = now, (total - used) / free
    return (ranked.withColumn("target", F.least("_cap", F.col("_weight") * level))
            .drop("_cap", "_weight"))


# ---- the distributed table -------------------------------------------------------------------

def _flown(rows: DataFrame, seed: int, window: int) -> DataFrame:
    """One flight of every part; probabilities in between are left for the next."""
    dealt = rows.select(
        "source_key", F.pmod(F.xxhash64(F.lit(seed), "digest", "copy"), F.col("parts"))
        .alias("part"), "parts", "size", F.xxhash64(F.lit(~seed), "digest", "copy").alias("turn"),
        "probability", "doc_id", "source", "source_size", "target", "whole", "digest", "copy")
    schema = T.StructType([f for f in dealt.schema if f.name not in ("part", "turn")])
    names = dealt.columns
    key, at = names.index("source_key"), names.index("part")
    out = [names.index(f.name) for f in schema]
    chosen = out.index(names.index("probability"))
    p, size, turn, parts = map(names.index, ("probability", "size", "turn", "parts"))
    arrow = to_arrow_schema(schema)

    def batch(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*[row for row, _ in done]))
        arrays = [columns[i] for i in out]
        arrays[chosen] = [q for _, q in done]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(arrays, arrow)],
                                          schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        done = []
        for _, group in groupby(rows, key=lambda row: (row[key], row[at])):
            first = next(group)
            last = first[parts] == 1
            everything = ((row, row[p], row[size]) for row in chain([first], group))
            for decided in fly(everything, random.Random(first[turn]), last, window):
                done.append(decided)
                if len(done) == 10_000:
                    yield batch(done)
                    done = []
        if done:
            yield batch(done)

    return (dealt.repartition("source_key", "part")
            .sortWithinPartitions("source_key", "part", F.desc("size"), "turn", "digest", "copy")
            .mapInArrow(run, schema))


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
        most: float = MOST, seed: int = 0, part: int = PART, window: int = WINDOW,
        id_column: str = "doc_id", source_column: str = "source",
        text_column: str = "text") -> DataFrame:
    """Per document: id, source, size, source_size, target, how many ``copies`` the mix takes and
    ``taken``, the words in them. Sources are ordered by code point, null last.

    ``part`` must be twice ``window`` at least, so that every round leaves fewer parts.
    """
    if part < 2 * window or window < 3:
        raise ValueError("parts of so few documents do not become fewer")
    scratch = Scratch(documents.sparkSession, "mixing")
    source = F.col(source_column).cast("string")
    units = scratch.keep(
        documents.select(
            F.col(id_column).alias("doc_id"), source.alias("source"),
            words_in(text_column).alias("size"),
            F.xxhash64(F.col(id_column).cast("string"), text_column).alias("digest"))
        .groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("source_key", F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1"))))
    sources = scratch.keep(
        units.groupBy("source_key")
        .agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"),
             F.sum("rows").alias("n")))
    def shared(words: Column, size: Column) -> list[Column]:
        """How often documents of ``size`` words in all are taken to give ``words``."""
        ratio = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), words / size)))
        ratio = F.coalesce(ratio, F.lit(0.0))
        return [F.floor(ratio).alias("whole"), (ratio - F.floor(ratio)).alias("probability")]

    sure = (F.col("probability") <= EPSILON) | (F.col("probability") >= 1 - EPSILON)
    named = ["source_key", "source_size", "target", "n"]
    known = scratch.keep(targets(sources, weights, share, most)
                         .select(*named, *shared(F.col("target"), F.col("source_size"))))
    # fewer than ``window`` documents of a source have over 1 / window of its words
    head = (F.col("size") * window > F.col("source_size")) & F.col("split")
    split = known.withColumn("split", ~sure)

    def dealt(sources: DataFrame, which: Column) -> DataFrame:
        return (units.join(sources, "source_key").filter(which)
                .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
                .drop("rows", "split", "n"))

    heads = scratch.keep(_flown(dealt(split, head).withColumn("parts", F.lit(1).cast("long")),
                                seed, window))
    done = heads.groupBy("source_key").agg(
        F.sum("size").alias("head_size"),
        F.sum((F.col("whole") + F.round("probability")) * F.col("size")).alias("head_taken"))
    left = split.join(done, "source_key", "left")
    rest = scratch.keep(
        left.filter("head_size IS NULL").drop("head_size", "head_taken")
        .unionByName(left.filter("head_size IS NOT NULL").select(
            *named, "split", *shared(F.col("target") - F.col("head_taken"),
                                     F.col("source_size") - F.col("head_size"))))
        .withColumn("parts", F.ceil(F.col("n") / part)))
    others = dealt(rest, ~head)
    decided = [heads, others.filter(sure)]
    waiting = others.filter(~sure)
    most_parts = rest.agg(F.max("parts")).first()[0] or 0
    for round_no in count(1):
        flown = scratch.keep(_flown(waiting, seed + round_no, window))
        decided.append(flown.filter(sure))
        if most_parts <= 1:
            break
        waiting = flown.filter(~sure).withColumn("parts", F.ceil(window * F.col("parts") / part))
        most_parts = -(-window * most_parts // part)
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", "probability"]
    rows = decided[0].select(*columns)
    for more in decided[1:]:
        rows = rows.unionByName(more.select(*columns))
    copies = (F.col("whole") + F.round("probability")).cast("long")
    return rows.select(
        F.col("doc_id").alias(id_column), F.col("source").alias(source_column), "size",
        "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"))
