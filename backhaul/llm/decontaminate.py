"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The n-grams of an item are all its pairs of words that are adjacent or have one word between them;
a document holds one where the two words stand in it just so. An alignment of score s with m
matches has 2m - s mismatches and gaps, at most half as many places where two of them come between
neighbouring matches, and so at least s/2 - 1 pairs, at different words of the item and of the
document, within 3n - s words for an item of n words.

**Rare seeds.** A first pass counts over all documents how often each pair of an item occurs. Of
the words of an item at which pairs begin, those with the most frequent pairs are set aside, TOGETHER
less than an alignment needs; every alignment then has pairs at TOGETHER of the others. Those are the
seeds. Only where a document holds so many seeds near each other are all the item's pairs around them
gathered, and only where enough of them lie near each other does a local alignment of the item's words with the passage
score exact, edited and paraphrased copies alike. So no alignment that reaches the score asked for is
lost, however the words are edited, and pairs of common words, which start nothing, cost no more than
being counted. The score is that of the best alignment as a share of the score of the whole item.

Test items are broadcast in slices of at most ``SLICE_WORDS`` words, one slice at a time; a larger
test set takes more passes. Null texts have no words. Items with fewer than ``SHORTEST`` words match
nothing. Items and documents that repeat are reported each; of alignments of one item that overlap in
a document, the best, of equal ones the first. Empty tables give no rows. A text of any length is
searched whole, in memory of a few dozen bytes a word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backhaul.llm import words as w
from backhaul.llm.batches import filter_text, id_and_text, map_text, pieces
from backhaul.llm.scratch import Scratch

#: Steps from the first word of a seed to its second.
STEPS = (1, 2)
SHORTEST = 3
#: Seeds that have to lie near each other, or as many as an alignment must have.
TOGETHER = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: So many equal words are reported however long the item is.
ENOUGH_WORDS = 50
SLICE_WORDS = 1_000_000
#: Cells of one row of a batch of alignments.
CELLS = 200_000
FILTER_BITS = 20
#: Pairs that are looked at at once, if those of an item are not more.
FOUND = 1 << 20


def pairs_at(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the pairs of words STEPS apart, whatever the step, the text of each, and where."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = w.mix(words, 5) * np.uint64(w.BASE)
    fits = [np.flatnonzero(owner[:-k] == owner[k:]) for k in STEPS]
    at = np.concatenate(fits)
    return (np.concatenate([w.mix(first[f] + words[f + k]) for f, k in zip(fits, STEPS, strict=True)]),
            owner[at], at)


@dataclass
class Items:
    """Words of test items, and their pairs: the distinct ones, and per item and word at which a
    pair begins (``at``, counted over all items) which one that is."""

    words: np.ndarray
    offsets: np.ndarray
    distinct: np.ndarray
    pair: np.ndarray
    item: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Items:
        words, offsets = w.word_hashes(texts)
        grams, item, at = pairs_at(words, offsets)
        long = np.diff(offsets)[item] >= SHORTEST
        distinct, pair = np.unique(grams[long], return_inverse=True)
        return cls(words, offsets, distinct, pair, item[long], at[long])


class Lookup:
    """Finds which of many hashes are among the pairs of the items."""

    def __init__(self, distinct: np.ndarray):
        self.distinct = distinct
        self.mask = np.uint64((1 << FILTER_BITS) - 1)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.distinct & self.mask] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the members, and their numbers among the distinct pairs."""
        maybe = np.flatnonzero(self.filter[h & self.mask])
        place = np.searchsorted(self.distinct, h[maybe])
        place = np.minimum(place, len(self.distinct) - 1)
        same = self.distinct[place] == h[maybe]
        return maybe[same], place[same]


def rare_seeds(items: Items, counts: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pair and item of every seed, sorted by pair.

    Of the words of an item at which pairs begin, the ``left`` ones with the most frequent pairs
    are no seeds.
    """
    # the most frequent pair of each word; a word belongs to one item
    word, first = np.unique(items.at, return_index=True)
    of_word = np.searchsorted(word, items.at)
    most = np.zeros(len(word), np.int64)
    np.maximum.at(most, of_word, counts[items.pair])
    item = items.item[first]
    order = np.lexsort((word, -most, item))
    rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
    seed = np.zeros(len(word), bool)
    seed[order] = rank >= left[item[order]]
    chosen = seed[of_word]
    both = np.unique(np.stack([items.pair[chosen], items.item[chosen]]), axis=1)
    return both[0], both[1]


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair, and where it ends in b (exclusive).

    Rows of all pairs advance together. Within a row, gaps along b are a running maximum.
    """
    n, wide = len(a), max(map(len, b))
    left = np.zeros((n, max(map(len, a))), np.uint64)
    right = np.zeros((n, wide), np.uint64)
    here = np.zeros((n, wide), bool)
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        left[k, :len(x)], right[k, :len(y)], here[k, :len(y)] = x, y, True
    lengths = np.array([len(x) for x in a])
    slope = (-GAP * np.arange(wide)).astype(np.int32)
    score = np.zeros((n, wide + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(left.shape[1]):
        same = (right == left[:, i:i + 1]) & here & (i < lengths)[:, None]
        row = np.maximum(score[:, :-1] + np.where(same, MATCH, MISMATCH), score[:, 1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        score[:, 1:] = row
        at = row.argmax(axis=1)
        top = row[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better] + 1
    return best, end


def passages(item: np.ndarray, doc: np.ndarray, at: np.ndarray, size: np.ndarray,
             need: np.ndarray, reach: np.ndarray, words: np.ndarray) -> list[tuple]:
    """Where in the documents to align: (document, item, first, last+1, seeds found).

    ``item``, ``doc`` and ``at`` (in the document) are of the seeds found. By item, ``size`` is its
    number of words, ``need`` that of seeds in an alignment and ``reach`` that of words in one; by
    document, ``words`` is its number of words.
    """
    order = np.lexsort((at, doc, item))
    item, doc, at = item[order], doc[order], at[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    item, doc, at = item[new], doc[new], at[new]
    start = np.arange(len(item))
    upto = start + need[item] - 1
    last = np.minimum(upto, len(item) - 1)
    near = np.flatnonzero((upto == last) & (item[last] == item) & (doc[last] == doc)
                          & (at[last] - at < reach[item]))
    edge = np.zeros(len(item) + 1, np.int64)
    np.add.at(edge, near, 1)
    np.add.at(edge, upto[near] + 1, -1)
    inside = np.flatnonzero(np.cumsum(edge[:-1]))
    if not len(inside):
        return []
    item, doc, at = item[inside], doc[inside], at[inside]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > size[item[1:]])
    first = np.flatnonzero(new)
    seeds = np.diff(np.append(first, len(item)))
    last = first + seeds - 1
    item, doc = item[first], doc[first]
    # an alignment with a seed there cannot leave these bounds
    low = np.maximum(at[first] - reach[item] + 1, 0)
    high = np.minimum(at[last] + reach[item], words[doc])
    return list(zip(doc.tolist(), item.tolist(), low.tolist(), high.tolist(), seeds.tolist(),
                    strict=True))


def apart(rows: list[tuple]) -> list[tuple]:
    """Of rows (text, item, start, end, score, seeds) that overlap in a text, the best."""
    kept: dict[tuple, list] = {}
    for row in sorted(rows, key=lambda r: (-r[4], r)):
        others = kept.setdefault(row[:2], [])
        if all(row[2] >= o[3] or row[3] <= o[2] for o in others):
            others.append(row)
    return [r for others in kept.values() for r in others]


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5,
                 min_words: int = 8, id_column: str = "doc_id", text_column: str = "text",
                 item_column: str = "item_id", item_text_column: str = "text",
                 enough_words: int = ENOUGH_WORDS) -> DataFrame:
    """One row per document, test item and passage aligned: ids, ``score``, ``n_seeds`` (words of
    the document at which a pair of the item begins) and the words ``start`` to ``end`` (exclusive)
    of the document.

    Reported are alignments of ``threshold`` of the item's score or more, or worth at least
    ``enough_words`` equal words; of the former those worth at least ``min_words`` equal words, or
    all of a shorter item.
    """
    docs = id_and_text(documents, id_column, text_column)
    schema = T.StructType([
        T.StructField("id", docs.schema["id"].dataType),
        T.StructField("item", benchmark.schema[item_column].dataType),
        T.StructField("score", T.DoubleType()), T.StructField("n_seeds", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def step(done: DataFrame, tests: list, shared) -> DataFrame:
        ids = [t.id for t in tests]

        def search():
            find = Search(*shared.value, threshold, min_words, enough_words)

            def work(piece):
                rows = sorted(find(piece.column("text").to_pylist()))
                return [piece.column("id").take(pa.array([r[0] for r in rows], pa.int64())),
                        [ids[r[1]] for r in rows], [r[4] for r in rows], [r[5] for r in rows],
                        [r[2] for r in rows], [r[3] for r in rows]]
            return work

        return done.union(map_text(docs, "text", schema, search))

    found = _by_slices(documents.sparkSession.createDataFrame([], schema), docs, benchmark,
                       item_column, item_text_column, step)
    return found.withColumnsRenamed({"id": id_column, "item": item_column})


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5,
                        min_words: int = 8, text_column: str = "text",
                        item_column: str = "item_id", item_text_column: str = "text",
                        enough_words: int = ENOUGH_WORDS) -> DataFrame:
    """The documents, with all their columns, in which ``contaminated`` finds nothing."""
    def step(kept: DataFrame, tests: list, shared) -> DataFrame:
        def search():
            find = Search(*shared.value, threshold, min_words, enough_words)

            def clean(texts):
                found = {r[0] for r in find(texts)}
                return [i not in found for i in range(len(texts))]
            return clean

        return filter_text(kept, text_column, search)

    return _by_slices(documents, documents.select(F.col(text_column).alias("text")), benchmark,
                      item_column, item_text_column, step)


def _by_slices(result: DataFrame, docs: DataFrame, benchmark: DataFrame, item_column: str,
               item_text_column: str, step) -> DataFrame:
    """``step`` applied for every slice of the test items, with their counted pairs.

    Beyond one slice each result is written before the next slice is sent out, so there is one
    broadcast at a time.
    """
    context = docs.sparkSession.sparkContext
    tests = (benchmark.select(F.col(item_column).alias("id"), F.col(item_text_column).alias("text"))
             .withColumn("words", F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))))
    n = max(1, -(-(tests.agg(F.sum("words")).first()[0] or 0) // SLICE_WORDS))
    scratch = Scratch(docs.sparkSession, "decontaminate")
    for k in range(n):
        part = (tests.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
                .orderBy("id", "text").collect())
        items = Items.of([t.text for t in part])
        if not len(items.distinct):
            continue
        shared = context.broadcast((items, pair_counts(docs, items)))
        result = step(result, part, shared)
        if n > 1:
            result = scratch.keep(result)
            shared.unpersist(blocking=False)
    return result


def pair_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """How often each distinct pair of the items occurs in all of ``docs``.

    Counted in each task first; the driver gets one number per pair of a slice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(items.distinct)
    schema = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches):
        lookup = Lookup(shared.value)
        total = np.zeros(len(lookup.distinct), np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, offsets = w.word_hashes(piece.column("text").to_pylist())
                _, pair = lookup.hits(pairs_at(words, offsets)[0])
                total += np.bincount(pair, minlength=len(total))
        held = np.flatnonzero(total)
        for at in range(0, len(held), 1 << 16):
            part = held[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])],
                                             names=schema.names)

    found = (docs.select("text").mapInArrow(count, schema).groupBy("pair")
             .agg(F.sum("n").alias("n")).toArrow())
    shared.unpersist(blocking=False)
    counts = np.zeros(len(items.distinct), np.int64)
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return counts


class Search:
    """Finds (text, item, start, end, score, pairs) in lists of texts."""

    def __init__(self, items: Items, counts: np.ndarray, threshold: float, min_words: int,
                 enough_words: int = ENOUGH_WORDS):
        self.items = items
        self.lookup = Lookup(items.distinct)
        self.sizes = np.diff(items.offsets)
        full = MATCH * self.sizes
        self.least = np.minimum(
            np.maximum(np.ceil(threshold * full - 1e-9).astype(np.int64),
                       np.minimum(MATCH * min_words, full)),
            MATCH * enough_words)
        # what an alignment of that score has at least, and how far it can reach
        self.need = np.maximum((self.least + 1) // 2 - 1, 1)
        self.reach = 3 * self.sizes - self.least
        # an alignment has pairs at ``need`` words, so seeds at ``together`` of them
        self.together = np.minimum(self.need, TOGETHER)
        pair, self.seed_item = rare_seeds(items, counts, self.need - self.together)
        self.seed_bounds = np.searchsorted(pair, np.arange(len(items.distinct) + 1))
        self.owned = np.unique(items.item * len(items.distinct) + items.pair)

    def seeds_of(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All items that have each pair for a seed: index into ``pair``, and the item."""
        first = self.seed_bounds[pair]
        n = self.seed_bounds[pair + 1] - first
        of = np.repeat(np.arange(len(pair)), n)
        return of, self.seed_item[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]]

    def around(self, item: np.ndarray, place: np.ndarray, ends: np.ndarray) -> tuple:
        """Stretches of places (words of all texts in a row) that an alignment with enough of the
        seeds found can cover: item, first, last + 1; those of an item that touch are one."""
        # equal seeds of one word count once
        key = np.unique(item * ends[-1] + place)
        item, place = key // ends[-1], key % ends[-1]
        text = np.searchsorted(ends, place, "right")
        near = np.zeros(len(item) + 1, np.int64)
        start = np.arange(len(item))
        last = start + self.together[item] - 1
        upto = np.minimum(last, len(item) - 1)
        enough = np.flatnonzero((last == upto) & (item[upto] == item) & (text[upto] == text)
                                & (place[upto] - place < self.reach[item]))
        np.add.at(near, enough, 1)
        np.add.at(near, last[enough] + 1, -1)
        kept = np.flatnonzero(np.cumsum(near[:-1]))
        item, place, text = item[kept], place[kept], text[kept]
        low = np.maximum(place - self.reach[item], np.append(0, ends)[text])
        high = np.minimum(place + self.reach[item] + 1, ends[text])
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (low[1:] > high[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        # both ends rise with the place
        return item[at], low[at], high[np.append(at[1:], len(item))[:len(at)] - 1]

    def __call__(self, texts: list[str | None]) -> list[tuple]:
        words, offsets = w.word_hashes(texts)
        h, _, place = pairs_at(words, offsets)
        member, pair = self.lookup.hits(h)
        order = np.argsort(place[member], kind="stable")
        pair, place = pair[order], place[member][order]
        ends = offsets[1:]
        jobs = []
        # so many hits at a time that their seeds fit
        cost = np.cumsum(self.seed_bounds[pair + 1] - self.seed_bounds[pair])
        cut = np.flatnonzero(np.append(True, np.diff(cost // FOUND) > 0)) if len(cost) else []
        found = [(item, place[a:b][of]) for a, b in zip(cut, [*cut[1:], len(pair)])
                 for of, item in [self.seeds_of(pair[a:b])]]
        if not found or not sum(len(i) for i, _ in found):
            return []
        item, low, high = self.around(np.concatenate([i for i, _ in found]),
                                      np.concatenate([p for _, p in found]), ends)
        if not len(item):
            return []
        first, last = np.searchsorted(place, low), np.searchsorted(place, high)
        total = np.cumsum(last - first)
        cut = np.flatnonzero(np.append(True, (total[1:] // FOUND > total[:-1] // FOUND)
                                       & (item[1:] != item[:-1])))
        for a, b in zip(cut, [*cut[1:], len(item)]):
            n = last[a:b] - first[a:b]
            of = np.repeat(np.arange(a, b), n)
            hit = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
            key = item[of] * len(self.lookup.distinct) + pair[hit]
            spot = np.minimum(np.searchsorted(self.owned, key), len(self.owned) - 1)
            mine = self.owned[spot] == key
            where = place[hit[mine]]
            doc = np.searchsorted(ends, where, "right")
            jobs += passages(item[of[mine]], doc, where - offsets[doc], self.sizes, self.need,
                             self.reach, np.diff(offsets))
        jobs.sort(key=lambda j: j[3] - j[2])
        rows, at = [], 0
        while at < len(jobs):
            upto = at + 1
            while upto < len(jobs) and (upto + 1 - at) * (jobs[upto][3] - jobs[upto][2]) <= CELLS:
                upto += 1
            rows += self.report(jobs[at:upto], words, offsets)
            at = upto
        return apart(rows)

    def report(self, jobs, words, offsets) -> list[tuple]:
        own = self.items
        left = [own.words[own.offsets[j[1]]:own.offsets[j[1] + 1]] for j in jobs]
        right = [words[offsets[j[0]] + j[2]:offsets[j[0]] + j[3]] for j in jobs]
        best, end = align(left, right)
        which = [j[1] for j in jobs]
        full = MATCH * self.sizes[which]
        good = np.flatnonzero(best >= self.least[which])
        if not len(good):
            return []
        # read backward from its end, the same alignment ends where it begins
        _, back = align([left[k][::-1] for k in good], [right[k][:end[k]][::-1] for k in good])
        return [(jobs[k][0], jobs[k][1], int(jobs[k][2] + end[k] - n), int(jobs[k][2] + end[k]),
                 float(best[k] / full[k]), jobs[k][4]) for k, n in zip(good, back, strict=True)]
