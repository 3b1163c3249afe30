"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles.

A shingle is five adjacent words (a shorter text is one shingle); its weight in a text is its
count there times ln(1 + N / (1 + df)), with df the documents that hold it, counted over the whole
corpus in 2^DF_BITS hash buckets. Consistent weighted samples agree in two texts as often as
their weighted Jaccard similarity says. BANDS groups of ROWS samples each are the bands; texts
that share a band are candidates, and the similarity itself decides.

Texts with the same words are one class before anything is compared. Within a band, every class is
compared with one leader; classes still apart from it meet further leaders, and those that remain
apart after ROUNDS meet all of their band in blocks of bounded size, where matrix products give all
similarities and only a spanning forest is returned. So the components are those of all candidate
pairs, but a large group of copies mostly costs a few comparisons each.

Texts without a word, null texts and null ids link with nothing. Rows that repeat an id and a text
count as one document. Of a component the smallest id stays; leaders are chosen by a hash, ties of it
by key. Texts of any length are read whole. An empty table gives no rows.
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
from backhaul.llm.components import connected_components
from backhaul.llm.scratch import Scratch
from backhaul.llm.vectors import forest

SHINGLE = 5
DF_BITS, DF_CHUNK = 18, 4096
BANDS, ROWS = 12, 3
#: Rounds of leaders, members in one side of a block, and columns multiplied at once.
ROUNDS, BLOCK, COLUMNS = 2, 512, 4096
LEVELS = 12


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Per text its distinct shingles (48 bits), their counts, offsets, and a key of its words."""
    words, offsets = w.word_hashes(texts)
    lengths = np.diff(offsets)
    h, owner = w.ngrams(words, offsets, tuple(range(1, SHINGLE)))
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    keys = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() if b > a else None
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    if len(short):
        h = np.append(h, np.array([int.from_bytes(keys[i][:8], "little") for i in short],
                                  np.uint64))
        owner = np.append(owner, short)
    packed = np.sort(owner.astype(np.uint64) << np.uint64(48) | h >> np.uint64(16))
    first = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else owner
    counts = np.diff(np.append(first, len(packed)))
    packed = packed[first]
    ends = np.searchsorted(packed, np.arange(1, len(texts) + 1, dtype=np.uint64) << np.uint64(48))
    return packed & np.uint64((1 << 48) - 1), counts, np.append(0, ends), keys


def bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(48 - DF_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by shingle bucket, over all of ``docs``, and their number."""
    n = 1 << DF_BITS
    schema = T.StructType([T.StructField("chunk", T.IntegerType()),
                           T.StructField("counts", T.ArrayType(T.LongType()))])

    def rows(total: np.ndarray, chunks) -> pa.RecordBatch:
        parts = total.reshape(len(chunks), -1)
        return pa.RecordBatch.from_arrays(
            [pa.array(chunks, pa.int32()), pa.array(list(parts), pa.list_(pa.int64()))],
            names=schema.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from backhaul.llm.batches import pieces

        total = np.zeros(n + DF_CHUNK, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                found, _, _, _ = shingles(piece.column("text").to_pylist())
                total[:n] += np.bincount(bucket(found), minlength=n)
                total[n] += piece.num_rows
        yield rows(total, range(n // DF_CHUNK + 1))

    def add(table: pa.Table) -> pa.Table:
        total = sum(x.values.to_numpy() for c in table.column("counts").chunks for x in c)
        return pa.Table.from_batches([rows(total, [table.column("chunk")[0].as_py()])])

    total = np.zeros(n + DF_CHUNK, np.int64)
    # 2^DF_BITS numbers whatever the corpus
    for row in docs.select("text").mapInArrow(count, schema).groupBy("chunk").applyInArrow(
            add, schema).toLocalIterator():
        total[row.chunk * DF_CHUNK:(row.chunk + 1) * DF_CHUNK] = row.counts
    return total[:n], int(total[n])


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    return np.log(1 + max(n, 1) / (1 + df))


_GAMMA: np.ndarray | None = None


def gamma_levels() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middle of 2^LEVELS equal steps."""
    global _GAMMA
    if _GAMMA is None:
        p = (np.arange(1 << LEVELS) + 0.5) / (1 << LEVELS)
        low, high = np.zeros(len(p)), np.full(len(p), 50.0)
        for _ in range(60):
            x = (low + high) / 2
            below = 1 - (1 + x) * np.exp(-x) < p
            low, high = np.where(below, x, low), np.where(below, high, x)
        _GAMMA = x
    return _GAMMA


LOG_COUNT = np.log(np.maximum(np.arange(1 << 16), 1))


def samples(found: np.ndarray, counts: np.ndarray, offsets: np.ndarray, log_idf: np.ndarray
            ) -> np.ndarray:
    """For each text (rows) and sample (columns), a 32-bit name of the sampled (shingle, level).

    With r, c from Gamma(2, 1) and b uniform, all fixed by shingle and sample, the level is
    t = floor(ln S / r + b), and the shingle with the least ln c - r (t - b) - r is taken.
    """
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, BANDS * ROWS), np.uint32)
    if not len(full):
        return out
    log_weight = log_idf[bucket(found)] + np.where(
        counts < len(LOG_COUNT), LOG_COUNT[np.minimum(counts, len(LOG_COUNT) - 1)],
        np.round(np.log(counts), 9))
    gamma = gamma_levels()
    log_gamma = np.log(gamma)
    mask = np.uint64((1 << LEVELS) - 1)
    spread = w.mix(found, 7)
    salts = w.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 11) | np.uint64(1)
    for k, salt in enumerate(salts):
        z = spread * salt
        z ^= z >> np.uint64(32)
        z *= np.uint64(0x9FB21C651E98DF25)
        r = gamma[z >> np.uint64(64 - LEVELS)]
        c = log_gamma[z >> np.uint64(64 - 2 * LEVELS) & mask]
        b = (z >> np.uint64(64 - 4 * LEVELS) & np.uint64((1 << 2 * LEVELS) - 1)) \
            * (1 / (1 << 2 * LEVELS))
        t = np.floor(log_weight / r + b)
        least = np.minimum.reduceat(c - r * (t - b) - r, offsets[full])
        out[full, k] = w.mix(least.view(np.uint64), k) >> np.uint64(32)
    return out


def signatures(docs: DataFrame, log_idf) -> DataFrame:
    """Columns id, digest, ``key`` (null without a word) and ``bands``."""
    schema = T.StructType([
        T.StructField("id", docs.schema["id"].dataType), T.StructField("digest", T.BinaryType()),
        T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def start():
        table = log_idf.value

        def work(piece):
            found, counts, offsets, keys = shingles(piece.column("text").to_pylist())
            drawn = samples(found, counts, offsets, table)
            band = np.zeros((len(keys), BANDS), np.uint64)
            for i in range(BANDS):
                for j in range(ROWS):
                    band[:, i] = w.mix(band[:, i] * np.uint64(w.BASE)
                                       + drawn[:, i * ROWS + j], i + 1)
            return [piece.column("id"), piece.column("digest"), pa.array(keys, pa.binary()),
                    pa.array(list(band.view(np.int64)), pa.list_(pa.int64()))]
        return work

    return map_text(docs, "text", schema, start)


def similarities(left: list[str], right: list[str], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    found, counts, offsets, _ = shingles([*left, *right])
    weight = counts * idf[bucket(found)]
    n = len(left)
    out = np.zeros(n)
    for i in range(n):
        a, b = slice(offsets[i], offsets[i + 1]), slice(offsets[n + i], offsets[n + i + 1])
        total = weight[a].sum() + weight[b].sum()
        _, x, y = np.intersect1d(found[a], found[b], assume_unique=True, return_indices=True)
        shared = np.minimum(weight[a][x], weight[b][y]).sum()
        out[i] = shared / (total - shared) if total else 0.0
    return out


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach ``threshold``."""
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()),
                           T.StructField("similarity", T.DoubleType())])

    def start():
        table = idf.value

        def work(piece):
            return [piece.column("a"), piece.column("b"),
                    pa.array(similarities(piece.column("left").to_pylist(),
                                          piece.column("right").to_pylist(), table))]
        return work

    joined = (pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("left")), "a")
              .join(texts.select(F.col("key").alias("b"), F.col("text").alias("right")), "b"))
    return map_text(joined, "left", schema, start).filter(F.col("similarity") >= threshold)


def shared_weight(found: np.ndarray, counts: np.ndarray, offsets: np.ndarray, idf: np.ndarray
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the smaller weights for every pair of texts, and each text's sum of weights.

    A count is a row of steps: min(a, b) adds up the steps that both texts reach. So the sums
    are one matrix product over (shingle, step), taken in pieces of COLUMNS.
    """
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    total = np.bincount(owner, counts * idf[bucket(found)], n)
    order = np.lexsort((counts, found))
    f, c, o = found[order], counts[order], owner[order]
    new = np.append(True, f[1:] != f[:-1]) if len(f) else np.zeros(0, bool)
    step = new.copy()
    step[1:] |= c[1:] != c[:-1]
    level = np.cumsum(step) - 1
    base = level[np.maximum.accumulate(np.where(new, np.arange(len(f)), 0))]
    at = np.flatnonzero(step)
    below = np.where(new[at], 0, np.append(0, c[at][:-1])[:len(at)])
    weight = (c[at] - below) * idf[bucket(f[at])]
    reach = level - base + 1
    row = np.repeat(o, reach)
    column = np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach, reach) \
        + np.repeat(base, reach)
    several = np.bincount(column, minlength=len(at)) > 1
    number = np.cumsum(several) - 1
    row, column, weight = row[several[column]], number[column[several[column]]], weight[several]
    shared = np.zeros((n, n))
    sort = np.argsort(column, kind="stable")
    row, column = row[sort], column[sort]
    for low in range(0, len(weight), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((n, min(COLUMNS, len(weight) - low)))
        part[row[a:b], column[a:b] - low] = 1
        shared += (part * weight[low:low + COLUMNS]) @ part.T
    return shared, total


def linked_in_blocks(members: DataFrame, texts: DataFrame, apart: DataFrame, idf,
                     threshold: float) -> DataFrame:
    """Edges (a, b) that join the components of each band as all its pairs would.

    ``members`` is (band, key, root), ``apart`` (band, n) the bands with several components.
    A band's members meet in blocks of bounded size, every pair in one; a block returns a
    spanning forest of the pairs that reach ``threshold`` across components, never the pairs.
    """
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    groups = apart.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("groups"))
    spread = (members.join(groups, "band").join(texts, "key")
              .withColumn("group", F.pmod(F.xxhash64("key", "band"), "groups").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
              .withColumn("low", F.least("group", "other"))
              .withColumn("high", F.greatest("group", "other")))

    def block(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        found, counts, offsets, _ = shingles(table.column("text").to_pylist())
        shared, total = shared_weight(found, counts, offsets, idf.value)
        close = shared >= threshold * (total[:, None] + total[None, :] - shared) - 1e-9
        root = np.array([r.hex() for r in table.column("root").to_pylist()])
        close &= root[:, None] != root[None, :]
        if table.column("low")[0] != table.column("high")[0]:
            group = table.column("group").to_numpy()
            close &= group[:, None] != group[None, :]
        label = forest(len(keys), *np.nonzero(np.triu(close, 1)))
        edge = np.flatnonzero(label != np.arange(len(keys)))
        return pa.table({"a": pa.array([keys[i] for i in edge], pa.binary()),
                         "b": pa.array([keys[label[i]] for i in edge], pa.binary())})

    return (spread.select("band", "low", "high", "group", "key", "root", "text")
            .groupBy("band", "low", "high").applyInArrow(block, schema))


def near_duplicates(rows: DataFrame, threshold: float = 0.8, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """Per row: the id, ``component_id`` (the smallest id of its component) and ``kept``, true for
    the one document of each component that has that id."""
    return (components(rows, threshold, id_column, text_column)
            .withColumnRenamed("id", id_column).drop("digest"))


def digest(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def deduplicate(rows: DataFrame, threshold: float = 0.8, id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """The rows, with all their columns, of the documents that ``near_duplicates`` keeps."""
    of, at = unused("id", rows), unused("digest", rows)
    dropped = (components(rows, threshold, id_column, text_column).filter("NOT kept")
               .select(F.col("id").alias(of), F.col("digest").alias(at)).distinct())
    return rows.join(dropped, (F.col(id_column) == F.col(of))
                     & (digest(text_column) == F.col(at)), "left_anti")


def unused(name: str, rows: DataFrame) -> str:
    """``name`` with underscores in front, so many that no column is called that."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name = f"_{name}"
    return name


def components(rows: DataFrame, threshold: float, id_column: str, text_column: str) -> DataFrame:
    """Columns id, digest (of the text), component_id and kept."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = rows.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"),
                       digest(text_column).alias("digest"))
    idf = inverse_frequencies(*document_frequencies(docs))
    shared, shared_log = (spark.sparkContext.broadcast(x) for x in (idf, np.log(idf)))
    signed = scratch.keep(signatures(docs, shared_log))
    classes = scratch.keep(
        signed.filter("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(
            F.min(F.struct("id", "digest")).alias("one"), F.first("bands").alias("bands"))
        .select("key", "one.id", "one.digest", "bands"))

    placed = classes.select("key", F.explode(F.array_distinct("bands")).alias("band"))
    several = scratch.keep(placed.groupBy("band").count().filter(F.col("count") > 1)
                           .select("band"))
    members = scratch.keep(placed.join(several, "band"))
    met = scratch.keep(members.select("key").distinct().join(
        classes.select("key", "id", "digest"), "key"))
    texts = scratch.keep(
        docs.join(met.select("key", "id", "digest"), ["id", "digest"])
        .select("key", "text").dropDuplicates(["key"]))

    links, tried, roots = None, None, None
    for turn in range(ROUNDS + 1):
        here = members if roots is None else members.join(
            roots.withColumnRenamed("node", "key"), "key", "left")
        here = here.withColumn("root", F.col("key") if roots is None
                               else F.coalesce("root", "key"))
        leader = F.struct(F.xxhash64("key", F.lit(turn)).alias("rank"), "key", "root")
        apart = scratch.keep(
            here.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                     F.min(leader).alias("leader"), F.count("*").alias("n"))
            .filter("low <> high")
            # of two members, the leader has met the other
            .filter("n > 2" if turn else "true")
            .select("band", "n", F.col("leader.key").alias("leader"),
                    F.col("leader.root").alias("leader_root")))
        if apart.isEmpty():
            break
        if turn == ROUNDS:
            found = scratch.keep(linked_in_blocks(here, texts, apart, shared, threshold))
        else:
            pairs = (here.join(apart, "band").filter("root <> leader_root")
                     .select(F.least("leader", "key").alias("a"),
                             F.greatest("leader", "key").alias("b")).distinct())
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = scratch.keep(pairs)
            found = scratch.keep(verified(pairs, texts, shared, threshold).select("a", "b"))
            tried = pairs if tried is None else tried.union(pairs)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            roots = connected_components(links, scratch)

    by_key = classes.select("key", "id")
    if roots is not None:
        by_key = by_key.join(roots.withColumnRenamed("node", "key"), "key", "left")
        by_key = by_key.withColumn("root", F.coalesce("root", "key"))
    else:
        by_key = by_key.withColumn("root", F.col("key"))
    by_key = scratch.keep(by_key)
    smallest = by_key.groupBy("root").agg(F.min("id").alias("component_id"))
    component = scratch.keep(by_key.join(smallest, "root").select("key", "component_id"))
    own = signed.select("id", "digest", F.when(F.col("id").isNotNull(), F.col("key")).alias("key"))
    return (own.join(component, "key", "left")
            .select("id", "digest", F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))
