"""Merkle manifest of a table: a tree of digests per language, one root, a proof per row.

Every row is a leaf: the SHA-256 of its columns. The leaves of a language are laid side by side in
the order of their ids; while more than one node remains, every eight consecutive ones (the last
run may hold fewer) become the digest of theirs. What remains is the language's subroot; the
subroots, ordered by language, are reduced alike to the root. A row's proof is the digests beside
its path. Folding a row's digest with its proof gives the root if and only if the row is the one
that was recorded.

**Cogrouped subtree exchange.** 8^4 consecutive nodes are a superblock, whose subtree one task
reduces. A first round sends up one digest per superblock, further rounds reduce those in the same
way. On the way down every superblock is given the nodes beside its path to the root, and is
cogrouped with them: one function reduces the subtree again, joins each node's proof inside with
the one outside, and folds. A superblock holds 4,096 rows of 100 bytes whatever a language's share
of the table is, and the nodes beside its path are seven per level. Texts are hashed where they are
read and never shuffled.

Defined cases: a null column is written ``-`` and an empty text ``0:``. Rows without an id come
before all others of their language; rows without a language are a tree of their own, before the
others. Rows equal in language and id are ordered by their digest; equal rows are leaves of equal
digest that lie side by side, each with the proof of its place. A single leaf is its tree's
subroot, and its proof in that tree is empty. Texts of any length are hashed whole. Further columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backhaul.llm.scratch import Scratch

#: Nodes whose digests become one.
RUN = 8
#: Levels that one task reduces: RUN ** LEVELS nodes.
LEVELS = 4
#: Columns of a leaf in the order in which they are hashed.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _written(value: str | Column) -> Column:
    """``-``, or the number of UTF-8 bytes, a colon, the value."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[str | Column]) -> Column:
    """Digest of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(_written, columns)), 256))


# ---- one superblock, in plain Python ---------------------------------------------------------

def digest_of(run: Sequence[bytes]) -> bytes:
    """The digest of the digests of a run, taken as hexadecimal text."""
    return sha256("".join([d.hex() for d in run]).encode()).digest()


def levels_of(n: int, most: int) -> int:
    """How many levels, of ``most``, a superblock of a tree of ``n`` nodes is reduced by."""
    levels = 0
    while n > 1 and levels < most:
        n = -(-n // RUN)
        levels += 1
    return levels


def subtree(leaves: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of each level, the given ones first, the top last."""
    grown = [leaves]
    for _ in range(levels):
        below = grown[-1]
        grown.append([digest_of(below[i:i + RUN]) for i in range(0, len(below), RUN)])
    return grown


def beside(grown: list[list[bytes]], at: int) -> tuple[list[int], list[bytes]]:
    """The path of node ``at``: per level its place in its run, and the others' digests joined."""
    places, others = [], []
    for nodes in grown[:-1]:
        run, place = divmod(at, RUN)
        siblings = nodes[run * RUN:(run + 1) * RUN]
        places.append(place)
        others.append(b"".join(siblings[:place] + siblings[place + 1:]))
        at = run
    return places, others


def folded(digest: bytes, places: Sequence[int], others: Sequence[bytes]) -> bytes:
    """The root that a leaf's digest and its proof give."""
    for place, joined in zip(places, others):
        siblings = [joined[i:i + 32] for i in range(0, len(joined), 32)]
        digest = digest_of([*siblings[:place], digest, *siblings[place:]])
    return digest


# ---- the same over a distributed table -------------------------------------------------------

def _placed(rows: DataFrame, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``place``, from 0 in each ``tree``, and ``n``, the size of its tree.

    Rows are sorted by ranges. One row per tree and range says how many lie ahead.
    """
    # (part << 33) + position: the order within and among the sorted ranges
    dealt = scratch.keep(rows.withColumn("dealt", F.monotonically_increasing_id()))
    order = ["tree", *order, "dealt"]
    ranged = scratch.keep(
        dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("dealt")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33)))
    scratch.drop(dealt)
    before = Window.partitionBy("tree").orderBy("part")
    ahead = (ranged.groupBy("tree", "part")
             .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
             .withColumn("ahead", F.sum("here").over(before) - F.col("here"))
             .withColumn("n", F.sum("here").over(Window.partitionBy("tree")))
             .drop("here"))
    return (ranged.join(ahead, ["tree", "part"])
            .withColumn("place", F.col("ahead") + F.col("at") - F.col("first"))
            .drop("part", "at", "first", "ahead"))


def _blocks(nodes: DataFrame, most: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / RUN ** most))


def _up(nodes: DataFrame, most: int) -> DataFrame:
    """One node per superblock."""
    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        leaves = group.sort_values("place")["digest"].tolist()
        n = int(group["n"].iloc[0])
        top, = subtree(leaves, levels_of(n, most))[-1]
        return pd.DataFrame({"tree": group["tree"].iloc[:1], "digest": [top],
                             "place": group["block"].iloc[:1],
                             "n": [-(-n // RUN ** most)]})

    return (_blocks(nodes, most).select("tree", "block", "place", "n", "digest")
            .groupBy("tree", "block")
            .applyInPandas(reduce, "tree string, digest binary, place long, n long"))


def _rounds(nodes: DataFrame, most: int, scratch: Scratch) -> list[DataFrame]:
    """Nodes of every round; the last has one node per tree."""
    rounds = [nodes]
    # a round divides the size of the largest tree by RUN ** most
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rounds.append(scratch.keep(_up(rounds[-1], most)))
    return rounds


OUTER = "tree string, place long, places array<int>, others array<binary>"


def _down(nodes: DataFrame, outer: DataFrame, most: int) -> DataFrame:
    """The paths of ``nodes`` up to the root, from those of the superblocks' tops."""
    def join(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        grown = subtree(group["digest"].tolist(), levels_of(int(group["n"].iloc[0]), most))
        paths = [beside(grown, i) for i in range(len(group))]
        return pd.DataFrame({
            "tree": group["tree"], "place": group["place"],
            "places": [[*p, *above["places"].iloc[0]] for p, _ in paths],
            "others": [[*o, *above["others"].iloc[0]] for _, o in paths]})

    return _cogrouped(nodes, outer, most).applyInPandas(join, OUTER)


def _cogrouped(nodes: DataFrame, outer: DataFrame, most: int):
    return (_blocks(nodes, most).groupBy("tree", "block")
            .cogroup(outer.withColumnRenamed("place", "block").groupBy("tree", "block")))


def manifest(rows: DataFrame, claimed: Column | None = None, id_column: str = "doc_id",
             columns: Sequence[str] = COLUMNS, tree_column: str = "lang",
             levels: int = LEVELS) -> DataFrame:
    """Per row: its leaf, subroot, root, the digest of its proof, and what folding gives.

    The tree is that of ``rows``. ``claimed``, an expression over them, is the leaf presented for
    checking, where null the recorded one; ``verified`` says whether it folds to the root with
    the row's proof. A task reduces ``levels`` levels at a time; the result does not depend on it.
    """
    scratch = Scratch(rows.sparkSession, "merkle")
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(tree_column).cast("string")), F.lit(""))
        .alias("tree"),
        F.col(id_column).alias("doc_id"), leaf(columns).alias("digest"),
        (F.lit(None).cast("binary") if claimed is None else claimed).alias("claimed"))
    placed = scratch.keep(_placed(leaves, ["doc_id", "digest"], scratch))
    rounds = _rounds(placed.select("tree", "place", "n", "digest"), levels, scratch)

    tops = scratch.keep(_placed(
        rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"),
        ["name"], scratch))
    over = _rounds(tops.select("tree", "place", "n", "digest"), levels, scratch)
    none = F.array().cast("array<binary>")
    outer = over[-1].select("tree", "place", F.array().cast("array<int>").alias("places"),
                            none.alias("others"))
    for nodes in reversed(over[:-1]):
        outer = _down(nodes, outer, levels)
    # a language's subroot has place 0 in its tree, and its place among the subroots over it
    outer = scratch.keep(
        tops.select("name", "place", F.col("digest").alias("subroot")).join(outer, "place")
        .select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "places",
                "others", "subroot", over[-1].select("digest").scalar().alias("root")))
    paths = outer.select("tree", "place", "places", "others")
    for nodes in reversed(rounds[1:-1]):
        paths = _down(nodes, paths, levels)
    outer = paths.join(outer.select("tree", "subroot", "root"), "tree")
    id_type = rows.schema[id_column].dataType
    checked = _checked(placed.withColumn("doc_id", F.col("doc_id").cast("string")), outer, levels)
    return checked.withColumn("doc_id", F.col("doc_id").cast(id_type)).withColumnRenamed(
        "doc_id", id_column)


MANIFEST = ("doc_id string, leaf string, subroot string, root string, proof_sha256 string, "
            "folded_root string, verified boolean")


def _checked(placed: DataFrame, outer: DataFrame, most: int) -> DataFrame:
    def check(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        above = above.iloc[0]
        up, outside = list(above["places"]), list(above["others"])
        joined = b"".join(outside).hex()
        root = bytes(above["root"])
        grown = subtree(group["digest"].tolist(), levels_of(int(group["n"].iloc[0]), most))
        proofs, roots = [], []
        claims = group["claimed"].where(group["claimed"].notna(), group["digest"])
        for i, digest in enumerate(claims):
            places, others = beside(grown, i)
            proofs.append(sha256((b"".join(others).hex() + joined).encode()).hexdigest())
            roots.append(folded(digest, places + up, others + outside))
        return pd.DataFrame({
            "doc_id": group["doc_id"], "leaf": [d.hex() for d in group["digest"]],
            "subroot": above["subroot"].hex(), "root": root.hex(), "proof_sha256": proofs,
            "folded_root": [r.hex() for r in roots], "verified": [r == root for r in roots]})

    return _cogrouped(placed, outer, most).applyInPandas(check, MANIFEST)


def tampered(columns: Sequence[str] = COLUMNS, id_column: str = "doc_id",
             text_column: str = "text") -> Column:
    """The leaf with the text's letters A to Z lower-cased, for rows whose id's crc32 is divisible
    by 3; null for all others."""
    lowered = F.translate(text_column, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.crc32(F.col(id_column).cast("string")) % 3 == 0,
                  leaf([lowered if c == text_column else c for c in columns]))


def crc32_sql(text: str) -> str:
    """DuckDB's expression of the crc32 of an ASCII text, which it has no function for."""
    return f"""xor(4294967295, list_reduce(flatten(list_transform(string_split({text}, ''),
        lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda r, o: CASE WHEN o >= 0 THEN xor(r, o)
                          ELSE xor(r >> 1, 3988292384 * (r & 1)) END, 4294967295::BIGINT))"""


def duckdb_sql(table: str) -> str:
    """``manifest`` with ``tampered`` over ``documents`` for DuckDB."""
    def written(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    def leaf_sql(text: str) -> str:
        return "sha256(" + " || ".join(
            written(text if c == "text" else c) for c in COLUMNS) + ")"

    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf_sql("text")} AS leaf,
           CASE WHEN doc_id IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % 3 = 0
                THEN {leaf_sql(f"translate(text, '{upper}', '{lower}')")}
                ELSE {leaf_sql("text")} END AS claimed
    FROM {table}),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
           count(*) OVER (PARTITION BY tree) AS n
    FROM leaves),
inner_nodes(tree, level, place, n, digest) AS (
    SELECT tree, 0, place, n, leaf FROM placed
    UNION ALL
    SELECT tree, level + 1, place // 8, (n + 7) // 8,
           sha256(string_agg(digest, '' ORDER BY place))
    FROM inner_nodes WHERE n > 1 GROUP BY tree, level, place // 8, n),
subroots AS (
    SELECT tree, level AS height, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place,
           count(*) OVER () AS n
    FROM inner_nodes WHERE n = 1),
outer_nodes(level, place, n, digest) AS (
    SELECT 0, place, n, subroot FROM subroots
    UNION ALL
    SELECT level + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
    FROM outer_nodes WHERE n > 1 GROUP BY level, place // 8, n),
root AS (SELECT digest AS root FROM outer_nodes WHERE n = 1),
nodes AS (
    SELECT tree, level, place, digest FROM inner_nodes WHERE n > 1
    UNION ALL
    SELECT s.tree, s.height + o.level, o.place, o.digest
    FROM subroots s, outer_nodes o WHERE o.n > 1),
paths(tree, leaf_place, level, place) AS (
    SELECT p.tree, p.place, l.level,
           CASE WHEN l.level < s.height THEN p.place // (8 ** l.level)::BIGINT
                ELSE s.place // (8 ** (l.level - s.height))::BIGINT END
    FROM placed p JOIN subroots s USING (tree)
    JOIN (SELECT DISTINCT tree, level FROM nodes) l USING (tree)),
runs AS (
    SELECT t.tree, t.leaf_place, t.level,
           coalesce(string_agg(n.digest, '' ORDER BY n.place)
                    FILTER (WHERE n.place < t.place), '') AS before,
           coalesce(string_agg(n.digest, '' ORDER BY n.place)
                    FILTER (WHERE n.place > t.place), '') AS after
    FROM paths t JOIN nodes n
      ON n.tree = t.tree AND n.level = t.level AND n.place // 8 = t.place // 8
    GROUP BY t.tree, t.leaf_place, t.level),
proofs AS (
    SELECT tree, leaf_place AS place, string_agg(before || after, '' ORDER BY level) AS proof
    FROM runs GROUP BY tree, leaf_place),
folds(tree, place, level, node) AS (
    SELECT tree, place, 0, claimed FROM placed
    UNION ALL
    SELECT f.tree, f.place, f.level + 1, sha256(r.before || f.node || r.after)
    FROM folds f JOIN runs r
      ON r.tree = f.tree AND r.leaf_place = f.place AND r.level = f.level),
folded AS (
    SELECT tree, place, arg_max(node, level) AS node FROM folds GROUP BY tree, place)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(q.proof, '')) AS proof_sha256,
       f.node AS folded_root, f.node = r.root AS verified
FROM placed p JOIN subroots s USING (tree)
JOIN folded f ON f.tree = p.tree AND f.place = p.place
LEFT JOIN proofs q ON q.tree = p.tree AND q.place = p.place
CROSS JOIN root r"""
