import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from backhaul.llm import merkle, queries

DATA = "/root/testdata/sf0.001"


def written(value):
    if value is None:
        return b"-"
    text = str(value).encode()
    return str(len(text)).encode() + b":" + text


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def reduce(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(below[i:i + 8]) for i in range(0, len(below), 8)])
    return levels


def siblings(levels, at):
    path = []
    for nodes in levels[:-1]:
        run = nodes[at // 8 * 8:at // 8 * 8 + 8]
        path.append((run[:at % 8], run[at % 8 + 1:]))
        at //= 8
    return path


def brute(rows):
    """The contract, row by row; rows are (doc_id, text, lang, source, n_chars)."""
    def leaf_of(row, text):
        i, _, lang, source, n = row
        return sha256(b"".join(map(written, (i, source, lang, n, text)))).hexdigest()

    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0,
                                             leaf_of(row, row[1]), row))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    grown = {}
    for lang in order:
        trees[lang].sort(key=lambda x: x[:3])
        grown[lang] = reduce([x[2] for x in trees[lang]])
    over = reduce([grown[lang][-1][0] for lang in order])
    root = over[-1][0] if order else None
    result = []
    for at, lang in enumerate(order):
        for i, (_, _, leaf, row) in enumerate(trees[lang]):
            path = siblings(grown[lang], i) + siblings(over, at)
            text = row[1]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(row, text)
            for left, right in path:
                node = digest([*left, node, *right])
            result.append((row[0], leaf, grown[lang][-1][0], root,
                           digest([d for left, right in path for d in left + right]),
                           node, node == root))
    return result


def run(spark, rows, extra="", **options):
    frame = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long" + extra)
    return list(map(tuple, merkle.manifest(frame, merkle.tampered(), **options).collect()))


def same(got, expected):
    assert sorted(got, key=str) == sorted(expected, key=str)


def table(n, langs, seed=1):
    rng = random.Random(seed)
    return [(i * 7, rng.choice(["", None, "Ab Zé", "plain"]) if i % 5 == 0 else f"Text {i} ÄB",
             langs[i % len(langs)] if i % 3 else langs[0], rng.choice([None, "s", ""]),
             rng.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize("n, langs", [
    (1, ["en"]), (2, [None]), (8, ["en"]), (9, ["en"]), (65, ["en", None, "", "z"]),
    (300, [f"l{i}" for i in range(30)] + ["é", "-", None])])
def test_small_trees(spark, n, langs):
    rows = table(n, langs)
    same(run(spark, rows), brute(rows))


def test_superblocks_of_more_rounds(spark):
    """With superblocks of 8 nodes, three rounds are needed in a language and two over them."""
    rows = table(700, ["en"] + [f"l{i}" for i in range(12)])
    same(run(spark, rows, levels=1), brute(rows))


def test_a_tree_larger_than_a_superblock(spark):
    rows = table(5000, ["en", "de"])
    same(run(spark, rows), brute(rows))


def test_nulls_ties_and_large_ids(spark):
    big = 2 ** 62 + 1
    rows = [(None, "b", "en", "s", 1), (None, "a", "en", "s", 1), (big, "A", "en", "s", 1),
            (big, "A", "en", "s", 1), (big, "B", "en", "s", 1), (-5, None, None, None, None)]
    same(run(spark, rows), brute(rows))


def test_clashing_columns_long_text_and_no_rows(spark):
    extra = ", tree string, place long, n long, block long, digest string, claimed string"
    rows = [(i, "Long word " * (500_000 if i == 3 else 1), "en", "s", 1) for i in range(10)]
    more = [(*r, "x", 1, 1, 1, "x", "x") for r in rows]
    same(run(spark, more, extra), brute(rows))
    assert run(spark, [], extra) == []


def test_query_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet")
            .select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = queries.op13_merkle_manifest(spark, DATA)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                           "verified"]
    same(list(map(tuple, got.collect())), brute(rows))
    changed = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1]
               and any("A" <= c <= "Z" for c in r[1])}
    assert changed and {r.doc_id for r in got.collect() if not r.verified} == changed


def test_sql_against_the_contract():
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    rows = db.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    same(db.execute(queries.oracle_sql()["op13_merkle_manifest"]).fetchall(), brute(rows))
