import random
import re
from collections import defaultdict

import pytest

from backhaul.llm import mixing, queries

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, text string"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Targets by source, by sharing what is over again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    full, left = set(), 1.5 * sum(sizes.values())
    while left > 1e-9 * (1 + sum(sizes.values())) and len(full) < len(order):
        total = sum(weight[s] for s in order if s not in full)
        for s in order:
            if s not in full:
                target[s] += left * weight[s] / total
        left = 0.0
        for s in order:
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
    return target


def check(rows, got):
    """What must hold whatever the choices are."""
    sizes, taken, longest = (defaultdict(int) for _ in range(3))
    expected = defaultdict(list)
    for doc_id, source, text in rows:
        n = size_of(text)
        sizes[source] += n
        longest[source] = max(longest[source], n)
        expected[doc_id, source].append(n)
    target = brute_targets(sizes)
    found = defaultdict(list)
    for r in got:
        found[r.doc_id, r.source].append(r.size)
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], rel=1e-9, abs=1e-6)
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    for source, n in sizes.items():
        assert abs(taken[source] - target[source]) <= 2 * longest[source] + 1e-6
    return taken, target


def run(spark, rows, schema=SCHEMA, **options):
    return mixing.mix(spark.createDataFrame(rows, schema), **options).collect()


def corpus(n, seed=0, sources=("a", "b", "B", "é", None, "", "z")):
    rng = random.Random(seed)
    return [(i, sources[0] if rng.random() < 0.3 else rng.choice(sources),
             rng.choice([None, "", " \t\n"]) if rng.random() < 0.05
             else "w " * int(rng.lognormvariate(3, 1.2)) + "é x\x1cy")
            for i in range(n)]


@pytest.mark.parametrize("part, window", [(6, 3), (50, 20), (4096, 64)])
def test_targets_are_met(spark, part, window):
    rows = corpus(1500, part)
    taken, target = check(rows, run(spark, rows, part=part, window=window))
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.02)


def test_words_taken_are_close(spark):
    """Large documents are decided first, so the error is that of small ones."""
    rows = corpus(4000, 5, ("a", "b", "c", "d")) + [(9999, "a", "w " * 20_000)]
    taken, target = check(rows, run(spark, rows, part=500))
    for source in taken:
        assert abs(taken[source] - target[source]) <= 10


def test_reruns_agree_however_rows_are_partitioned(spark):
    rows = corpus(800, 1) + [(3, "a", "one two three")] * 40
    first = sorted(map(str, run(spark, rows, part=130)))
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert sorted(map(str, mixing.mix(frame, part=130).collect())) == first


@pytest.mark.parametrize("window", [3, 5, 20])
def test_each_document_is_taken_with_its_probability(window):
    rng = random.Random(4)
    docs = [(i, rng.choice([0.25, 0.6]), float(rng.choice([0, 1, 3, 3, 8, 90]))) for i in range(9)]
    counts, rounds = [0.0] * len(docs), 8000
    for _ in range(rounds):
        for i, q in mixing.fly(docs, rng, True, window):
            assert q in (0.0, 1.0)
            counts[i] += q
    for (_, p, _), count in zip(docs, counts):
        assert abs(count / rounds - p) < 0.025


def test_flight_keeps_both_sums():
    rng = random.Random(6)
    docs = [(i, 0.37, float(rng.choice([0, 1, 2, 5, 9]))) for i in range(500)]
    done = dict(mixing.fly(docs, rng, False, 9))
    assert len([q for q in done.values() if 0 < q < 1]) <= 9
    assert sum(done.values()) == pytest.approx(0.37 * 500)
    assert sum(done[i] * s for i, _, s in docs) == pytest.approx(sum(0.37 * s for _, _, s in docs))


def test_targets_share_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, "d": 0, "e": 5000, None: 3}
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: r.target for r in run(spark, rows)}
    assert got == pytest.approx(brute_targets(sizes))


def test_edges(spark):
    schema = SCHEMA + ", size long, part long, digest long, copy long, target double, n long"
    rows = [(None, None, None), (None, "s", "a b"), (1, "s", "long " * 1_000_000),
            (1, "s", "x"), (2, "s", "")]
    check(rows, run(spark, [(*r, 1, 1, 1, 1, 1.0, 1) for r in rows], schema))
    assert run(spark, []) == []
    check([(1, "s", None)], run(spark, [(1, "s", None)]))


def test_query(spark):
    got = queries.op11_source_mixing(spark, DATA)
    assert got.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    assert [f.dataType.simpleString() for f in got.schema[1:5]] == ["bigint", "bigint", "double",
                                                                   "bigint"]
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet")
            .select("doc_id", "source", "text").collect()]
    check(rows, got.collect())
