import random
import re

import numpy as np
import pytest

from backhaul.llm import minhash as mh


def weights(text, idf):
    found, counts, _, _ = mh.shingles([text])
    return dict(zip(found.tolist(), counts * idf[mh.bucket(found)]))


def similarity(a, b):
    total = sum(a.values()) + sum(b.values())
    shared = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
    return shared / (total - shared) if total else 0.0


def test_shingles():
    found, counts, offsets, keys = mh.shingles(
        ["a b c d e f", None, "", "A, b! C d (e) f", "one two", "x y x y x y x", "two one"])
    assert np.diff(offsets).tolist() == [2, 0, 0, 2, 1, 2, 1]
    assert keys[0] == keys[3] and keys[1] is keys[2] is None and keys[4] != keys[6]
    assert counts[offsets[5]:offsets[6]].tolist() in ([2, 1], [1, 2])


def test_samples_agree_as_often_as_the_similarity_says(monkeypatch):
    monkeypatch.setattr(mh, "BANDS", 700)
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    other = list(words)
    for i in range(0, 400, 60):
        other[i] = "changed"
    left, right = " ".join(words + words[:30]), " ".join(other)
    idf = np.random.default_rng(2).uniform(0.5, 6, 1 << mh.DF_BITS)
    found, counts, offsets, _ = mh.shingles([left, right])
    drawn = mh.samples(found, counts, offsets, np.log(idf))
    expected = similarity(weights(left, idf), weights(right, idf))
    assert 0.5 < expected < 0.9
    assert (drawn[0] == drawn[1]).mean() == pytest.approx(expected, abs=0.035)
    assert mh.similarities([left], [right], idf)[0] == pytest.approx(expected)


def test_shared_weight_of_all_pairs(monkeypatch):
    monkeypatch.setattr(mh, "COLUMNS", 5)
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(12)]
    idf = np.random.default_rng(2).uniform(0.5, 6, 1 << mh.DF_BITS)
    found, counts, offsets, _ = mh.shingles(texts)
    shared, total = mh.shared_weight(found, counts, offsets, idf)
    sets = [weights(t, idf) for t in texts]
    for a in range(12):
        assert total[a] == pytest.approx(sum(sets[a].values()))
        for b in set(range(12)) - {a}:
            assert shared[a, b] == pytest.approx(
                sum(min(sets[a][k], sets[b][k]) for k in sets[a].keys() & sets[b].keys()))


def test_document_frequencies(docs):
    rows = [(1, "a b c d e"), (2, "a b c d e f"), (3, None), (4, "a b c d e a b c d e")]
    df, n = mh.document_frequencies(docs(rows))
    found, _, _, _ = mh.shingles(["a b c d e"])
    assert n == 4 and df[mh.bucket(found)].tolist() == [3]


def corpus():
    rng = random.Random(7)

    def prose(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    rows, i = [], 0
    for group in range(12):
        base = prose(rng.randint(30, 120))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = "edit"
            rows.append((i, " ".join(copy)))
            i += 1
    hot = prose(150)
    for _ in range(40):  # a large group of near copies
        copy = list(hot)
        copy[rng.randrange(150)] = f"e{i}"
        rows.append((i, " ".join(copy)))
        i += 1
    rng.shuffle(rows)
    return rows


def components(rows):
    """All pairs, by the definition."""
    texts = [t for _, t in rows]
    df = np.zeros(1 << mh.DF_BITS)
    for t in texts:
        df[mh.bucket(mh.shingles([t])[0])] += 1
    idf = np.log(1 + len(rows) / (1 + df))
    sets = [weights(t, idf) for t in texts]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if similarity(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                label[x] = y
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize("rounds", [2, 0])
def test_components_against_brute_force(docs, monkeypatch, rounds):
    monkeypatch.setattr(mh, "ROUNDS", rounds)
    monkeypatch.setattr(mh, "BLOCK", 16)
    rows = corpus()
    got = {r.doc_id: r.component_id for r in mh.near_duplicates(docs(rows)).collect()}
    assert got == components(rows)
    kept = mh.deduplicate(docs(rows))
    assert kept.columns == docs(rows).columns
    assert {r.doc_id for r in kept.collect()} == set(got.values())


def test_nulls_ties_and_repeats(docs):
    long = "word " * 60_000
    rows = [(5, "a b c"), (4, "A b, c."), (6, None), (7, ""), (8, "?!"), (None, "a b c"),
            (9, long), (3, long), (2, "b a c"), (4, "A b, c."), (4, "something else")]
    out = mh.near_duplicates(docs(rows)).collect()
    got = {r.doc_id: (r.component_id, r.kept) for r in out}
    assert len(out) == len(rows)
    assert got[5] == (4, False) and got[9] == (3, False) and got[2] == (2, True)
    assert all(got[i] == (i, True) for i in (6, 7, 8)) and got[None] == (None, True)
    kept = sorted(((r.doc_id, r.text) for r in mh.deduplicate(docs(rows)).collect()), key=str)
    gone = [(5, "a b c"), (9, long)]
    assert kept == sorted((r for r in rows if r not in gone), key=str)


def test_empty(docs):
    assert mh.near_duplicates(docs([])).count() == 0
    assert mh.deduplicate(docs([])).count() == 0
