import zlib

import numpy as np
import pytest

from backhaul.llm import toxicity as tx


def plain_ftrl(rows, labels, s):
    """Coordinate by coordinate, as published."""
    z, n, bz, bn = {}, {}, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0)) <= s.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * s.l1) / ((s.beta + n[i] ** 0.5) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for row, label in zip(rows, labels):
            w = {i: weight(i) for i in row}
            b = -bz / ((s.beta + bn ** 0.5) / s.alpha)
            g = 1 / (1 + np.exp(-(sum(w.values()) + b))) - label
            for i in row:
                sigma = ((n.get(i, 0) + g * g) ** 0.5 - n.get(i, 0) ** 0.5) / s.alpha
                z[i] = z.get(i, 0) + g - sigma * w[i]
                n[i] = n.get(i, 0) + g * g
            bz += g - ((bn + g * g) ** 0.5 - bn ** 0.5) / s.alpha * b
            bn += g * g
    return {i: weight(i) for i in z}, -bz / ((s.beta + bn ** 0.5) / s.alpha)


def test_ftrl_as_published():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(80)]
    labels = np.array([float(3 in r) for r in rows])
    s = tx.Settings(l1=0.3, min_rows=1, epochs=2)
    weights, bias = tx.ftrl(rows, labels, s)
    expected, expected_bias = plain_ftrl(rows, labels, s)
    assert bias == pytest.approx(expected_bias)
    assert {i: weights[i] for i in expected} == pytest.approx(expected)


def test_features_are_words_pairs_triples_and_skips():
    flat, ends = tx.distinct(["One two three four", None, "", "one TWO", "?"])
    assert np.diff(ends).tolist() == [4 + 3 + 2 + 2 + 1, 0, 0, 3, 0]
    assert set(flat[ends[3]:ends[4]]) <= set(flat[:ends[1]])


def corpus(n):
    filler = ["river", "stone", "light", "table", "garden", "window"]
    return [(i, " ".join(filler[(i * 7 + k * k) % 6] for k in range(30))
             + (" vile" if i % 4 == 0 else "")) for i in range(n)]


def test_learns_without_the_held_out(docs, labels):
    rows = corpus(400)
    settings = tx.Settings(l1=1.0)
    model = tx.train(docs(rows), labels([(i, 1, int(i % 4 == 0)) for i, _ in rows]),
                     settings=settings)
    got = {r.doc_id: r for r in tx.score(docs(rows), model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].predicted == int(i % 4 == 0) for i in held)
    # labels of held-out rows have no influence
    flipped = [(i, 1, int((i % 4 == 0) ^ (zlib.crc32(str(i).encode()) % 5 == 0))) for i, _ in rows]
    assert tx.train(docs(rows), labels(flipped), settings=settings) == model
    kept = tx.keep_clean(docs(rows), model)
    assert kept.columns == docs(rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i % 4}


def test_nulls_empty_and_repeats(docs, labels):
    rows = corpus(200) + [(900, None), (None, "vile"), (901, ""), (902, "vile " * 100_000), (3, "x")]
    given = [(i, None, int(i % 4 == 0)) for i, _ in corpus(200)] + [
        (None, 1, 1), (7, 1, None), (4, 0, 0), (4, 0, 1)]
    model = tx.train(docs(rows), labels(given), settings=tx.Settings(l1=1.0))
    got = tx.score(docs(rows), model)
    out = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows) and out[900].score == out[901].score
    assert out[902].predicted == 1 and out[None].predicted == 1


def test_without_labels_or_documents(docs, labels):
    model = tx.train(docs([(1, "a")]), labels([]))
    assert [(r.score, r.predicted) for r in tx.score(docs([(1, "a")]), model).collect()] == [(0, 0)]
    model = tx.train(docs([]), labels([(1, 1, 1)]))
    assert tx.score(docs([]), model).count() == 0
