import random
from collections import Counter

import numpy as np
import pytest

from backhaul.llm import suffix


def covered(texts, length):
    """For each text the bytes to remove, from the definition."""
    counts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = [False] * len(t)
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                mark[i:i + length] = [True] * length
        out.append(mark)
    return out


def test_repeated_windows_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        length = rng.choice([2, 3, 5, 8, 20])
        letters = rng.choice([b"ab", b"abcd\0", bytes(range(250, 256))])
        base = bytes(rng.choice(letters) for _ in range(60))
        parts = [base[(a := rng.randint(0, 50)):a + rng.randint(0, 50)]
                 + bytes(rng.choice(letters) for _ in range(rng.randint(0, 20)))
                 for _ in range(rng.randint(1, 8))]
        weights = np.array([rng.choice([1, 1, 1, 2]) for _ in parts], float)
        counts = Counter()
        for p, weight in zip(parts, weights):
            for i in range(len(p) - length + 1):
                counts[p[i:i + length]] += weight
        expected = [[i for i in range(len(p) - length + 1) if counts[p[i:i + length]] >= 2]
                    for p in parts]
        assert [x.tolist() for x in suffix.repeated_windows(parts, weights, length)] == expected


def test_segments_hold_each_window_once_and_anchors_follow_content():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90))) for _ in range(20)]
    texts += [b"ab" * 60, texts[3] + b"x" + texts[4]]
    data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
    anchor, first, last = suffix.segments(data, ends, 20, 8)
    windows = [(data[i:i + 20], a) for a, p, q in zip(anchor, first, last) for i in range(p, q)]
    assert Counter(w for w, _ in windows) == Counter(
        t[i:i + 20] for t in texts for i in range(len(t) - 19))
    assert len(set(windows)) == len({w for w, _ in windows})
    for p, q in zip(first, last):
        inside = [data[i:i + 20] for i in range(p, q)]
        assert len(set(inside)) == len(inside)


def corpus():
    rng = random.Random(5)

    def noise(n):
        return "".join(rng.choice("abcdefgh é") for _ in range(n))

    shared, line = noise(90), noise(45)
    return [(1, noise(200)), (2, noise(60) + shared + noise(60)), (3, shared), (4, shared),
            (5, shared[:70] + noise(50)), (6, None), (7, ""), (8, "xy" * 80), (9, noise(39)),
            *[(10 + i, noise(50) + line + noise(50)) for i in range(8)],
            (30, line + noise(20) + line), (None, shared[20:]), (3, shared), (40, "é" * 60)]


@pytest.mark.parametrize("classes", [500, 2])
def test_rows_against_brute_force(docs, monkeypatch, classes):
    monkeypatch.setattr(suffix, "CLASSES", classes)
    rows = corpus()
    expected = Counter()
    texts = [(t or "").encode() for _, t in rows]
    for (i, _), t, mark in zip(rows, texts, covered(texts, 40)):
        kept = bytes(b for b, m in zip(t, mark) if not m)
        spans = sum(m and (k == 0 or not mark[k - 1]) for k, m in enumerate(mark))
        expected[i, len(t), kept, spans] += 1
    got = suffix.deduplicate(docs(rows), length=40, gram=12).collect()
    assert Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.removed)) for r in got) == expected


def test_empty(docs):
    assert suffix.deduplicate(docs([])).count() == 0
