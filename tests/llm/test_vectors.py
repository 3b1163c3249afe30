import numpy as np
import pytest

from backhaul.llm import vectors as v


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string, root int")


def brute_force(rows, threshold=0.95):
    ok = {}
    for k, (_, x, *_) in enumerate(rows):
        if x and all(c is not None and np.isfinite(c) for c in x) and any(x) \
                and rows[k][0] is not None:
            ok[k] = np.float32(x).astype(float) / np.linalg.norm(np.float32(x).astype(float))
    links = {k: [j for j in ok if j != k and len(ok[j]) == len(ok[k])
                 and ok[k] @ ok[j] >= threshold] for k in ok}
    out = []
    for k, r in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((r[0], len(links.get(k, [])),
                    r[0] if r[0] is None else min(rows[j][0] for j in seen)))
    return out


def run(spark, rows, **more):
    got = v.near_duplicates(table(spark, rows), **more).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(30):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 9))):
            rows.append(centre + rng.normal(size=16) * rng.choice([0.01, 0.15, 0.4]))
    rows += [rows[0]] * 20 + [rows[5] * 3.5] * 2
    order = rng.permutation(len(rows))
    return [(int(i), [float(c) for c in rows[k]], "x", 1) for i, k in enumerate(order)]


def test_against_brute_force(spark, clustered):
    assert run(spark, clustered) == sorted(brute_force(clustered), key=str)


def test_small_blocks_give_the_same(spark, clustered, monkeypatch):
    expected = sorted(brute_force(clustered), key=str)
    monkeypatch.setattr(v, "BLOCK", 7)
    monkeypatch.setattr(v, "BUCKET", 20)
    assert run(spark, clustered) == expected


def test_unusable_and_repeated_rows(spark):
    a = [1.0, 2.0]
    rows = [(1, None, "x", 1), (2, [], "x", 1), (3, [0.0, 0.0], "x", 1), (4, [1.0, None], "x", 1),
            (5, [float("nan"), 1.0], "x", 1), (6, [float("inf"), 1.0], "x", 1), (None, a, "x", 1),
            (9, a, "x", 1), (9, a, "x", 1), (8, a, None, None), (7, [1.0, 2.0, 0.0], "x", 1),
            (10, [-0.0, 1.0], "x", 1), (11, [0.0, 1.0], "x", 1)]
    assert run(spark, rows) == sorted(brute_force(rows), key=str)


def test_empty(spark):
    assert run(spark, []) == []


def test_layout_keeps_the_miss_rate():
    for n in (10, 10_000, 10**9):
        signs, tables = v.layout(n, 0.95, 1e-4)
        agree = 1 - np.arccos(0.95) / np.pi
        assert (1 - agree ** signs) ** tables <= 1e-4
