import numpy as np
import pytest

from backhaul.llm import ordinal as o


def loss(eta, grade, free):
    cut = np.concatenate([[-np.inf], o.thresholds(free), [np.inf]])
    p = [1 / (1 + np.exp(-(np.clip(c, -1e9, 1e9) - e))) for e, g in zip(eta, grade)
         for c in (cut[g + 1], cut[g])]
    return -np.sum(np.log(np.array(p[::2]) - np.array(p[1::2])))


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    eta, grade, free = rng.normal(size=30), rng.integers(0, 4, 30), np.array([-1.0, 0.2, -0.5])
    by_eta, by_free = o.gradients(eta, grade, free)
    step = 1e-6
    for i in range(5):
        e = np.eye(30)[i] * step
        assert by_eta[i] == pytest.approx((loss(eta + e, grade, free) - loss(eta - e, grade, free))
                                          / (2 * step), rel=1e-4)
    for i in range(3):
        e = np.eye(3)[i] * step
        assert by_free[i] == pytest.approx((loss(eta, grade, free + e) - loss(eta, grade, free - e))
                                           / (2 * step), rel=1e-4)


def graded(n):
    names = ["poor", "fair", "good", "fine"]
    return [(i, " ".join([names[i % 4]] * 2 + ["river", "stone", "light"][: i % 3 + 1]))
            for i in range(n)]


def test_four_grades(docs, labels):
    rows = graded(400)
    model = o.train(docs(rows), labels([(i, i % 4 + 1, 0) for i, _ in rows]), held_out=(5, 0))
    _, cuts, grades = o.load(model)
    assert grades.tolist() == [1, 2, 3, 4] and (np.diff(cuts) > 0).all()
    got = {r.doc_id: r for r in o.score(docs(rows), model, at_least=3).collect()}
    assert np.corrcoef([got[i].expected_grade for i, _ in rows],
                       [i % 4 for i, _ in rows])[0, 1] > 0.95
    assert np.mean([got[i].selected == (i % 4 >= 2) for i, _ in rows]) > 0.95


def test_nulls_single_grade_and_nothing(docs, labels):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "x"), (4, "word " * 100_000), (4, "| | ###")]
    one = o.train(docs(rows), labels([(1, 2, 0), (2, None, 0), (None, 1, 0)]), held_out=None)
    got = o.score(docs(rows), one).collect()
    assert len(got) == 6 and {r.expected_grade for r in got} == {2.0}
    none = o.train(docs(rows), labels([]))
    assert {(r.expected_grade, r.selected) for r in o.score(docs(rows), none).collect()} == {
        (None, False)}
    two = o.train(docs(rows), labels([(1, 0, 0), (4, 1, 0)]), held_out=None)
    got = {r.doc_id: r.expected_grade for r in o.score(docs(rows), two).collect()}
    assert got[2] == got[3] and all(0 <= g <= 1 for g in got.values())
    assert o.score(docs([]), two).count() == 0
