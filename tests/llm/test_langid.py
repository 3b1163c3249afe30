import zlib

import numpy as np

from backhaul.llm import langid as li

STEMS = {"aa": ["kalo", "mira", "tenu", "soka"], "bb": ["zwist", "grumm", "plack", "drohn"],
         "cc": ["eille", "ouvre", "aisne", "uilly"]}


def text(lang, seed, n=12):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(STEMS[lang], n))


def test_presence_counts_each_gram_once():
    out = np.zeros((3, 1 << li.BITS), np.float32)
    n = li.presence(["ab ab!", "ab  AB", "12 ."], out)
    assert n[0] > 0 and n[2] == 0
    assert set(np.flatnonzero(out[1])) <= set(np.flatnonzero(out[0]))


def test_collapsed_weights_are_kernel_scores():
    texts = [text(l, s) for s in range(20) for l in STEMS]
    names = [l for _ in range(20) for l in STEMS]
    weights, bias, order = li.load(li.fit(texts, names, li.Settings(landmarks=60)))
    matrix = np.zeros((len(texts), 1 << li.BITS), np.float32)
    n = li.presence(texts, matrix)
    unit = matrix / np.sqrt(n)[:, None]
    # kernel ridge regression on all texts as landmarks, solved in the dual with a free bias
    kernel = (unit @ unit.T).astype(float)
    target = np.where(np.array(names)[:, None] == np.array(order), 1.0, -1.0)
    size = len(texts)
    system = np.block([[kernel + 1e-3 * size * np.eye(size), np.ones((size, 1))],
                       [np.ones((1, size)), np.zeros((1, 1))]])
    dual = np.linalg.solve(system, np.vstack([target, np.zeros((1, 3))]))
    expected = kernel @ dual[:-1] + dual[-1]
    assert np.abs(unit @ weights + bias - expected).max() < 0.02


def test_held_out_accuracy_and_null_languages(docs):
    rows = [(i, text(list(STEMS)[i % 3], i)) for i in range(300)]
    lang = {i: list(STEMS)[i % 3] for i in range(300) if i % 10}
    model = li.train(docs(rows, lang=lang))
    got = {r.doc_id: r for r in li.predict(docs(rows, lang="zz"), model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].lang_pred == list(STEMS)[i % 3] for i in held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_read(docs):
    rows = [(i, text("aa", i)) for i in range(30)] + [(50, None), (51, ""), (52, "12 34!"),
                                                     (None, "kalo"), (53, "kalo " * 100_000)]
    model = li.train(docs(rows, lang="aa"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(docs(rows), model).collect()}
    assert got[50] == got[51] == got[52] == ("und", 0.0)
    assert got[53][0] == got[None][0] == "aa"
    signs = [(i, t) for i, t in enumerate(["٣٤٥", "²", "Ⅳ", "½ ①", "५", "\u0301", "_"])]
    assert {r.lang_pred for r in li.predict(docs(signs), model).collect()} == {"und"}


def test_without_training_rows(docs):
    model = li.train(docs([]))
    assert li.predict(docs([]), model).count() == 0
    assert [r.lang_pred for r in li.predict(docs([(1, "kalo")]), model).collect()] == ["und"]
