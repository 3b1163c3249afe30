import pytest
import sentencepiece as library
from hypothesis import given, settings
from hypothesis import strategies as st

from backhaul.llm import sentencepiece as sp
from backhaul.llm.queries import TOKENIZER

MODEL = sp.read_model(TOKENIZER)
PIECES = sp.Pieces(MODEL)


def brute_force(part):
    """Best score by trying every piece at every place."""
    proto = {}
    for piece, (_, score, i) in PIECES.automaton.items():
        proto[piece] = (score, i)
    best = [(0.0, ())]
    for end in range(1, len(part) + 1):
        options = []
        for start in range(max(0, end - 16), end):
            piece = part[start:end]
            if piece in proto:
                options.append((best[start][0] + proto[piece][0],
                                best[start][1] + (proto[piece][1],)))
        if part[end - 1] not in PIECES.single:
            options.append((best[end - 1][0] + PIECES.unknown_score, best[end - 1][1] + tuple(
                PIECES.byte_id[b] for b in part[end - 1].encode())))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1][0]


def score(ids):
    scores = {i: s for _, s, i in PIECES.automaton.values()}
    return sum(scores.get(i, 0.0) for i in ids)


@pytest.mark.parametrize("part", ["▁hello", "▁unbelievable", "▁the", "x", "▁naïveté", "▁1234"])
def test_best_path_scores_as_brute_force(part):
    assert score(PIECES.best_path(part)) == pytest.approx(brute_force(part))


def test_same_as_the_library_told_to_use_unigrams():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(MODEL)
    proto.trainer_spec.model_type = 1
    # the library sums in single precision; without the far outliers its sums are exact
    for p in proto.pieces:
        p.score = max(p.score, -40_000.0)
    changed = proto.SerializeToString()
    reference, own = library.SentencePieceProcessor(model_proto=changed), sp.Pieces(changed)
    for text in ("Hello world", "The and attion to thanedble the, anea.", "Ciónesó el ß",
                 "tokens and pieces", "a b c"):
        ids = own.encode(text)
        assert ids == reference.encode(text)
        assert own.decode(ids) == reference.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁ab\n\x00é漢\U0001F600"), st.characters(codec="utf-8")),
               max_size=60))
def test_round_trip(text):
    ids = PIECES.encode(text)
    assert PIECES.decode(ids) == text and (ids == []) == (text == "")


def test_long_text_without_a_space():
    text = "abc漢" * 50_000
    assert PIECES.decode(PIECES.encode(text)) == text


def test_rows(docs):
    rows = [(1, None), (2, ""), (2, "a  b"), (None, "漢字 ▁ x")]
    out = sp.decode(sp.encode(docs(rows), MODEL), MODEL)
    got = out.collect()
    assert [r.decoded for r in got] == [t for _, t in rows]
    assert got[0].token_ids is None and got[1].token_ids == []
    assert out.columns.count("token_ids") == 1
    assert sp.encode(docs([]), MODEL).count() == 0


def test_one_python_stage(spark, docs, capsys):
    rows = [(1, None), (2, ""), (3, "a  b"), (None, "漢字 ▁ x")]
    both = sp.encode(docs(rows), MODEL, decoded="decoded")
    assert [r.decoded for r in both.collect()] == [t for _, t in rows]
    both.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
