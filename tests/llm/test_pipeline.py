import pytest

import corpus_pipeline as cp
from backhaul.llm import minhash, secrets, sentencepiece, toxicity

DATA = "/root/testdata/sf0.001"


def test_each_stage_over_what_its_predecessor_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["toxicity", "minhash_dedup", "decontamination", "secrets",
                                         "sentencepiece"]
    seen = []
    for k, (_, stage) in enumerate(cp.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r for r in docs.collect()}
        seen.append((before, after))
        if k < 4:
            assert docs.columns == columns
    model = toxicity.train(spark.read.parquet(f"{DATA}/documents.parquet"),
                           spark.read.parquet(f"{DATA}/labels.parquet"))
    weights, bias = toxicity.load(model)
    before, after = seen[0]
    ids = sorted(before)
    scores = toxicity.scores([before[i].text for i in ids], weights, bias)
    assert set(after) == {i for i, s in zip(ids, scores) if s < 0.5}

    before, after = seen[1]
    keys = {}
    for i in sorted(before):
        keys.setdefault(minhash.shingles([before[i].text])[3][0], []).append(i)
    assert all(len(set(g) & set(after)) <= 1 for k, g in keys.items() if k)

    before, after = seen[2]
    tests = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    clean = {i for i, r in before.items() if not any(t.text in r.text for t in tests)}
    assert set(after) == clean

    before, after = seen[3]
    assert set(before) == set(after)
    assert all(after[i].text == secrets.mask(before[i].text)
               and after[i].n_chars == len(after[i].text) for i in after)

    before, after = seen[4]
    pieces = sentencepiece.Pieces(sentencepiece.read_model(cp.TOKENIZER))
    assert set(before) == set(after) and all(r.round_trip for r in after.values())
    assert all(pieces.decode(r.token_ids) == before[i].text for i, r in after.items())


def test_run_gives_the_last_stage(spark):
    rows = cp.run(spark, DATA)
    assert rows.count() > 100 and rows.select("doc_id").distinct().count() == rows.count()


@pytest.mark.parametrize("name,stage", cp.STAGES[:4])
def test_stages_keep_odd_rows(docs, name, stage, spark):
    rows = [(1, None), (2, ""), (None, "plain text"), (3, "other plain words here " * 5),
            (3, "other plain words here " * 5)]
    frame = docs(rows)
    out = stage(spark, frame, DATA)
    assert out.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(rows, key=str)
    assert stage(spark, docs([]), DATA).count() == 0


def test_last_stage_keeps_odd_rows(docs, spark):
    got = cp.tokenize(spark, docs([(1, None), (2, ""), (None, "a")]), DATA).collect()
    assert [r.token_ids for r in got][:2] == [None, []] and all(r.round_trip for r in got)
