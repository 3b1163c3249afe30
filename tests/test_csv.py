from pyspark.sql import types as T

from backhaul.schemas import INGEST_SEQ
from backhaul.sources import staging

SCHEMA = T.StructType([T.StructField("order_id", T.StringType()),
                       T.StructField("price", T.DecimalType(12, 2)),
                       T.StructField("note", T.StringType())])


def test_malformed_records_are_split_off(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "order_id,price,note\nA,1.50,fine\nB,much,text\nC,2\nD,3,x,y\nE,,\n")
    good, bad = staging.split_csv(spark, str(tmp_path), SCHEMA)
    assert [r["order_id"] for r in good.collect()] == ["A", "E"]
    assert good.columns == ["order_id", "price", "note", INGEST_SEQ]
    assert [r["record"] for r in bad.collect()] == ["B,much,text", "C,2", "D,3,x,y"]
    assert bad.first()["file"].endswith("a.csv")
    assert staging.read_csv(spark, str(tmp_path), SCHEMA).count() == 5


def test_line_breaks_in_quoted_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('order_id,price,note\nA,1,"two\nlines"\nB,2,one\n')
    rows = staging.read_csv(spark, str(tmp_path), SCHEMA, multi_line=True).collect()
    assert [(r["order_id"], r["note"]) for r in rows] == [("A", "two\nlines"), ("B", "one")]


def write(path, name, rows, header="order_id,price,note"):
    (path / name).write_text("\n".join([header, *rows]) + "\n")


def notes(n, seed):
    """Records with quotes, commas and line breaks in quoted fields, some of many lines."""
    rows, expected = [], []
    for i in range(n):
        note = [f"plain {i}", f"two\nlines {i}", f'say ""{i}"", twice', "a\n\n\nb" * (1 + i % 40),
                f"x,{i}"][(i * seed) % 5]
        rows.append(f'{seed}-{i},{i}.25,"{note}"' if i % 5 or "\n" in note or '"' in note
                    or "," in note else f"{seed}-{i},{i}.25,{note}")
        expected.append((f"{seed}-{i}", note.replace('""', '"')))
    return rows, expected


def test_records_across_splits_and_files_of_unequal_size(spark, tmp_path):
    """Splits of 200 bytes: most records of many lines cross one, some cross several."""
    everything = []
    for name, n, seed in (("a.csv", 400, 1), ("b.csv", 3, 2), ("c.csv", 60, 3)):
        rows, expected = notes(n, seed)
        write(tmp_path, name, rows)
        everything += expected
    settings = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        frame = staging.read_csv(spark, str(tmp_path), SCHEMA, multi_line=True)
        assert frame.rdd.getNumPartitions() > 20
        rows = frame.orderBy(INGEST_SEQ).collect()
        plain = staging.read_csv(spark, str(tmp_path / "b.csv"), SCHEMA).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [(r["order_id"], r["note"]) for r in rows] == everything
    assert [float(r["price"]) for r in rows if r["order_id"].startswith("3-")][:2] == [0.25, 1.25]
    assert len(plain) >= 3


def test_load_order_follows_the_bytes_of_a_file(spark, tmp_path):
    for name, n in (("a.csv", 500), ("b.csv", 7)):
        write(tmp_path, name, [f"{name}-{i:04d},1,x" for i in range(n)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        for many in (False, True):
            rows = staging.read_csv(spark, str(tmp_path), SCHEMA, multi_line=many)
            got = [r["order_id"] for r in rows.orderBy(INGEST_SEQ).collect()]
            assert got == [f"{f}-{i:04d}" for f, n in (("a.csv", 500), ("b.csv", 7))
                           for i in range(n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_malformed_records_of_many_lines(spark, tmp_path):
    write(tmp_path, "a.csv", ['A,1,"x\ny"', 'B,much,"p\nq"', "C,2", "", 'D,3,"open'])
    good, bad = staging.split_csv(spark, str(tmp_path), SCHEMA, multi_line=True)
    assert {r["order_id"]: r["note"] for r in good.collect()}["A"] == "x\ny"
    assert {r["record"] for r in bad.collect()} >= {'B,much,"p\nq"', "C,2"}


def test_a_wrong_header_is_an_error(spark, tmp_path):
    import pytest

    write(tmp_path, "a.csv", ["A,1,x"], header="order_id,cost,note")
    with pytest.raises(Exception, match="header"):
        staging.read_csv(spark, str(tmp_path), SCHEMA, multi_line=True).collect()


def test_lines_are_put_together_in_one_pass(spark, tmp_path):
    """No split begins or ends inside a field, so nothing is read for pieces or headers again."""
    rows, expected = notes(200, 3)
    write(tmp_path, "a.csv", rows)
    frame = staging.read_csv(spark, str(tmp_path), SCHEMA, multi_line=True)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    assert [(r["order_id"], r["note"]) for r in frame.orderBy(INGEST_SEQ).collect()] == expected
