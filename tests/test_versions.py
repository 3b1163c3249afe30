import os

import pytest
from pyspark.sql import functions as F

from backhaul import versions
from backhaul.operators import revenue


def rows_of(make, amount=10, days=("5/1/2023", "7/2/2023", "9/2/2023", "bad date")):
    return make.staging(*[
        dict(order_id=f"O{i}", order_date=d, returned="Yes" if i % 2 else "No",
             request_date=d if i else None,
             total_amount=amount if d.endswith("/2/2023") else 10)
        for i, d in enumerate(days)])


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path)
            for f in names if f.endswith(".parquet")}


@pytest.fixture
def twice(spark, make, tmp_path):
    path = str(tmp_path / "w")
    assert versions.refresh(rows_of(make), path) == 1
    before = files(path)
    old = versions.read(spark, path)
    assert versions.refresh(rows_of(make, 25), path) == 2
    return path, before, old


def test_only_the_changed_month_is_written(spark, twice):
    path, before, _ = twice
    assert before <= files(path)
    new = {os.path.dirname(f) for f in files(path) - before}
    assert new == {"order_facts/part=2023-02/version=2", "staging/part=all/version=2"}
    facts = {e["part"]: e["version"] for e in versions.manifest(spark, path).collect()
             if e["table_name"] == "order_facts"}
    assert facts == {"2023-01": 1, "2023-02": 2, "undated": 1}


def test_readers_keep_their_version(spark, twice, collect):
    path, _, old = twice
    total = [float(collect(revenue.total_revenue(w.orders))[0]["total_revenue"])
             for w in (old, versions.read(spark, path), versions.read(spark, path, 1))]
    assert total == [40, 70, 40]
    assert versions.read(spark, path).order_facts.columns == old.order_facts.columns


def test_a_stopped_load_changes_nothing(spark, make, twice, monkeypatch):
    path, _, _ = twice

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(versions, "_commit", stop)
        with pytest.raises(KeyboardInterrupt):
            versions.refresh(rows_of(make, 99), path)
    assert versions.versions(spark, path) == [1, 2]
    assert versions.read(spark, path).orders.agg(F.sum("total_amount")).first()[0] == 70
    assert versions.refresh(rows_of(make, 33), path) == 3
    assert versions.read(spark, path).orders.agg(F.sum("total_amount")).first()[0] == 86


def test_two_loads_of_one_number(spark, make, twice):
    path, _, _ = twice
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        versions._commit(spark, [], 2, path)


def test_months_that_vanish_and_empty_tables(spark, make, twice):
    path, _, _ = twice
    versions.refresh(rows_of(make, days=("5/1/2023",)), path)
    w = versions.read(spark, path)
    assert w.orders.count() == 1 and w.returns.count() == 0 and w.order_returns.count() == 1
    assert w.returns.columns == versions.RETURNS.names


def test_vacuum(spark, twice):
    path, _, _ = twice
    assert versions.vacuum(spark, path, keep=2) == 0
    assert versions.vacuum(spark, path) == 2
    assert versions.versions(spark, path) == [2]
    assert versions.read(spark, path).orders.agg(F.sum("total_amount")).first()[0] == 70
    with pytest.raises(ValueError, match="no version 1"):
        versions.read(spark, path, 1)


def test_month_prunes(spark, twice, capsys):
    path, _, _ = twice
    versions.read_table(spark, path, "order_facts").filter("part = '2023-02'").explain()
    assert "PartitionFilters: [isnotnull(part" in capsys.readouterr().out


def test_value_that_moves_to_another_column_is_a_change(spark, make):
    a = make.staging(dict(payment_method="x", region=None))
    b = make.staging(dict(payment_method=None, region="x"))
    digests = [versions._digests("staging", r).first()["digest"] for r in (a, b, a)]
    assert digests[0] == digests[2] != digests[1]


def test_parts_are_moved_and_not_copied(spark, make, tmp_path, monkeypatch):
    stored = []
    store = versions._store
    monkeypatch.setattr(versions, "_store", lambda name, *a: (stored.append(name), store(name, *a)))
    path = str(tmp_path / "w")
    versions.refresh(rows_of(make), path)
    assert stored == ["returns"]
    assert not os.path.exists(f"{path}/_work/1")
    assert versions.read(spark, path).orders.count() == 4
    assert {"order_facts/part=undated/version=1", "staging/part=all/version=1"} <= {
        os.path.dirname(f) for f in files(path)}
