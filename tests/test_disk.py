"""What stays on disk while and after tables are stored, and that it is what is needed."""

import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from backhaul import Warehouse, versions
from backhaul.operators import load
from backhaul.plans import shared
from backhaul.streaming import jobs


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def left_over(spark, before, seconds=20):
    """Shuffle files that are new; they are taken away some time after their statement."""
    until = time.time() + seconds
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left


def files(path):
    return [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def staged(make, n=12):
    return make.staging(*[
        dict(order_id=f"O{i // 2}", product_id=f"P{i % 5}", category=["Home", "Toys"][i % 2],
             order_date=f"{1 + i % 28}/{1 + i % 12}/2023", quantity=13 if i % 4 == 0 else 2,
             returned="Yes" if i % 3 == 0 else "No", request_date="9/12/2023", ingest_seq=i,
             return_reason="Not as described", payment_method="1-URGENT") for i in range(n)])


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    shared.write_table(rows.repartition(4, "k"), f"{tmp_path}/a")
    shared.store_table(rows, f"{tmp_path}/b", ["k"], 4)
    assert not left_over(spark, before)
    assert spark.conf.get(shared.RELEASE) == "false"
    assert spark.read.parquet(f"{tmp_path}/a").count() == 1000
    assert all(f.endswith(".zstd.parquet") for f in files(tmp_path))


@pytest.mark.parametrize("mode", ["audit", "quarantine"])
def test_a_load_leaves_its_tables_alone(spark, make, tmp_path, monkeypatch, mode):
    """Orders moved step by step, as if the contested products were too many to send."""
    monkeypatch.setattr("backhaul.warehouse.MOST_CONTESTED", 0)
    path, rows = str(tmp_path / "w"), staged(make)
    w = Warehouse.load(rows, path, mode)
    assert set(os.listdir(path)) == {"staging", "customers", "products", "returns", "order_facts",
                                     *(["quarantine"] if mode == "quarantine" else [])}
    assert all(f.endswith(".zstd.parquet") for f in files(path))
    lazy = Warehouse.from_staging(rows).order_facts
    assert sorted(map(str, w.order_facts.select(lazy.columns).collect())) == sorted(
        map(str, lazy.collect()))


def test_a_version_is_stored_like_a_load(spark, make, tmp_path):
    path = str(tmp_path / "v")
    versions.refresh(staged(make), path)
    assert not any(map(files, (f"{path}/_work",)))
    assert files(path) and all(f.endswith(".zstd.parquet") for f in files(path))


def test_arrivals_are_there_once(spark, make, tmp_path):
    rows = staged(make)
    jobs.store_arrivals(rows, load.parse_date("order_date"), str(tmp_path))
    assert os.listdir(tmp_path) == ["arrivals"]
    assert spark.read.parquet(f"{tmp_path}/arrivals/*").count() == 12


def test_a_stream_keeps_few_states(spark, make, tmp_path):
    rows, seen = staged(make), {}
    jobs.store_arrivals(rows, load.parse_date("order_date"), str(tmp_path / "in"))
    stream = jobs.dedup(jobs.read_files(spark, f"{tmp_path}/in/arrivals/*", rows.schema, 16))

    def start(writer):
        seen.update({name: spark.conf.get(name) for name in jobs.STATES_KEPT})
        return writer.format("parquet").start(f"{tmp_path}/out/data")

    jobs._run(stream, f"{tmp_path}/out", start, partitions=2)
    assert seen == jobs.STATES_KEPT and seen["spark.sql.streaming.minBatchesToRetain"] == "2"
    assert spark.conf.get("spark.sql.streaming.minBatchesToRetain", "100") == "100"


def test_an_ended_stream_leaves_what_it_emitted(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(entry, "_folder", lambda w, purpose: f"{tmp_path}/{purpose}")
    monkeypatch.setattr(entry, "_STORED", {})
    rows = staged(make)
    got = entry._stream_dedup(Warehouse.from_staging(rows))
    assert sorted(r["order_id"] for r in got.collect()) == [f"O{i}" for i in range(6)]
    assert os.listdir(tmp_path) == ["stream-dedup"]
    assert os.listdir(tmp_path / "stream-dedup") == ["data"]


def test_csv_files_go_when_they_are_loaded(spark, make, tmp_path, monkeypatch):
    """Compressed files of few records, in load order."""
    monkeypatch.setattr(entry, "_folder", lambda w, purpose: f"{tmp_path}/{purpose}")
    monkeypatch.setattr(entry, "_STORED", {})
    monkeypatch.setattr(entry, "CSV_RECORDS", 2)
    stored = []
    read = Warehouse.load_csv.__func__

    def load_csv(cls, spark, folder, path):
        stored.extend(f for f in os.listdir(folder) if f.startswith("part-"))
        return read(cls, spark, folder, path)

    monkeypatch.setattr(Warehouse, "load_csv", classmethod(load_csv))
    rows = staged(make)
    w = entry._csv_warehouse(Warehouse.from_staging(rows))
    assert len(stored) >= 8 and all(f.endswith(".csv.gz") for f in stored)
    assert os.listdir(tmp_path / "csv") == ["tables"]
    assert set(os.listdir(tmp_path / "csv/tables")) == {
        "staging", "customers", "products", "returns", "order_facts", "malformed"}
    assert w.malformed.count() == 3
    text = [F.regexp_replace(c, "\n", " ").alias(c) for c in ("return_reason", "payment_method")]
    kept = ["order_id", "total_amount", *text]
    changed = rows.select("order_id", "total_amount", "return_reason", F.regexp_replace(
        "payment_method", "URGENT", '"URGENT"').alias("payment_method"))
    assert sorted(w.staging.select(*kept).collect()) == sorted(changed.collect())
    first = load.orders_dedup(rows).select("order_id", "quantity")
    assert sorted(w.orders.select("order_id", "quantity").collect()) == sorted(first.collect())
