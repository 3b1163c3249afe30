import datetime as dt

from pyspark.sql import functions as F

from backhaul.operators import load
from backhaul.streaming import chain, jobs


def put(df, folder, name):
    """One more file of the stream; file names keep arrival order."""
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def stream(spark, folder, schema):
    return jobs.read_files(spark, f"{folder}/*", schema, files_per_batch=1)


def test_dedup_keeps_the_first_row_in_load_order(spark, make, tmp_path):
    undated = make.staging(dict(order_id="D", order_date="no date", ingest_seq=7),
                           dict(order_id="E", order_date=None, ingest_seq=8))
    first = make.staging(dict(order_id="A", total_amount=1, ingest_seq=5),
                         dict(order_id="B", total_amount=2))
    later = make.staging(dict(order_id="A", total_amount=9, ingest_seq=1),
                         dict(order_id="C", order_date="20/12/2023", total_amount=3))
    for name, rows in zip("123", (undated, first, later)):
        put(rows, tmp_path / "in", name)
    out = jobs.run_to_parquet(
        jobs.dedup(stream(spark, tmp_path / "in", first.schema)), str(tmp_path / "out"))
    assert out.columns == first.columns
    rows = {r["order_id"]: int(r["total_amount"]) for r in out.collect()}
    assert rows == {"A": 9, "B": 2, "D": 10, "E": 10}  # December is still open


def test_dedup_of_an_order_with_two_dates(spark, make, tmp_path):
    """As in the batch load: one row per order id, the first in load order, whatever the dates."""
    rows = make.staging(dict(order_id="A", order_date="1/3/2023", total_amount=1, ingest_seq=2),
                        dict(order_id="A", order_date="5/5/2023", total_amount=2, ingest_seq=1),
                        dict(order_id="B", order_date="1/1/2023", total_amount=3, ingest_seq=1),
                        dict(order_id="B", order_date="1/2/2023", total_amount=4, ingest_seq=2))
    path = str(tmp_path / "in")
    jobs.store_arrivals(rows, load.parse_date("order_date"), path)
    job = jobs.dedup(jobs.read_files(spark, f"{path}/arrivals/*", rows.schema, 1))
    jobs.run_to_parquet(job, str(tmp_path / "out"))
    jobs.end_arrivals(spark, rows.schema, path, order_date="1/1/3000")
    got = jobs.run_to_parquet(job, str(tmp_path / "out"))
    expected = load.orders_dedup(rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert {r["order_id"]: int(r["total_amount"]) for r in got.collect()} == {"A": 2, "B": 3}


def test_the_end_brings_out_everything(spark, make, tmp_path):
    days = [dt.date(2022, 1, 1) + dt.timedelta(days=(i * 37) % 900) for i in range(200)]
    facts = make.facts(*[dict(order_date=str(d), returned=i % 3 == 0,
                              request_date=str(d + dt.timedelta(days=i % 120)))
                         for i, d in enumerate(days)])
    returns = facts.filter("returned").select("order_id", "request_date", "return_reason")
    a, b = str(tmp_path / "facts"), str(tmp_path / "returns")
    jobs.store_arrivals(facts, F.col("order_date"), a)
    jobs.store_arrivals(returns, F.col("request_date"), b)
    orders = jobs.read_files(spark, f"{a}/arrivals/*", facts.schema, 2)
    back = jobs.read_files(spark, f"{b}/arrivals/*", returns.schema, 2)
    kpi, joined = jobs.loss_kpi(orders), jobs.order_returns(orders, back)
    before = jobs.run_to_parquet(kpi, str(tmp_path / "kpi")).agg(F.sum("total_orders")).first()[0]
    jobs.run_to_parquet(joined, str(tmp_path / "joined"))
    jobs.end_arrivals(spark, facts.schema, a, order_date=jobs.END)
    jobs.end_arrivals(spark, returns.schema, b, request_date=jobs.END, order_id="the end")
    total = jobs.run_to_parquet(kpi, str(tmp_path / "kpi")).agg(
        F.sum("total_orders"), F.sum("returned_orders"), F.sum("total_revenue"),
        F.sum("return_loss")).first()
    assert before < 200 and tuple(total) == (200, 67, 2000, 670)
    rows = jobs.run_to_parquet(joined, str(tmp_path / "joined")).collect()
    assert len({r["order_id"] for r in rows}) == len(rows) == 200
    assert sum(r["returned"] for r in rows) == sum(i % 3 == 0 and i % 120 <= 90
                                                   for i in range(200))


def test_files_of_a_quarter_follow_its_size(spark, make, tmp_path):
    rows = spark.range(0, 40_000).select(
        F.col("id").cast("string").alias("order_id"),
        F.when(F.col("id") % 10 == 0, F.lit("2023-05-01")).otherwise("2023-01-01").cast("date")
        .alias("order_date"), F.sha2(F.col("id").cast("string"), 256).alias("filler"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        jobs.store_arrivals(rows, F.col("order_date"), str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = {q: len(list((tmp_path / "arrivals" / q).glob("*.parquet")))
             for q in ("2023-1", "2023-2")}
    assert files["2023-1"] > 2 * files["2023-2"]


def test_results_do_not_depend_on_the_batch_cut(spark, make, tmp_path):
    days = [dt.date(2022, 1, 1) + dt.timedelta(days=(i * 37) % 900) for i in range(300)]
    facts = make.facts(*[dict(order_date=str(d), returned=i % 3 == 0, category="AB"[i % 2],
                              request_date=str(d + dt.timedelta(days=i % 120)))
                         for i, d in enumerate(days)])
    returns = facts.filter("returned").select("order_id", "request_date", "return_reason")
    jobs.store_arrivals(facts.repartition(3), F.col("order_date"), str(tmp_path / "facts"))
    jobs.store_arrivals(returns.repartition(3), F.col("request_date"), str(tmp_path / "returns"))
    results = []
    for cut in (None, 1, 3):
        def source(name, schema, cut=cut):
            return jobs.read_files(spark, str(tmp_path / name / "arrivals/*"), schema, cut)

        orders, back = source("facts", facts.schema), source("returns", returns.schema)
        out = str(tmp_path / f"out-{cut}")
        results.append([sorted(map(str, rows.collect())) for rows in (
            jobs.run_to_parquet(jobs.loss_kpi(orders), f"{out}/kpi"),
            jobs.run_to_parquet(jobs.order_returns(orders, back), f"{out}/returns"),
            jobs.run_to_parquet(jobs.category_spikes(orders), f"{out}/spikes"))])
    assert results[0] == results[1] == results[2] and all(results[0])


def test_late_rows_are_an_error(spark, make, tmp_path):
    import pytest

    put(make.facts(dict(order_date="2023-01-02"), dict(order_date="2023-12-30")),
        tmp_path / "in", "1")
    put(make.facts(dict(order_date="2023-12-31")), tmp_path / "in", "2")
    late = make.facts(dict(order_id="late", order_date="2023-01-04"))
    put(late, tmp_path / "in", "3")
    kpi = jobs.loss_kpi(stream(spark, tmp_path / "in", late.schema))
    with pytest.raises(jobs.LateRows, match="1 rows"):
        jobs.run_to_parquet(kpi, str(tmp_path / "out"))


def test_the_session_keeps_its_state_store(spark, make, tmp_path):
    before = spark.conf.get(jobs.STATE_STORE, None), spark.conf.get(jobs.PROGRESS_KEPT, None)
    put(make.facts(dict(order_date="2023-01-02")), tmp_path / "in", "1")
    jobs.run_to_parquet(jobs.loss_kpi(stream(spark, tmp_path / "in", make.facts(
        dict(order_date="2023-01-02")).schema)), str(tmp_path / "out"))
    assert before == (spark.conf.get(jobs.STATE_STORE, None),
                      spark.conf.get(jobs.PROGRESS_KEPT, None))


def test_loss_kpi_emits_finished_windows_and_drops_late_rows(spark, make, tmp_path):
    def day(d, **more):
        return dict(order_id=f"{d}{more}", order_date=d, **more)
    january = make.facts(day("2023-01-02", returned=True, total_amount=30),
                         day("2023-01-03"), day("2023-03-30"))
    late = make.facts(day("2023-01-04"), day("2023-06-01"))
    put(january, tmp_path / "in", "1")
    out = str(tmp_path / "out")
    def run():
        kpi = jobs.loss_kpi(stream(spark, tmp_path / "in", january.schema), delay="7 days")
        return jobs.run_to_parquet(kpi, out, allow_late=True)
    run()
    put(late, tmp_path / "in", "2")
    rows = {r["window_start"]: r for r in run().collect()}
    start = dt.datetime(2022, 12, 24)  # 30-day windows count from 1970-01-01
    assert rows[start]["total_orders"] == 2 and rows[start]["return_rate"] == 0.5
    assert float(rows[start]["net_revenue"]) == 10
    assert sum(r["total_orders"] for r in rows.values()) == 3  # June's window is still open


def test_order_returns_within_limit(spark, make, tmp_path):
    orders = make.orders(dict(order_id="back", order_date="2023-01-01"),
                         dict(order_id="too late", order_date="2023-01-01"),
                         dict(order_id="kept", order_date="2023-01-01"),
                         dict(order_id="open", order_date="2023-12-01"))
    returns = make.returns(dict(order_id="back", request_date="2023-04-01"),
                           dict(order_id="too late", request_date="2023-04-02"),
                           dict(order_id="other", request_date="2023-12-01"))
    put(orders, tmp_path / "orders", "1")
    put(returns, tmp_path / "returns", "1")
    joined = jobs.order_returns(stream(spark, tmp_path / "orders", orders.schema),
                                stream(spark, tmp_path / "returns", returns.schema),
                                delay="12 hours")
    rows = {r["order_id"]: r["returned"]
            for r in jobs.run_to_parquet(joined, str(tmp_path / "out")).collect()}
    assert rows == {"back": True, "too late": False, "kept": False}


def test_category_spike(spark, make, tmp_path):
    def window(month, returned, n=10):
        return [dict(order_id=f"{month}-{i}", order_date=f"2023-{month:02d}-15",
                     returned=i < returned) for i in range(n)]
    first = make.facts(*window(1, 2), *window(2, 3), *window(3, 2))
    second = make.facts(*window(4, 5), *window(5, 2), *window(9, 0, 1))
    put(first, tmp_path / "in", "1")
    put(second, tmp_path / "in", "2")
    out = str(tmp_path / "out")
    scored = jobs.run_to_parquet(jobs.category_spikes(
        stream(spark, tmp_path / "in", first.schema), delay="7 days"), out)
    alerts = {r["window_start"].month: r for r in
              scored.withColumn("window_start", F.date_add("window_start", 15)).collect()}
    spikes = [r["window_end"] for r in alerts.values() if r["spike"]]
    assert len(alerts) == 5 and len(spikes) == 1
    april = next(r for r in alerts.values() if r["spike"])
    assert april["return_rate"] == 0.5 and april["baseline_rate"] == 0.2333
    assert min(alerts.values(), key=lambda r: r["window_end"])["baseline_rate"] is None


def test_category_spikes_after_a_restart(spark, make, tmp_path):
    """Stopped after each file and started again from the checkpoint: the same windows."""
    days = [dt.date(2022, 1, 3) + dt.timedelta(days=i * 3) for i in range(250)]
    rows = [dict(order_id=f"O{i}", order_date=str(d), returned=i % (3 + i // 100) == 0,
                 product_id=f"P{i % 3}", category="XYZ"[i % 3]) for i, d in enumerate(days)]
    parts = [make.facts(*rows[i:i + 50]) for i in range(0, 250, 50)]
    for i, part in enumerate(parts):
        put(part, tmp_path / "once", str(i))
        put(part, tmp_path / "again", str(i))
        again = jobs.run_to_parquet(jobs.category_spikes(
            stream(spark, tmp_path / "again", part.schema)), str(tmp_path / "out-again"))
    once = jobs.run_to_parquet(jobs.category_spikes(
        stream(spark, tmp_path / "once", parts[0].schema)), str(tmp_path / "out-once"))
    got = sorted(map(str, again.collect()))
    assert got == sorted(map(str, once.collect())) and len(got) > 40
    assert again.filter("baseline_rate IS NULL").count() == 3 and again.filter("spike").count()


def test_chain_of_raw_rows_equals_the_batch_for_any_cut(spark, make, tmp_path):
    def text(day):
        return f"{day.day}/{day.month}/{day.year}"

    rows, day = [], dt.date(2022, 1, 1)
    for i in range(150):
        day = dt.date(2022, 1, 1) + dt.timedelta(days=(i * 37) % 900)
        asked = day + dt.timedelta(days=(i * 7) % 130 - 10)
        row = dict(order_id=f"O{i}", order_date=text(day), total_amount=i,
                   returned="Yes" if i % 3 == 0 else "No", request_date=text(asked))
        rows.append({**row, "ingest_seq": 2 * i})
        if i % 4 == 0:
            # a copy with other dates and another amount, loaded before or after
            rows.append({**row, "order_date": text(day + dt.timedelta(days=i % 60)),
                         "request_date": text(asked - dt.timedelta(days=i % 50)),
                         "total_amount": 1000 + i, "returned": "Yes" if i % 8 else "No",
                         "ingest_seq": 2 * i + (1 if i % 12 else -1)})
    rows.append(dict(order_id="undated", order_date="soon", ingest_seq=9999))
    staging = make.staging(*rows)
    returned = staging.filter("returned = 'Yes'")
    orders, returns = load.orders_clean(staging), load.returns_clean(staging)
    limit = ((F.col("request_date") >= F.col("order_date"))
             & (F.col("request_date") <= F.date_add("order_date", 90)))
    batch = (orders.join(returns.withColumnRenamed("order_id", "r"),
                         (F.col("order_id") == F.col("r")) & limit, "left")
             .filter("order_date IS NOT NULL")
             .withColumn("window_start",
                         F.window(F.col("order_date").cast("timestamp"), "30 days")["start"])
             .groupBy("window_start")
             .agg(F.count("order_id"), F.count("r"), F.sum("total_amount"),
                  F.coalesce(F.sum(F.when(F.col("r").isNotNull(), F.col("total_amount"))),
                             F.lit(0))))
    expected = sorted(tuple(map(str, r)) for r in batch.collect())
    for cut in (1, 3, None):
        a, b = str(tmp_path / f"orders-{cut}"), str(tmp_path / f"returns-{cut}")
        jobs.store_arrivals(staging, load.parse_date("order_date"), a)
        jobs.store_arrivals(returned, load.parse_date("request_date"), b)
        job = chain.loss_increments(*[jobs.read_files(spark, f"{x}/arrivals/*", staging.schema, cut)
                                      for x in (a, b)])
        out = str(tmp_path / f"out-{cut}")
        jobs.run_to_parquet(job, out)
        jobs.end_arrivals(spark, staging.schema, a, order_date="1/1/3000", order_id="end")
        jobs.end_arrivals(spark, staging.schema, b, request_date="1/1/3000", order_id="end",
                          returned="Yes")
        got = chain.merged(jobs.run_to_parquet(job, out)).select(
            "window_start", "total_orders", "returned_orders", "total_revenue", "return_loss")
        assert [tuple(r) for r in sorted(tuple(map(str, r)) for r in got.collect())] == [
            (w, n, k, str(g), str(x)) for w, n, k, g, x in expected]


def test_state_partitions_follow_the_stored_bytes(spark, make, tmp_path, monkeypatch):
    """200 partitions of the session are 200 stores to commit in each batch of a tiny stream."""
    facts = make.facts(*[dict(order_id=f"O{i}", order_date=f"2023-0{1 + i % 6}-02")
                         for i in range(30)])
    jobs.store_arrivals(facts, F.col("order_date"), str(tmp_path))
    old = spark.conf.get(jobs.PARTITIONS)
    spark.conf.set(jobs.PARTITIONS, "200")
    try:
        few = jobs.state_partitions(spark, str(tmp_path))
        kpi = jobs.loss_kpi(jobs.read_files(spark, f"{tmp_path}/arrivals/*", facts.schema))
        jobs.run_to_parquet(kpi, str(tmp_path / "out"), partitions=few)
        assert spark.conf.get(jobs.PARTITIONS) == "200"
        monkeypatch.setattr(jobs, "BYTES_PER_PARTITION", 10)
        many = jobs.state_partitions(spark, str(tmp_path))
    finally:
        spark.conf.set(jobs.PARTITIONS, old)
    stores = [p for p in (tmp_path / "out/checkpoint/state/0").iterdir() if p.name.isdigit()]
    assert few == len(stores) == spark.sparkContext.defaultParallelism and many > 200
