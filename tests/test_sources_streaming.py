"""Artifact store and streaming operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import bars, models
from chronofold.operators.relational import ContractError
from chronofold.sources import artifacts as A
from chronofold.streaming import incremental as S


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


@pytest.fixture()
def store(spark, tmp_path):
    return A.Store(spark, f"file://{tmp_path}/store")


def frame(spark, rows):
    return spark.createDataFrame(rows, "date date, ticker string, close double, year int")


def test_full_replace_and_reads(spark, store):
    c = A.Contract("prices", ("date", "ticker"), ("close",), date="date")
    store.publish(c, frame(spark, [(day(k), t, float(k), 2024) for k in range(5) for t in "ab"]))
    got = store.read("prices", ["ticker", "close"], start="2024-01-02", end="2024-01-03", filters=[("ticker", "in", ["a"]), ("close", "<=", 1.0)])
    assert [tuple(r) for r in got.collect()] == [("a", 1.0)]
    assert store.read("prices", validate="full").count() == 10
    with pytest.raises(ContractError):
        store.read("prices", start="2023-12-31")
    with pytest.raises(ContractError):
        store.publish(c, frame(spark, [(day(0), "a", 1.0, 2024)] * 2))
    assert store.read("prices").count() == 10
    with pytest.raises(ContractError):
        store.read("none")
    with pytest.raises(ContractError):
        store.path("..", "x")


def test_upsert_snapshot_audit_archive(spark, store):
    c = A.Contract("daily", ("date", "ticker"), ("close",), date="date", mode="partition_upsert", partition="year")
    store.publish(c, frame(spark, [(day(0), "a", 1.0, 2024), (day(1), "a", 2.0, 2024), (day(-5), "a", 0.0, 2023)]))
    store.publish(c, frame(spark, [(day(1), "a", 9.0, 2024), (day(2), "a", 3.0, 2024)]))
    assert {(r.date, r.close) for r in store.read("daily").collect()} == {(day(-5), 0.0), (day(0), 1.0), (day(1), 9.0), (day(2), 3.0)}
    assert [tuple(r) for r in store.audit().collect()] == [("daily", 4, 0, True)]
    assert store.archive("daily", store.fingerprint("daily")) == 1
    assert store.read("daily").count() == 4
    with pytest.raises(ContractError):
        store.archive("daily", "other")
    s = A.Contract("panel", ("ticker",), ("close",), mode="snapshot_by_value", partition="date")
    with pytest.raises(ContractError):
        store.publish(s, frame(spark, [(day(0), "a", 1.0, 1), (day(1), "b", 1.0, 1)]))


def test_null_partitions_are_refused_and_values_kept(spark, store):
    c = A.Contract("daily", ("date", "ticker"), ("close",), date="date", mode="partition_upsert", partition="ticker")
    with pytest.raises(ContractError, match="without a ticker"):
        store.publish(c, frame(spark, [(day(0), "a", 1.0, 1), (day(1), None, 2.0, 1)]))
    assert store.manifest("daily") is None
    store.publish(c, frame(spark, [(day(0), "a/b=c", 1.0, 1), (day(0), "", 2.0, 1), (day(0), "é %", 3.0, 1)]).replace("", " "))
    assert set(store.manifest("daily")["partitions"]) == {"a/b=c", " ", "é %"}
    store.publish(c, frame(spark, [(day(0), "é %", 5.0, 1)]))
    assert {(r.ticker, r.close) for r in store.read("daily").collect()} == {("a/b=c", 1.0), (" ", 2.0), ("é %", 5.0)}


def test_keys_in_two_partitions_are_refused(spark, store):
    c = A.Contract("moved", ("date",), ("close",), mode="partition_upsert", partition="year")
    store.publish(c, frame(spark, [(day(0), "a", 1.0, 1), (day(1), "a", 1.0, 2)]))
    for rows in ([(day(0), "a", 1.0, 3)], [(day(0), "a", 1.0, 2)]):
        with pytest.raises(ContractError):
            store.publish(c, frame(spark, rows))
    assert store.read("moved").count() == 2 and store.history("moved") == [1]


def test_a_new_process_reads_by_date(spark, store):
    c = A.Contract("prices", ("date", "ticker"), ("close",), date="date")
    store.publish(c, frame(spark, [(day(k), "a", float(k), 2024) for k in range(5)]))
    assert A.Store(spark, store.root).read("prices", start="2024-01-04").count() == 2
    assert [tuple(r) for r in A.Store(spark, store.root).audit().collect()] == [("prices", 5, 0, True)]


def test_versions_roll_back_and_writers_collide(spark, store):
    c = A.Contract("prices", ("date",), ("close",), date="date")
    store.publish(c, frame(spark, [(day(0), "a", 1.0, 1)]), expected="")
    first = store.fingerprint("prices")
    store.publish(c, frame(spark, [(day(0), "a", 2.0, 1), (day(1), "a", 2.0, 1)]), expected=first)
    with pytest.raises(ContractError, match="meanwhile"):
        store.publish(c, frame(spark, [(day(0), "a", 3.0, 1)]), expected=first)
    real, store._listed = store._listed, lambda *p: [n for n in type(store)._listed(store, *p) if n != "00000002.json"]
    with pytest.raises(ContractError, match="meanwhile"):  # another writer took the number after this one looked
        store.publish(c, frame(spark, [(day(0), "a", 3.0, 1)]))
    store._listed = real
    assert store.read("prices").count() == 2 and store.history("prices") == [1, 2]
    assert store.rollback("prices", 1)["number"] == 3 and [r.close for r in store.read("prices").collect()] == [1.0]
    with pytest.raises(ContractError):
        store.rollback("prices", 9)
    store.archive("prices", store.fingerprint("prices"))
    with pytest.raises(ContractError, match="gone"):
        store.rollback("prices", 2)
    lost = A.Store(spark, store.root)
    parts = store.manifest("prices")["partitions"]
    m = lost.reconstruct(A.Contract("again", ("date",), ("close",), date="date"), parts)
    assert (m["rows"], m["date_range"]) == (1, ["2024-01-01", "2024-01-01"]) and lost.read("again", start="2024-01-01").count() == 1


def test_results_round_trip_with_digests(spark, store, tmp_path):
    tables = {"daily": frame(spark, [(day(k), "a", float(k), 1) for k in range(3)]), "trades": frame(spark, [(day(0), None, None, None)])}
    m = store.write_result("run1", tables)
    assert {n: t["rows"] for n, t in m["tables"].items()} == {"daily": 3, "trades": 1}
    got = store.read_result("run1")
    assert sorted(map(tuple, got["daily"].collect())) == sorted(map(tuple, tables["daily"].collect())) and got["trades"].first().close is None
    with pytest.raises(ContractError, match="already"):
        store.write_result("run1", tables)
    with pytest.raises(ContractError):
        store.read_result("run2")
    next((tmp_path / "store/results/run1/daily").glob("*.parquet")).unlink()
    with pytest.raises(ContractError, match="not those"):
        store.read_result("run1")


def test_trials(tmp_path):
    path = str(tmp_path / "trials.jsonl")
    one = {"trial_id": "a", "family": "f", "sharpe": 1.0, "note": ""}
    A.append_trial(path, one)
    for bad in (one, one | {"x": 1}):
        with pytest.raises(ContractError):
            A.append_trial(path, bad)


def run_stream(spark, folder, schema, transform, name):
    q = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"select * from {name}").collect()


def test_streaming_bars_and_states_equal_batch(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [("e%d" % e, day(k), float(r.integers(1, 50)), 100.0) for e in range(2) for k in range(160)]
    df = bars.assign_bars(spark.createDataFrame(rows, "etf_id string, date date, etf_amount double, nav double"), 3.0).select("etf_id", "date", "etf_amount", "threshold", "bar", "nav").persist()
    folder = str(tmp_path / "days")
    for k in range(0, 160, 40):
        df.drop("bar", "nav").where(F.col("date").between(day(k), day(k + 39))).coalesce(1).write.mode("append").parquet(folder)
    got = run_stream(spark, folder, "etf_id string, date date, etf_amount double, threshold double", S.streaming_bars, "bars_out")
    want = bars.bar_table(df).select("etf_id", "bar", "start_date", "end_date", "amount", "days").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
    p = spark.createDataFrame([("e%d" % e, k, float(r.random())) for e in range(2) for k in range(90)], "etf_id string, bar long, p double").persist()
    folder = str(tmp_path / "scores")
    for k in range(0, 90, 30):
        p.where(F.col("bar").between(k, k + 29)).coalesce(1).write.mode("append").parquet(folder)
    got = run_stream(spark, folder, "etf_id string, bar long, p double", S.streaming_cusum, "cusum_out")
    want = models.cusum_states(p, "etf_id", "bar", "p").collect()
    clean = lambda rows: sorted((r.etf_id, r.bar, round(r.score, 9), r.state, str(r.transition)) for r in rows)
    assert clean(got) == clean(want)


def test_windowed_counts_and_upserts(spark, tmp_path, store):
    sf = "/root/testdata/sf0.001"
    folder = str(tmp_path / "ev")
    spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "value").orderBy("ts").coalesce(1).write.parquet(folder)
    got = run_stream(spark, folder, "ts timestamp, event_type string, value double", S.windowed_counts, "win_out")
    assert got and all(r.n > 0 for r in got)
    c = A.Contract("ticks", ("date", "ticker"), ("close",), date="date", mode="partition_upsert", partition="year")
    src = str(tmp_path / "src")
    frame(spark, [(day(0), "a", 1.0, 2024), (day(1), "b", 2.0, 2024)]).write.parquet(src)
    q = S.upsert_batches(spark.readStream.schema("date date, ticker string, close double, year int").parquet(src), store, c, str(tmp_path / "ck"))
    q.awaitTermination()
    assert store.read("ticks").count() == 2
