"""Extraction profiles, identities, cutoffs, families and local time."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from chronofold.functions import temporal as T
from chronofold.operators.relational import ContractError
from chronofold.sources import extraction as E


def test_profiles(spark):
    rows = spark.createDataFrame([(1, "2024-01-05", "2024-02-01"), (2, "2024-03-01", "2024-01-10"), (3, None, None), (4, "2023-01-01", "2023-01-01")], "k int, mdate string, annd string")
    ids = lambda f, *a, **b: {r.k for r in E.extract(rows, f, *a, **b).collect()}
    small, medium, large = (E.Family("f", p, ("mdate",), ("annd",), table="t") for p in E.PROFILES)
    assert ids(small, "2024-01-01", "2024-01-31") == {1, 2, 3, 4}
    assert ids(medium, "2024-01-01", "2024-01-31") == {1, 2} and ids(medium) == {1, 2, 3, 4} and ids(medium, "2024-02-01") == {1, 2}
    assert ids(large, "2024-01-01", "2024-01-31") == {1} and ids(large, full_history=True) == {1, 2, 3, 4} and ids(large, "2024-02-01", full_history=True) == {1, 2, 3, 4}
    with pytest.raises(ContractError):
        E.extract(rows, large, "2024-01-01")
    with pytest.raises(ContractError):
        E.Family("f", "huge", table="t")


def test_tables():
    f = E.Family("f", "small_snapshot", pattern="db.{ticker}.x")
    assert E.tables_of(f, ["db.2.x", "db.1.x", "db.1.2.x", "dbs1.x", "db..x"]) == ["db.1.x", "db.2.x"]
    assert E.tables_of(E.Family("f", "small_snapshot", pattern="p_{ticker}", tickers=("9", "1")), []) == ["p_9", "p_1"]
    with pytest.raises(ContractError):
        E.tables_of(f, ["other"])


def test_identities(spark):
    rows = spark.createDataFrame([("b", 1, "x1", 2.5), (None, 1, "x2", None), (None, 1, None, None)], "k string, j int, _id string, v double")
    got = [r.source_row_id for r in E.identified(rows, "t", ["k", "j"], "_id").orderBy(F.desc("k"), F.desc("source_row_id")).collect()]
    sha = lambda o: hashlib.sha256(json.dumps(o, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert set(got) == {"t:pk-sha256:" + sha({"j": 1, "k": "b"}), "t:x2", "t:sha256:" + sha({"k": None, "j": 1, "v": None})}


def test_cutoffs(spark):
    values = [None, "", "2024-01-02", "1970-01-01T00:00:00Z", "1970-01-01 00:00:00", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "not T a time"]
    df = spark.createDataFrame(list(enumerate(values)), "k int, data_cutoff_at string")
    done = "2025-05-05T05:05:05Z"
    assert [r.data_cutoff_at for r in E.with_cutoff(df, done).orderBy("k").collect()] == [done] * 5 + values[5:7] + [done]
    assert E.with_cutoff(df.select("k"), done).where(F.col("data_cutoff_origin").isNull()).count() == 0


def test_families(spark):
    days = E.normalize(spark.createDataFrame([("2024-01-02T00:00:00", " ", None), ("2024-01-03", "TPEX", "holiday")], "zdate string, mkt string, date_rmk string"), "trading_calendar")
    assert [(r.date, r.market, r.is_trading_day) for r in days.orderBy("date").collect()] == [(dt.date(2024, 1, 2), "TWSE", True), (dt.date(2024, 1, 3), "TPEX", False)]
    sales = E.normalize(spark.createDataFrame([(" 1101 ", "2024-01-31", "2024-02-10", 5.0)], "coid string, mdate string, annd_s string, r18 double"), "monthly_sales").first()
    assert (sales.ticker, sales.source_available_date, sales.r18) == ("1101", dt.date(2024, 2, 10), 5.0)
    panel = E.normalize(spark.createDataFrame([(None, "7", "2024-01-02", 1.0)], "coid string, ticker string, mdate string, close double"), "daily_panel").first()
    assert (panel.ticker, panel.close) == ("7", 1.0)
    with pytest.raises(ContractError, match="ticker"):
        E.normalize(spark.createDataFrame([(None, " ", "2024-01-02")], "coid string, ticker string, mdate string"), "daily_panel")
    raw = [("1", "a", "Q", "T", "Y", "2023-12-31", "2024-01-05", f"2024-03-01T0{h}:00:00", float(h)) for h in (1, 5, 5)] + [("1", "a", "Q", "T", "Y", "2023-12-31", "2024-01-05", "2024-03-02", 9.0)]
    got = E.normalize(spark.createDataFrame(raw, "coid string, no string, sem string, curr string, merg string, endd string, mdate string, key3 string, v double"), "financial_statement")
    assert sorted(r.v for r in got.collect()) == [5.0, 5.0, 9.0] and got.where("period_start_date is null").count() == 3
    own = E.normalize(spark.createDataFrame([("1", "k", "Q", "T", "Y", "2023-12-31", "2024-02-01")], "coid string, key3 string, sem string, curr string, merg string, mdate string, annd string"), "self_reported_numbers").first()
    assert (own.period_end_date, own.source_available_date) == (dt.date(2023, 12, 31), dt.date(2024, 2, 1))
    assert E.normalize(spark.createDataFrame([("2024-01-02", None)], "mdate string, ticker string"), "generic_mdate").first().ticker is None
    assert E.normalize(spark.createDataFrame([("2024-01-02", "")], "`日期` string, symbol string"), "futures_near_month").first().contract == "TX_1"
    assert E.normalize(spark.createDataFrame([], "mdate string, ticker string"), "generic_mdate").count() == 0


def test_catalogs():
    good = [{"family_id": "a", "profile": "small_snapshot", "table": "t"}]
    E.check_catalog(good, ["a"], ["adjusted_close"])
    for bad, ids in ((good * 2, ["a"]), (good, ["a", "b"]), ([good[0] | {"profile": "x"}], ["a"]), ([good[0] | {"table": "adjusted_close"}], ["a"])):
        with pytest.raises(ContractError):
            E.check_catalog(bad, ids, ["adjusted_close"])


def test_local_time(spark):
    row = spark.range(1).select(*[f(F.lit("2024-03-05").cast("date")).cast("string").alias(n) for n, f in (("e", T.end_of_day), ("c", T.cutoff))], T.local_day(F.lit("2024-03-05 16:00:00").cast("timestamp")).alias("d"),
        T.known_by(F.lit("2024-03-05 10:00:00").cast("timestamp"), F.lit("2024-03-05").cast("date")).alias("k"), T.known_by(F.lit("2024-03-05 10:00:01").cast("timestamp"), F.lit("2024-03-05").cast("date")).alias("l"), T.known_by(F.lit(None).cast("timestamp"), F.lit("2024-03-05").cast("date")).alias("n")).first()
    assert (row.e, row.c, row.d) == ("2024-03-05 15:59:59.999999", "2024-03-05 10:00:00", dt.date(2024, 3, 6)) and (row.k, row.l, row.n) == (True, False, False)
