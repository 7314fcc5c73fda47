"""Queries over every row of their tables."""

import datetime

from test_queries import SF, rows

from chronofold.operators import corporate
from chronofold.plans.registry import QUERIES
from chronofold.plans.views import Views


def test_prepend_keeps_series_without_new_bars(spark):
    small = SF.replace("sf0.01", "sf0.001")
    bars = Views(spark, small).bar
    assert bars.groupBy("etf_id").max("bar").where("`max(bar)` < 30").count() > 0
    assert rows(QUERIES["u05_prepend_earlier"](spark, small).select("etf_id", "bar").toPandas()) == rows(bars.select("etf_id", "bar").toPandas())


def test_last_quarter_of_a_row_wins(spark):
    names = "ticker string, row_no long, " + ", ".join(f"q{k}_date date, q{k}_cash double" for k in range(1, 5)) + ", stock_date date, stock_value double"
    d = datetime.date(2020, 1, 2)
    wide = spark.createDataFrame([("1", 7, d, 1.0, d, 2.0, d, 3.0, None, None, d, 1.0), ("1", 6, d, 9.0, None, None, None, None, d, 9.0, None, None)], names)
    assert {(r.kind, r.cash, r.ratio) for r in corporate.dividend_events(wide).collect()} == {("cash", 3.0, 0.0), ("stock", 0.0, 0.1)}


def test_resumed_factors_are_those_of_a_whole_run(spark):
    whole = QUERIES["q04_adjusted_prices"](spark, SF).where("date >= date'2000-01-03'").toPandas()
    got = QUERIES["q05_resumed_factors"](spark, SF).toPandas().merge(whole, on=["date", "ticker"], suffixes=("", "_whole"))
    assert len(got) == len(whole) and got.factor.nunique() > 100
    assert ((got.factor - got.factor_whole).abs() <= 1e-6 + 1e-9 * got.factor_whole).all()


def test_resume_moves_actions_between_the_rows(spark):
    day = datetime.date
    prices = spark.createDataFrame([(day(2020, 1, k), "1", 10.0, 1.0) for k in (2, 6, 9)], "date date, ticker string, close double, volume double")
    actions = spark.createDataFrame([("1", day(2020, 1, k), 1.0, 2.0) for k in (1, 4, 9)], "ticker string, date date, cash double, factor double")
    whole = corporate.adjustment_factors(prices, actions).where("date > date'2020-01-02'")
    seeds = spark.createDataFrame([("1", 2.0, 10.0, day(2020, 1, 2))], "ticker string, factor double, close double, date date")
    got = corporate.resume_factors(prices.where("date > date'2020-01-02'"), actions, seeds)
    assert [round(r.factor, 9) for r in got.orderBy("date").collect()] == [round(r.factor, 9) for r in whole.orderBy("date").collect()]
