"""Features and validators on hand-sized tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronofold.operators import features, validators
from chronofold.operators.relational import ContractError


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_trend_is_the_least_squares_line(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=40)
    values[2] = np.nan
    rows = table(spark, [("a", k, None if np.isnan(x) else float(x)) for k, x in enumerate(values)] + [("flat", k, 1.0) for k in range(25)], "etf_id string, bar long, x double")
    got = features.trend(rows, "x", n=20).orderBy("bar").toPandas()
    own = got[got.etf_id == "a"].reset_index(drop=True)
    for k in range(40):
        y = values[max(0, k - 19) : k + 1]
        if len(y) < 20 or np.isnan(y).any():
            assert pd.isna(own.slope[k]) and pd.isna(own.t[k])
            continue
        x = np.arange(20.0)
        slope, cut = np.polyfit(x, y, 1)
        error = np.sqrt(((y - slope * x - cut) ** 2).sum() / 18 / ((x - x.mean()) ** 2).sum())
        assert own.slope[k] == pytest.approx(slope) and own.t[k] == pytest.approx(slope / error)
    assert got[got.etf_id == "flat"].slope.isna().all()


def test_observations_age_by_sessions(spark):
    calendar = table(spark, [(day(7 * k), k) for k in range(6)], "date date, session_idx long")
    seen = table(spark, [(day(7), 1.0), (day(30), 5.0), (None, 9.0)], "date date, value double")
    rows = table(spark, [(1, day(0)), (2, day(9)), (3, day(16)), (4, day(21)), (5, day(29)), (6, day(33)), (6, day(33)), (7, None)], "k int, end_date date")
    got = features.aligned(rows, "end_date", seen, ["value"], calendar).orderBy("k").collect()
    assert [(r.k, r.age, r.value, r.reason) for r in got] == [
        (1, None, None, "missing"), (2, 0, 1.0, None), (3, 1, 1.0, None), (4, 2, None, "stale"), (5, 3, None, "stale"),
        (6, 0, 5.0, None), (6, 0, 5.0, None), (7, None, None, "missing"),
    ]


def test_index_total_needs_every_session(spark):
    calendar = table(spark, [(day(k), k) for k in range(25)], "date date, session_idx long")
    index = table(spark, [(day(k), float(k)) for k in range(25)], "date date, traded_value double")
    ask = lambda k: table(spark, [(day(k),)], "formation_date date")
    assert features.index_total(index, calendar, ask(24)).first().total == sum(range(5, 25))
    holes = (index.where(f"date <> date'{day(12)}'"), index.withColumn("traded_value", F.when(F.col("date") == day(12), -1.0).otherwise(F.col("traded_value"))), index.withColumn("traded_value", F.lit(0.0)))
    for broken, k in [(index, 18), (index, 99), *((x, 24) for x in holes)]:
        with pytest.raises(Exception, match="no complete window"):
            features.index_total(broken, calendar, ask(k)).collect()


def test_changes_of_a_month_count_the_earlier_names(spark):
    held = [(day(10), "x", "old", 1.0), (day(30), "x", "a", 0.5), (day(30), "x", "b", 0.5), (day(100), "x", "a", 0.2), (day(100), "x", "c", 0.4), (day(100), "x", "d", 0.4)]
    got = features.monthly_changes(table(spark, held, "date date, etf_id string, ticker string, w double")).orderBy("month").collect()
    assert [(r.month, r.replaced, r.turnover and round(r.turnover, 9)) for r in got] == [(day(0), None, None), (dt.date(2024, 4, 1), 0.5, 0.8)]


def test_baseline_takes_positive_and_finite_amounts(spark):
    amounts = [5.0, 0.0, -3.0, float("inf"), float("nan"), None, 7.0, 9.0]
    rows = table(spark, [("s", k, x) for k, x in enumerate(amounts)], "ticker string, date int, v double")
    got = features.lagged_baseline(rows, "v", ("ticker", "date"), n=7, least=2).orderBy("date").collect()
    assert [r.baseline for r in got] == [None] * 7 + [6.0] and "_sound" not in got[0].asDict()


def test_all_bar_features_take_one_shuffle(spark):
    schema = "etf_id string, bar long, high double, low double, close double, amount double, days long, extra string"
    rows = table(spark, [("a", k, 2.0 + k, 1.0, 1.5 + k % 3, 10.0 + k, 3, "e") for k in range(70)] + [("n", 0, None, None, None, None, None, None)], schema)
    found = features.bar_features(rows)
    assert found.count() == 71 and found.where("etf_id = 'n' and mean is null and spread is null and extra is null").count() == 1
    executed = found._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 1
    assert features.bar_features(rows.limit(0)).count() == 0
    assert found.where("bar = 69 and (level60 is null or kurt is null or downside is null or drawdown is null or amihud_mean is null)").count() == 0


def test_performance_of_a_flat_curve(spark):
    curve = table(spark, [("f", day(k), 1.0) for k in range(4)] + [("g", day(k), x) for k, x in enumerate((1.0, 2.0, 1.0))], "etf_id string, date date, nav double")
    got = {r.etf_id: r for r in features.performance(curve).collect()}
    assert (got["f"].max_drawdown, got["f"].sharpe, got["f"].vol) == (0.0, None, 0.0) and got["g"].max_drawdown == -0.5


def counts(found):
    return {r.check: r.violations for r in found.collect()}


def test_state_violations(spark):
    schema = "date date, ticker string, market_state string, amount_state string, tradable boolean, close double, amount double"
    fine = [(day(1), "1", "TRADING", "OBSERVED", True, 5.0, 9.0), (day(2), "1", "HALTED", "ZERO_AUTHORIZED", False, None, 0.0), (day(3), "1", "MISSING", "MISSING", None, None, None)]
    master = table(spark, [("1", day(0), day(9))], "ticker string, list_date date, delist_date date")
    assert set(counts(validators.state_violations(table(spark, fine, schema), master)).values()) == {0}
    bad = [fine[0], (day(9), "1", "MISSING", "OBSERVED", False, None, -1.0), (day(4), "2", "TRADING", None, None, 0.0, None), (day(4), None, None, None, None, None, None)]
    got = validators.state_violations(table(spark, [*fine, *bad], schema), master)
    assert counts(got) == {"repeated_key": 1, "state_pair": 3, "tradable": 2, "amount": 3, "price": 2, "lifecycle": 3}
    with pytest.raises(ContractError, match="amount: 3"):
        validators.require_none(got)
    assert set(counts(validators.state_violations(table(spark, [], schema), master)).values()) == {0}


def test_bar_violations(spark):
    bars = table(spark, [("a", 0, day(0), day(3)), ("a", 1, day(4), day(6)), ("a", 3, day(6), day(5)), ("a", 3, day(6), day(5))], "etf_id string, bar long, start_date date, end_date date")
    marks = table(spark, [("a", 0, day(3), day(9)), ("a", 0, day(3), day(9)), ("a", 1, day(5), day(4)), ("b", 0, day(1), None)], "etf_id string, bar long, t0 date, t1 date")
    assert counts(validators.bar_violations(bars, marks)) == {
        "repeated_bar": 1, "gap": 2, "overlap": 1, "bar_order": 2, "repeated_label": 1, "label_without_bar": 1, "bar_without_label": 1, "label_start": 1, "label_order": 1,
    }
    validators.require_none(validators.bar_violations(bars.limit(0), marks.limit(0)))


def test_coverage_and_gates(spark):
    rows = table(spark, [(0, 1.0, None), (0, None, None), (1, None, 2.0)], "fold int, x double, y double")
    cover = validators.feature_coverage(rows, "fold", ["x", "y"])
    assert {(r.fold, r.feature, r.n, r.known) for r in cover.collect()} == {(0, "x", 2, 1), (0, "y", 2, 0), (1, "x", 1, 0), (1, "y", 1, 1)}
    with pytest.raises(ContractError, match="y in fold 0; x in fold 1"):
        validators.require_coverage(cover)
    scored = table(spark, [("a", 0.9, 1), ("a", 0.8, 0), ("a", 0.1, 1), ("a", 0.2, None), ("a", None, 1), ("b", 0.9, 1)], "etf_id string, p double, y int")
    got = {r.etf_id: r for r in validators.gate_metrics(scored, "p", F.col("y") > 0, least=1).collect()}
    assert (got["a"].n, got["a"].precision, got["a"].recall, got["a"].status) == (3, 0.5, 0.5, "ok")
    assert round(got["a"].accuracy, 9) == 0.333333333 and got["b"].status == "one_sided"
