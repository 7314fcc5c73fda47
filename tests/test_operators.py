"""Hand-sized expectations of the market operators."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofold.functions.statistics import expected_best_sharpe, probabilistic_sharpe
from chronofold.operators import bars, corporate, labels, models, pit, structure
from chronofold.operators import market as market_ops
from chronofold.operators import portfolio as P
from chronofold.operators import relational as R


def day(k):
    return dt.date(2024, 1, 1) + dt.timedelta(days=k)


def test_checked_join_and_duplicates(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(1, 10)], "k int, w int")
    assert R.checked_join(a, b, ["k"]).count() == 3
    with pytest.raises(R.ContractError):
        R.checked_join(b, a, ["k"])
    with pytest.raises(R.ContractError):
        R.checked_join(a, b, ["k"], "inner1")
    assert [tuple(r) for r in R.duplicates(a, ["k"]).collect()] == [(1, 2)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 12)), max_size=12), st.lists(st.tuples(st.integers(0, 3), st.integers(0, 12)), max_size=12), st.booleans(), st.booleans())
def test_asof_join_against_loop(spark, left, right, exact, forward):
    a = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(left)], "k int, t int, i int")
    b = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(right)], "k int, u int, j int")
    got = {r.i: r.j for r in R.asof_join(a, b, "t", "u", ["j"], by=["k"], allow_exact=exact, forward=forward, tie=["j"]).collect()}
    for i, (k, t) in enumerate(left):
        fit = [(u, j) for j, (x, u) in enumerate(right) if x == k and (u == t and exact or (u > t if forward else u < t))]
        near = (min if forward else max)((u for u, _ in fit), default=None)
        want = max((j for u, j in fit if u == near), default=None)
        # Forward, rows of one time come in rising order of the tie, so the first stands.
        assert got[i] == want


def test_select_latest_ties_and_future(spark):
    rows = spark.createDataFrame([("a", day(0), None, 1.0), ("a", day(0), day(1), 2.0), ("a", day(9), day(9), 3.0), ("b", day(0), None, 4.0), ("b", day(0), None, 5.0)], "k string, available date, revision date, v double")
    at = F.lit(day(5))
    assert [r.v for r in pit.select_latest(rows.where("k = 'a'"), ["k"], "available", "revision", at).collect()] == [2.0]
    with pytest.raises(R.ContractError):
        pit.select_latest(rows, ["k"], "available", "revision", at)


def test_updates_carried_forward_equal_snapshots(spark):
    rows = spark.createDataFrame([("a", day(k), float(k)) for k in (0, 3, 4, 11)] + [("b", day(6), 60.0)], "k string, available date, v double")
    grid = spark.createDataFrame([(day(k),) for k in (1, 5, 7, 12)], "d date")
    order = [F.desc("available")]
    full = {(r.d, r.k): r.v for r in pit.snapshots(rows, grid, "d", ["k"], "available", order).collect()}
    steps = pit.state_updates(rows, grid, "d", ["k"], "available", order).select("k", F.col("d").alias("at"), F.col("v").alias("x"))
    keys = grid.crossJoin(rows.select("k").distinct())
    carried = {(r.d, r.k): r.x for r in R.asof_join(keys, steps, "d", "at", ["x"], by=["k"]).where("x is not null").collect()}
    assert carried == full


def test_fees():
    assert P.charge(Decimal(0), False) == 0 and P.charge(Decimal(10), False) == 1
    assert P.charge(Decimal(1_000_000), False) == 1425 and P.charge(Decimal(1_000_000), True) == 4425
    assert P.half_up(Decimal("2.5")) == 3 and P.way(0, -5, 1, 2) == -3 and P.way(0, 5, 1, 2) == 3


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 500), min_size=1), st.integers(0, 200_000))
def test_buys_never_overspend(wanted, cash):
    prices = {t: Decimal(10 + ord(t) % 7) for t in wanted}
    got = P.allocate_buys(wanted, prices, Decimal(cash))
    spent = sum((prices[t] * n + P.charge(prices[t] * n, False) for t, n in got.items() if n), Decimal(0))
    assert all(0 <= got[t] <= wanted[t] for t in wanted) and (spent <= cash or spent == 0)


def market(days, **over):
    out = []
    for k in range(days):
        for t in ("1101", "1102"):
            r = {"date": day(k), "month": day(0).replace(day=1), "k": k + 1, "n": days, "ticker": t, "close": 10.0, "adj_close": 10.0, "tradable": True, "delisted": False, "weight": 0.5 if k == 0 else np.nan}
            out.append(r | over.get(f"{t}_{k}", {}))
    return pd.DataFrame(out)


def ledger(days):
    return pd.DataFrame(list(P.simulate(days, Decimal(100_000))), columns=["date", "kind", "ticker", "shares", "price", "fee", "cash", "assets", "nav"])


def test_simulation_is_self_financing():
    out = ledger(market(4))
    daily = out[out.kind == "daily"].set_index("date")
    for d, row in daily.iterrows():
        held = out[(out.kind == "holding") & (out.date == d)]
        assert abs(row.assets - row.cash - (held.shares * held.price).sum()) < 1e-6 and row.cash >= 0
    paid = out[out.kind == "buy"].fee.sum()
    assert abs(daily.assets.iloc[-1] - (100_000 - paid)) < 1e-6


def test_halt_keeps_backlog_and_delisting_liquidates_once():
    halted = ledger(market(4, **{"1102_1": {"tradable": False}, "1102_2": {"tradable": False}}))
    buys = halted[(halted.kind == "buy") & (halted.ticker == "1102")]
    assert set(buys.date) == {day(0), day(3)} and buys.shares.sum() >= 4900
    gone = ledger(market(5, **{f"1101_{k}": {"delisted": True, "close": 0.0, "adj_close": 0.0, "tradable": False} for k in (3, 4)}))
    sold = gone[gone.kind == "delisting"]
    assert list(sold.date) == [day(3)] and list(sold.ticker) == ["1101"] and list(sold.price) == [10.0]


def test_split_changes_shares_not_value():
    out = ledger(market(4, **{f"1101_{k}": {"close": 5.0, "adj_close": 10.0} for k in (2, 3)}))
    daily = out[out.kind == "daily"]
    assert daily.assets.max() - daily.assets.min() < 300
    assert out[(out.kind == "holding") & (out.ticker == "1101") & (out.date == day(3))].shares.iloc[0] > 8_000


def test_fallback_threshold_only_when_few(spark):
    def audit(n):
        rows = [(day(0), str(1101 + k), day(-9), None, True, "steel", 10.0, "TRADING", 15.0 if k else 30.0, 20, 10_000.0, float(k), 1.0, float(k)) for k in range(n)]
        df = spark.createDataFrame(rows, "formation_date date, ticker string, list_date date, delist_date date, known boolean, main_industry string, close double, market_state string, sum20 double, n20 long, index_sum20 double, adv20 double, market_cap double, momentum_12_1 double")
        return P.candidate_audit(df, (P.Rule("m", "momentum_12_1"),)).collect()

    few = audit(4)
    assert {r.threshold for r in few} == {0.001} and all(r.selected for r in few) and abs(sum(r.weight for r in few) - 1) < 1e-12
    assert [r.ticker for r in sorted(few, key=lambda r: r["rank"])] == ["1104", "1103", "1102", "1101"]


def test_cash_dividend_of_all_the_price_is_no_step(spark):
    prices = spark.createDataFrame([(day(k), "1", 10.0, 1.0) for k in range(4)], "date date, ticker string, close double, volume double")
    actions = spark.createDataFrame([("1", day(1), 2.0, 1.0), ("1", day(2), 10.0, 1.0), ("1", day(3), 0.0, 2.0)], "ticker string, date date, cash double, factor double")
    got = [round(r.factor, 9) for r in corporate.adjustment_factors(prices, actions).orderBy("date").collect()]
    assert got == [1.0, 1.25, 1.25, 2.5]


def test_bars_fold_equals_loop_and_future_changes_nothing(spark):
    r = np.random.default_rng(0)
    n = 300
    rows = [("e%d" % e, day(k), float(r.integers(1, 50)), 100 + float(r.normal())) for e in range(3) for k in range(n)]
    df = spark.createDataFrame(rows, "etf_id string, date date, etf_amount double, nav double")
    whole = bars.assign_bars(df, 3.0)
    got = whole.orderBy("etf_id", "date").toPandas()
    for _, own in got.groupby("etf_id"):
        want = bars.close_bars(own.etf_amount.to_numpy(), own.threshold.astype(float).to_numpy())
        assert (own.bar.fillna(-1).to_numpy() == want).all() and want.max() > 20
        closed = [x[0] for x in bars.resume(own.etf_amount.to_numpy(), own.threshold.astype(float).to_numpy())]
        assert sum(closed) == want.max() + 1
    early = bars.bar_table(bars.assign_bars(df.where(F.col("date") < day(200)), 3.0)).select("etf_id", "bar", "end_date", "close").collect()
    late = {(x.etf_id, x.bar): x for x in bars.bar_table(whole).select("etf_id", "bar", "end_date", "close").collect()}
    assert early and all(late[x.etf_id, x.bar] == x for x in early)


def test_unresolved_tail_is_not_shortened(spark):
    b = spark.createDataFrame([("e", k, day(10 * k), 100.0, 0.01) for k in range(5)], "etf_id string, bar long, end_date date, close double, sigma double")
    path = spark.createDataFrame([("e", day(k), 100.0 + (5 if k == 12 else 0)) for k in range(41)], "etf_id string, date date, nav double")
    got = {x.bar: (x.reason, x.label, x.t1) for x in labels.triple_barrier(b, path, 2.0, 2).collect()}
    assert got[0] == ("upper", 1, day(12)) and got[1] == ("upper", 1, day(12)) and got[2] == ("vertical", 0, day(40)) and got[3] == ("unresolved_tail", None, None)


def test_folds_train_on_the_resolved_past_only(spark):
    e = spark.createDataFrame([("e", k, day(k), day(k + 3)) for k in range(40)], "etf_id string, bar long, t0 date, t1 date")
    rows = labels.purged_folds(e, 3).collect()
    for fold in (1, 2, 3):
        first = min(r.t0 for r in rows if r.fold == fold and r.part == "validation")
        assert all(r.t1 < first for r in rows if r.fold == fold and r.part == "train")


def test_evidence_is_not_trapped(spark):
    p = [0.0] * 50 + [0.6, 0.61] + [1.0] * 20 + [0.44, 0.45]
    df = spark.createDataFrame([("e", k, x) for k, x in enumerate(p)], "etf_id string, bar long, p double")
    rows = sorted(models.cusum_states(df, "etf_id", "bar", "p").collect(), key=lambda r: r.bar)
    assert [r.bar for r in rows if r.transition == "flat_to_long"] == [51 if 0.1 + 0.11 >= 0.2 else 52]
    assert rows[-1].transition == "long_to_flat"


def test_weights_of_allocation():
    cov = np.diag([0.04, 0.01, 0.01])
    w = models.hierarchical_weights(cov)
    assert abs(w.sum() - 1) < 1e-12 and w[0] < w[1]
    assert models.leaf_order(np.array([[0, 9, 1], [9, 0, 8], [1, 8, 0.0]])) == [1, 0, 2]


def test_sharpe_formulas():
    assert abs(probabilistic_sharpe(0.1, 0.0, 253, 0.0, 3.0) - 0.9428) < 2e-3
    assert expected_best_sharpe(1, 1.0) == 0 and 1.5 < expected_best_sharpe(10, 1.0) < 1.6


def test_fractional_weights_and_unit_roots():
    assert np.allclose(structure.ffd_weights(1.0), [1, -1]) and np.allclose(structure.ffd_weights(0.5, 0.05)[:3], [1, -0.5, -0.125])
    r = np.random.default_rng(1)
    walk, noise = r.normal(size=500).cumsum(), r.normal(size=500)
    assert structure.adf(walk)[1] > 0.05 > structure.adf(noise)[1]
    chosen = [x for x in structure.search_d(walk, tolerance=1e-3) if x[-1]]
    assert len(chosen) == 1 and 0 < chosen[0][0] <= 1


def test_start_statistics_equal_single_regressions():
    y = np.random.default_rng(2).normal(size=120).cumsum() + 50
    got = structure.start_statistics(y, 110, 60)
    for k, length in enumerate(range(60, len(got) + 60)):
        assert abs(got[k] - structure.adf(y[110 - length - 1 : 111], 1)[0]) < 1e-6
    later = np.append(y, 999.0)
    assert structure.structural_row(later, 110) == structure.structural_row(y, 110)


def test_outcomes_stay_out_of_decisions(spark):
    with pytest.raises(R.ContractError):
        models.forbid_outcomes(spark.createDataFrame([(1, 2)], "bar int, t1 int"))
    assert models.acceptance(True, [True, True], True, ["equal_capital", "inverse_vol", "hrp"], 0.97)["status"] == "PAPER_TRADE_ELIGIBLE"
    assert models.acceptance(True, [True, False], True, [], None)["missing"] == ["tier3_passed", "all_policies", "dsr", "dsr_at_least_0_95"]


def _nearest(rows, x, forward, exact):
    near = [r for r in rows if r[0] is not None and (r[0] == x and exact or (r[0] > x if forward else r[0] < x))]
    return (min if forward else max)(near, key=lambda r: (r[0], -r[1] if forward else r[1]), default=(None, None))[1]


@pytest.mark.parametrize("kind", ["date", "long"])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("exact", [False, True])
def test_asof_without_a_key_equals_brute_force(spark, kind, forward, exact):
    import random

    r = random.Random(5)
    at = (lambda k: day(k)) if kind == "date" else (lambda k: k)
    left = [(k, at(r.randrange(-50, 900)) if k % 11 else None) for k in range(200)]
    right = [(at(r.choice([*range(60), *range(400, 500)])), k) for k in range(90)] + [(None, 999)]
    a, b = spark.createDataFrame(left, f"id long, t {kind}"), spark.createDataFrame(right, f"u {kind}, v long")
    got = R.asof_join(a, b, "t", "u", ["v"], allow_exact=exact, forward=forward, tie=["v"])
    assert {x.id: x.v for x in got.collect()} == {k: None if t is None else _nearest(right, t, forward, exact) for k, t in left}
    assert R.asof_join(a, b.limit(0), "t", "u", ["v"]).where("v is null").count() == len(left)


@pytest.mark.parametrize("open_low", [False, True])
def test_interval_join_equals_brute_force(spark, open_low):
    import random

    r = random.Random(6)
    points = [("ab"[k % 2], day(r.randrange(400)) if k % 9 else None, k) for k in range(80)]
    spans = [("ab"[k % 2], day(s := r.randrange(400)), day(s + r.randrange(-3, 150)) if k % 7 else None, k) for k in range(60)]
    got = R.interval_join(spark.createDataFrame(points, "g string, at date, p long"), spark.createDataFrame(spans, "g string, s date, e date, q long"), ["g"], "at", "s", "e", open_low)
    assert "__b" not in got.columns
    want = sorted((p, q) for g, at, p in points for h, s, e, q in spans if g == h and at is not None and e is not None and (s < at if open_low else s <= at) and at <= e)
    assert sorted((x.p, x.q) for x in got.collect()) == want
    held = spark.createDataFrame([("a", day(50), day(60)), ("a", None, day(9)), ("b", day(0), day(400))], "g string, hs date, he date")
    left = R.without_overlap(spark.createDataFrame(spans, "g string, s date, e date, q long"), held, ["g"], ("s", "e"), ("hs", "he"))
    gone = {q for g, s, e, q in spans if e is not None and s <= e and (g == "b" and e >= day(0) and s <= day(400) or g == "a" and s <= day(60) and e >= day(50))}
    assert sorted(x.q for x in left.collect()) == sorted({x[3] for x in spans} - gone)


def test_buys_follow_the_position_and_the_share_of_value():
    prices = {"1": Decimal(10), "2": Decimal(10), "3": Decimal(100)}
    # Cash by value without fees is half of 1400: 20 and 20 of 40, 3 of 6; fees are 1 each, so shares go from ticker 3.
    got = P.allocate_buys({"1": 40, "2": 40, "3": 6}, prices, Decimal(700), {"1": 100}, {"1": 140, "2": 40, "3": 6})
    assert got["3"] == 2 and got["2"] > got["1"]
    assert sum(prices[t] * n + P.charge(prices[t] * n, False) for t, n in got.items()) <= 700
    assert P.allocate_buys({"1": 4}, prices, Decimal(41)) == {"1": 4} and P.allocate_buys({"1": 4}, prices, Decimal(40)) == {"1": 3}
    assert P.allocate_buys({"1": 4}, prices, Decimal(-5)) == {"1": 0}


def test_null_industries_and_list_dates_are_excluded(spark):
    base = {"formation_date": day(0), "ticker": "1101", "list_date": day(-900), "delist_date": None, "main_industry": "financial", "close": 10.0, "market_state": "TRADING", "sum20": 1.0, "n20": 20, "index_sum20": 10.0, "adv20": 1.0, "market_cap": 1.0}
    rows = [base, base | {"ticker": "1102", "main_industry": None}, base | {"ticker": "1103", "list_date": None}, base | {"ticker": "1104", "main_industry": "steel"}]
    names = {"formation_date": "date", "ticker": "string", "list_date": "date", "delist_date": "date", "main_industry": "string", "close": "double", "market_state": "string", "sum20": "double", "n20": "long", "index_sum20": "double", "adv20": "double", "market_cap": "double"}
    df = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ", ".join(f"{c} {t}" for c, t in names.items()))
    rules = (P.Rule("in", "adv20", include="financial"), P.Rule("out", "adv20", exclude="financial"))
    got = {(r.etf_id, r.ticker): r.reason for r in P.candidate_audit(df, rules).collect()}
    assert got == {("in", "1101"): None, ("in", "1102"): "industry_not_included", ("in", "1103"): "missing_master", ("in", "1104"): "industry_not_included", ("out", "1101"): "industry_excluded", ("out", "1102"): None, ("out", "1103"): "missing_master", ("out", "1104"): None}


def test_effective_dates_follow_the_own_market(spark):
    prices = spark.createDataFrame([(day(0), t, 1.0, 1.0, 1.0) for t in ("1", "2", "3", "4")], "date date, ticker string, close double, volume double, traded_value double")
    master = spark.createDataFrame([("1", "TWSE"), ("2", "TPEX"), ("3", " "), ("4", "ELSEWHERE")], "ticker string, market string").withColumns({"list_date": F.lit(day(-9)), "delist_date": F.lit(None).cast("date")})
    days = spark.createDataFrame([(day(0), "TWSE"), (day(3), "TWSE"), (day(0), "TPEX"), (day(4), "TPEX"), (day(2), "OTHER")], "date date, market string")
    got = {r.ticker: r.effective_date for r in market_ops.security_panel(prices, master, days).collect()}
    assert got == {"1": day(3), "2": day(4), "3": day(2), "4": None}
    without = {r.ticker: r.effective_date for r in market_ops.security_panel(prices, master, days.where("not (market = 'TWSE' and date = date'2024-01-01')")).collect()}
    assert without["1"] is None


def test_concurrency_counts_the_first_day(spark):
    events = spark.createDataFrame([("x", 1, day(0), day(2)), ("x", 2, day(2), day(3)), ("x", 3, day(9), None)], "etf_id string, bar long, t0 date, t1 date")
    sessions = spark.createDataFrame([("x", day(k)) for k in (0, 1, 2, 2, 3, 9)], "etf_id string, date date")
    got = {r.bar: (r.at_start, r.most, round(r.uniqueness, 6)) for r in labels.uniqueness(events, sessions).collect()}
    assert got == {1: (1, 2, round(2.5 / 3, 6)), 2: (2, 2, 0.75)}


def test_completion(spark):
    rows = [("a", 0, 100, 40), ("a", 50, 0, 50), ("b", 10, 10, 3), ("c", 0, 10, 90), ("d", None, 10, None), ("d", 30, None, 0)]
    got = P.completion(spark.createDataFrame(rows, "g string, start long, target long, actual long"), ["g"])
    assert {r.g: round(r.completion, 9) for r in got.collect()} == {"a": round(40 / 150, 9), "b": 1.0, "c": 0.0, "d": 0.75}
