"""Trailing-window signals and features over the market views.

Windows count sessions of the calendar (missing rows are nulls) for prices and bars for bars; a window without its full number
of observations gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators import features
from chronofold.operators.signals import full, trailing

from .catalog import query
from .views import Views, number

DENSE = "PARTITION BY ticker ORDER BY date"
BARS = "PARTITION BY etf_id ORDER BY bar"
SERIES = ("ticker", "date")


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


@query("w01_adv20_sum20_turnover20", f"""SELECT date, ticker, CASE WHEN count(traded_value) OVER w = 20 THEN round(avg(traded_value) OVER w, 4) END AS adv20, CASE WHEN count(traded_value) OVER w = 20 THEN round(sum(traded_value) OVER w, 2) END AS sum20,
  CASE WHEN count(turnover) OVER w = 20 THEN round(avg(turnover) OVER w, 9) END AS turnover20 FROM fx_dense WINDOW w AS ({DENSE} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def w01(v: Views) -> DataFrame:
    w = trailing("ticker", "date", 20)
    return v.dense.select("date", "ticker", r(full(F.avg, "traded_value", w, 20), 4).alias("adv20"), r(full(F.sum, "traded_value", w, 20), 2).alias("sum20"), r(full(F.avg, "turnover", w, 20), 9).alias("turnover20"))


@query("w02_volume_ratio", f"""SELECT date, ticker, CASE WHEN count(volume) OVER a = 20 AND count(volume) OVER b = 60 AND avg(volume) OVER b > 0 THEN round(avg(volume) OVER a / avg(volume) OVER b, 9) END AS volume_ratio FROM fx_dense
  WINDOW a AS ({DENSE} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS ({DENSE} ROWS BETWEEN 79 PRECEDING AND 20 PRECEDING)""")
def w02(v: Views) -> DataFrame:
    near, far = trailing("ticker", "date", 20), trailing("ticker", "date", 60, 20)
    base = full(F.avg, "volume", far, 60)
    return v.dense.select("date", "ticker", r(F.when(base > 0, full(F.avg, "volume", near, 20) / base), 9).alias("volume_ratio"))


@query("w03_chip20", f"""SELECT date, ticker, CASE WHEN count(t) OVER w = 20 THEN sum(t) OVER w END AS chip_20 FROM (SELECT d.date, d.ticker, c.qfii + c.fund + c.dlrp AS t FROM fx_dense d LEFT JOIN fx_chip c ON c.date = d.date AND c.ticker = d.ticker)
  WINDOW w AS ({DENSE} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def w03(v: Views) -> DataFrame:
    rows = v.dense.join(v.chip, ["date", "ticker"], "left").withColumn("t", F.col("qfii") + F.col("fund") + F.col("dlrp"))
    return rows.select("date", "ticker", full(F.sum, "t", trailing("ticker", "date", 20), 20).alias("chip_20"))


@query("w04_momentum_12_1", "SELECT date, ticker, CASE WHEN a > 0 AND b > 0 THEN round(a / b - 1, 9) END AS momentum FROM (SELECT date, ticker, lag(adj_close, 21) OVER w AS a, lag(adj_close, 252) OVER w AS b FROM fx_dense WINDOW w AS (PARTITION BY ticker ORDER BY date))")
def w04(v: Views) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    a, b = F.lag("adj_close", 21).over(w), F.lag("adj_close", 252).over(w)
    return v.dense.select("date", "ticker", r(F.when((a > 0) & (b > 0), a / b - 1), 9).alias("momentum"))


RETURNS = f"(SELECT date, ticker, adj_close / lag(adj_close) OVER ({DENSE}) - 1 AS ret FROM fx_dense)"


def returns(v: Views) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    return v.dense.select("date", "ticker", F.try_divide("adj_close", F.lag("adj_close").over(w)).alias("x")).select("date", "ticker", (F.col("x") - 1).alias("ret"))


@query("w05_adjacent_return", f"SELECT date, ticker, round(ret, 12) AS ret FROM {RETURNS}")
def w05(v: Views) -> DataFrame:
    return returns(v).select("date", "ticker", r(F.col("ret"), 12).alias("ret"))


@query("w06_volatility_60", f"SELECT date, ticker, CASE WHEN n >= 20 AND s > 0 THEN round(s * sqrt(252), 9) END AS vol_60d FROM (SELECT date, ticker, count(ret) OVER w AS n, stddev_samp(ret) OVER w AS s FROM {RETURNS} WINDOW w AS ({DENSE} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))")
def w06(v: Views) -> DataFrame:
    w = trailing("ticker", "date", 60)
    s = full(F.stddev_samp, "ret", w, 20)
    return returns(v).select("date", "ticker", r(F.when(s > 0, s * F.sqrt(F.lit(252.0))), 9).alias("vol_60d"))


@query("w07_sharpe_60", f"SELECT date, ticker, CASE WHEN n = 60 AND s > 0 THEN round(m / s * sqrt(252), 6) END AS sharpe FROM (SELECT date, ticker, count(ret) OVER w AS n, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS s FROM {RETURNS} WINDOW w AS ({DENSE} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))")
def w07(v: Views) -> DataFrame:
    w = trailing("ticker", "date", 60)
    s = full(F.stddev_samp, "ret", w, 60)
    return returns(v).select("date", "ticker", r(F.when(s > 0, F.avg("ret").over(w) / s * F.sqrt(F.lit(252.0)))).alias("sharpe"))


@query("w08_sortino_60", f"SELECT date, ticker, CASE WHEN n = 60 AND d > 0 THEN round(m / sqrt(d) * sqrt(252), 6) END AS sortino FROM (SELECT date, ticker, count(ret) OVER w AS n, avg(ret) OVER w AS m, avg(pow(least(ret, 0), 2)) OVER w AS d FROM {RETURNS} WHERE true WINDOW w AS ({DENSE} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))")
def w08(v: Views) -> DataFrame:
    w = trailing("ticker", "date", 60)
    rows = returns(v).withColumn("down", F.when(F.col("ret").isNotNull(), F.pow(F.least("ret", F.lit(0.0)), 2)))
    d = full(F.avg, "down", w, 60)
    return rows.select("date", "ticker", r(F.when(d > 0, F.avg("ret").over(w) / F.sqrt(d) * F.sqrt(F.lit(252.0)))).alias("sortino"))


TOTAL_SQL = """SELECT date AS formation_date, round(total, 2) AS total FROM (
    SELECT date, month, k, n, session_idx, sum(traded_value) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS total
    FROM fx_calendar c JOIN fx_index i USING (date, session_idx)) WHERE k = n AND session_idx >= (SELECT min(session_idx) + 19 FROM fx_calendar)"""


# The first formations have no 20 sessions yet; the operator fails for such ones.
@query("w09_index_sum20", TOTAL_SQL)
def w09(v: Views) -> DataFrame:
    first = v.calendar.agg(F.min("session_idx").alias("first"))
    ends = v.calendar.where("k = n").join(F.broadcast(first), F.col("session_idx") >= F.col("first") + 19)
    total = features.index_total(v.index, v.calendar, ends.select(F.col("date").alias("formation_date")))
    return total.withColumn("total", r(F.col("total"), 2))


@query("w10_expanding_adv20", "SELECT date, ticker, round(avg(coalesce(traded_value, 0)) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) AS adv20 FROM fx_price")
def w10(v: Views) -> DataFrame:
    return v.price.select("date", "ticker", r(F.avg(F.coalesce("traded_value", F.lit(0.0))).over(trailing("ticker", "date", 20)), 4).alias("adv20"))


# Some amounts are 0 or negative here, which count as missing.
@query("w11_lagged_baseline", f"""SELECT date, ticker, CASE WHEN count(x) OVER w >= 20 THEN quantile_cont(x, 0.5) OVER w END AS baseline
    FROM (SELECT date, ticker, CASE WHEN session_idx % 13 > 1 AND traded_value > 0 THEN traded_value END AS x FROM fx_dense)
    WINDOW w AS ({DENSE} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""")
def w11(v: Views) -> DataFrame:
    kind = F.col("session_idx") % 13
    rows = v.dense.withColumn("traded_value", F.when(kind == 0, 0.0).when(kind == 1, -F.col("traded_value")).otherwise(F.col("traded_value")))
    return features.lagged_baseline(rows, "traded_value", SERIES).select("date", "ticker", "baseline")


BAR_Y = "(SELECT etf_id, bar, end_date, ln(close) AS y, high, low, close, amount, days FROM fx_bar)"
CHANGES = f"(SELECT *, y - lag(y) OVER ({BARS}) AS d FROM {BAR_Y})"


def bars(v: Views) -> DataFrame:
    return v.bar.withColumn("y", F.ln("close"))


def changes(v: Views) -> DataFrame:
    return features.difference(bars(v), "y", "d")


def rounded(rows: DataFrame, keys: list[str], **digits: int) -> DataFrame:
    return rows.select(*keys, *(r(F.col(c), n).alias(c) for c, n in digits.items()))


BAR_KEY = ["etf_id", "bar"]


def spans(**rows: int) -> str:
    """SQL of named trailing windows over bars."""
    return ", ".join(f"{name} AS ({BARS} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for name, n in rows.items())


@query("w12_moving_mean_distance_z", f"""SELECT etf_id, bar, CASE WHEN n = 20 THEN round(m, 9) END AS mean, CASE WHEN n = 20 THEN round(y - m, 9) END AS distance,
    CASE WHEN n = 20 AND s > 0 THEN round((y - m) / s, 6) END AS z
    FROM (SELECT etf_id, bar, y, count(y) OVER w AS n, avg(y) OVER w AS m, stddev_samp(y) OVER w AS s FROM {BAR_Y} WINDOW {spans(w=20)})""")
def w12(v: Views) -> DataFrame:
    return rounded(features.moving_mean(bars(v), "y"), BAR_KEY, mean=9, distance=9, z=6)


SPREAD_SQL = f"""SELECT etf_id, bar, CASE WHEN count(y) OVER a = 14 THEN round(stddev_samp(y) OVER a, 9) END AS level14,
    CASE WHEN count(d) OVER a = 14 THEN round(stddev_samp(d) OVER a, 9) END AS change14,
    CASE WHEN count(y) OVER b = 60 THEN round(stddev_samp(y) OVER b, 9) END AS level60,
    CASE WHEN count(d) OVER b = 60 THEN round(stddev_samp(d) OVER b, 9) END AS change60 FROM {CHANGES} WINDOW {spans(a=14, b=60)}"""


@query("w13_rolling_deviation", SPREAD_SQL)
def w13(v: Views) -> DataFrame:
    return rounded(features.deviations(changes(v), "y", "d"), BAR_KEY, level14=9, change14=9, level60=9, change60=9)


@query("w14_rolling_shape", f"""SELECT etf_id, bar, CASE WHEN count(d) OVER w >= 30 THEN round(skewness(d) OVER w, 6) END AS skew,
    CASE WHEN count(d) OVER w >= 30 THEN round(kurtosis(d) OVER w, 5) END AS kurt FROM {CHANGES} WINDOW {spans(w=60)}""")
def w14(v: Views) -> DataFrame:
    return rounded(features.shape(changes(v), "d"), BAR_KEY, skew=6, kurt=5)


@query("w15_downside_volatility", f"""SELECT etf_id, bar, CASE WHEN n >= 30 THEN round(s, 9) END AS vol, CASE WHEN n >= 30 THEN round(sqrt(q), 9) END AS downside
    FROM (SELECT etf_id, bar, count(d) OVER w AS n, stddev_samp(d) OVER w AS s, avg(CASE WHEN d < 0 THEN d * d WHEN d IS NOT NULL THEN 0 END) OVER w AS q
    FROM {CHANGES} WINDOW {spans(w=60)})""")
def w15(v: Views) -> DataFrame:
    return rounded(features.downside(changes(v), "d"), BAR_KEY, vol=9, downside=9)


@query("w16_efficiency_ratio", f"""SELECT etf_id, bar, CASE WHEN n = 20 AND t > 0 THEN round(abs(y - y20) / t, 9) END AS efficiency
    FROM (SELECT etf_id, bar, y, lag(y, 20) OVER ({BARS}) AS y20, count(d) OVER w AS n, sum(abs(d)) OVER w AS t FROM {CHANGES} WINDOW {spans(w=20)})""")
def w16(v: Views) -> DataFrame:
    return rounded(features.efficiency(changes(v), "y", "d"), BAR_KEY, efficiency=9)


@query("w17_rolling_drawdown", f"SELECT etf_id, bar, round(y - max(y) OVER w, 12) AS drawdown FROM {BAR_Y} WINDOW {spans(w=60)}")
def w17(v: Views) -> DataFrame:
    return rounded(features.drawdown(bars(v), "y"), BAR_KEY, drawdown=12)


@query("w18_bar_shape", f"""SELECT etf_id, bar, round((high - low) / close, 9) AS range, round(ln(1 + amount), 9) AS log_amount,
    CASE WHEN count(days) OVER w = 20 THEN round(days / (quantile_cont(days, 0.5) OVER w), 9) END AS surprise,
    CASE WHEN count(amount) OVER w = 20 THEN round(amount / avg(amount) OVER w, 9) END AS amount_ratio
    FROM fx_bar WINDOW w AS ({BARS} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def w18(v: Views) -> DataFrame:
    return rounded(features.bar_shape(v.bar), BAR_KEY, range=9, log_amount=9, surprise=9, amount_ratio=9)


AMIHUD_SQL = f"""SELECT etf_id, bar, a AS amihud, CASE WHEN n = 20 THEN m END AS mean, CASE WHEN n = 20 AND error > 0 THEN slope END AS slope,
    CASE WHEN n = 20 AND error > 0 THEN slope / error END AS t FROM (SELECT *, sqrt(greatest(syy - sxy * sxy / sxx, 0) / 18 / sxx) AS error, sxy / sxx AS slope
    FROM (SELECT etf_id, bar, a, count(a) OVER w AS n, avg(a) OVER w AS m, regr_sxx(a, bar) OVER w AS sxx, regr_syy(a, bar) OVER w AS syy, regr_sxy(a, bar) OVER w AS sxy
    FROM (SELECT etf_id, bar, abs(d) / nullif(amount, 0) AS a FROM {CHANGES}) WINDOW {spans(w=20)}))"""


@query("w20_amihud_trend", f"SELECT etf_id, bar, round(1e6 * amihud, 9) AS amihud, round(1e6 * mean, 9) AS mean20, round(1e6 * slope, 9) AS slope, round(t, 5) AS t FROM ({AMIHUD_SQL})")
def w20(v: Views) -> DataFrame:
    rows = features.amihud(changes(v), "d", "amount")
    scaled = rows.select(*BAR_KEY, (1e6 * F.col("amihud")).alias("amihud"), (1e6 * F.col("amihud_mean")).alias("mean20"), (1e6 * F.col("slope")).alias("slope"), "t")
    return rounded(scaled, BAR_KEY, amihud=9, mean20=9, slope=9, t=5)


@query("w21_roll_spread", f"""SELECT etf_id, bar, CASE WHEN n = 20 AND c < 0 THEN round(2 * sqrt(-c), 9) END AS spread,
    CASE WHEN n < 20 THEN 'short' WHEN c >= 0 THEN 'non_negative_covariance' END AS spread_reason
    FROM (SELECT etf_id, bar, count(d1) OVER w AS n, covar_samp(d, d1) OVER w AS c
    FROM (SELECT etf_id, bar, d, lag(d) OVER ({BARS}) AS d1 FROM {CHANGES}) WINDOW {spans(w=20)})""")
def w21(v: Views) -> DataFrame:
    return features.roll_spread(changes(v), "d").select(*BAR_KEY, r(F.col("spread"), 9).alias("spread"), "spread_reason")


INDEX_D = "(SELECT date, ln(traded_value) AS y, ln(traded_value) - lag(ln(traded_value)) OVER (ORDER BY date) AS d FROM fx_index)"
INDEX_SPANS = "a AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


@query("w22_index_features", f"""SELECT date, round(d, 12) AS d, CASE WHEN count(d) OVER a = 20 THEN round(stddev_samp(d) OVER a, 9) END AS vol20,
    CASE WHEN count(d) OVER b = 60 THEN round(stddev_samp(d) OVER b, 9) END AS vol60, round(y - max(y) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 12) AS drawdown
    FROM {INDEX_D} WINDOW {INDEX_SPANS}""")
def w22(v: Views) -> DataFrame:
    return rounded(features.index_features(v.index, "traded_value"), ["date"], d=12, vol20=9, vol60=9, drawdown=12)


@query("w23_rolling_beta", f"""SELECT date, ticker, CASE WHEN n = 60 THEN round(b, 6) END AS beta, CASE WHEN n = 60 THEN round(c, 6) END AS cor FROM (SELECT date, ticker, count(ret) OVER w AS n, covar_samp(ret, x) OVER w / var_samp(x) OVER w AS b, corr(ret, x) OVER w AS c
  FROM (SELECT p.date, p.ticker, CASE WHEN i.x IS NOT NULL THEN p.ret END AS ret, CASE WHEN p.ret IS NOT NULL THEN i.x END AS x FROM {RETURNS} p JOIN (SELECT date, traded_value / lag(traded_value) OVER (ORDER BY date) - 1 AS x FROM fx_index) i ON i.date = p.date) WINDOW w AS ({DENSE} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))""")
def w23(v: Views) -> DataFrame:
    w = trailing("ticker", "date", 60)
    index = v.index.select("date", (F.col("traded_value") / F.lag("traded_value").over(Window.orderBy("date")) - 1).alias("x"))
    rows = returns(v).join(F.broadcast(index), "date")
    rows = rows.select("date", "ticker", F.when(F.col("x").isNotNull(), F.col("ret")).alias("ret"), F.when(F.col("ret").isNotNull(), F.col("x")).alias("x"))
    enough = F.count("ret").over(w) == 60
    return rows.select("date", "ticker", r(F.when(enough, F.covar_samp("ret", "x").over(w) / F.var_samp("x").over(w))).alias("beta"), r(F.when(enough, F.corr("ret", "x").over(w))).alias("cor"))


# An index seen on some sessions only: runs of unseen ones make observations old, the first bars have none.
@query("w24_staleness", """SELECT etf_id, bar, here - seen AS age, CASE WHEN here - seen <= 1 THEN value END AS traded_value, CASE WHEN seen IS NULL THEN 'missing' WHEN here - seen > 1 THEN 'stale' END AS reason
    FROM fx_bar b ASOF LEFT JOIN (SELECT date, session_idx AS here, max(known) OVER w AS seen, arg_max(traded_value, known) OVER w AS value
    FROM (SELECT date, session_idx, traded_value, CASE WHEN session_idx % 7 < 4 AND session_idx >= 30 THEN session_idx END AS known FROM fx_index)
    WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)) c ON b.end_date >= c.date""")
def w24(v: Views) -> DataFrame:
    seen = v.index.where("session_idx % 7 < 4 and session_idx >= 30").select("date", "traded_value")
    return features.aligned(v.bar, "end_date", seen, ["traded_value"], v.calendar).select("etf_id", "bar", "age", "traded_value", "reason")


@query("w25_realized_volatility", f"""SELECT date, CASE WHEN count(d) OVER a = 20 THEN round(stddev_samp(d) OVER a * sqrt(252), 9) END AS realized20,
    CASE WHEN count(d) OVER b = 60 THEN round(stddev_samp(d) OVER b * sqrt(252), 9) END AS realized60 FROM {INDEX_D} WINDOW {INDEX_SPANS}""")
def w25(v: Views) -> DataFrame:
    return rounded(features.realized_volatility(v.index, "traded_value"), ["date"], realized20=9, realized60=9)


@query("w25_bar_return_deviation", f"SELECT etf_id, bar, CASE WHEN count(d) OVER w = 14 THEN round(stddev_samp(d) OVER w, 9) END AS bar_deviation FROM {CHANGES} WINDOW {spans(w=14)}")
def w25_bars(v: Views) -> DataFrame:
    return rounded(features.bar_return_deviation(v.bar), BAR_KEY, bar_deviation=9)


@query("w26_flow_z_score", f"""SELECT date, ticker, CASE WHEN n = 20 AND s > 0 THEN round((x - m) / s, 6) END AS z
    FROM (SELECT date, ticker, x, count(x) OVER w AS n, avg(x) OVER w AS m, stddev_samp(x) OVER w AS s
    FROM (SELECT d.date, d.ticker, c.fund AS x FROM fx_dense d LEFT JOIN fx_chip c ON c.date = d.date AND c.ticker = d.ticker)
    WINDOW w AS ({DENSE} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")
def w26(v: Views) -> DataFrame:
    rows = v.dense.select("date", "ticker").join(v.chip.select("date", "ticker", "fund"), ["date", "ticker"], "left")
    return rounded(features.z_score(rows, "fund", SERIES), ["date", "ticker"], z=6)


@query("w28_lag_and_change", "SELECT date, etf_id, lag(nav) OVER (PARTITION BY etf_id ORDER BY date) AS prior, round(nav / lag(nav) OVER (PARTITION BY etf_id ORDER BY date) - 1, 12) AS change FROM fx_curve")
def w28(v: Views) -> DataFrame:
    prior = F.lag("nav").over(Window.partitionBy("etf_id").orderBy("date"))
    return v.curve.select("date", "etf_id", prior.alias("prior"), r(F.col("nav") / prior - 1, 12).alias("change"))


# Weights that differ by ticker, so that the turnover of weights isn't that of names.
CHANGES_SQL = """WITH h AS (SELECT date, etf_id, ticker, w * (1 + CAST(ticker AS INTEGER) % 3) AS w, date_trunc('month', date)::DATE AS month FROM fx_holding),
    m AS (SELECT * FROM h QUALIFY date = max(date) OVER (PARTITION BY etf_id, month)),
    p AS (SELECT etf_id, month, lag(month) OVER (PARTITION BY etf_id ORDER BY month) AS prior FROM (SELECT DISTINCT etf_id, month FROM m)),
    o AS (SELECT p.etf_id, p.month, m.ticker, m.w FROM p JOIN m ON m.etf_id = p.etf_id AND m.month = p.prior),
    x AS (SELECT coalesce(m.etf_id, o.etf_id) AS etf_id, coalesce(m.month, o.month) AS month, m.w AS new, o.w AS old FROM m FULL JOIN o ON m.etf_id = o.etf_id AND m.month = o.month AND m.ticker = o.ticker)
    SELECT etf_id, month, CASE WHEN count(old) > 0 THEN round(1 - count(*) FILTER (WHERE new IS NOT NULL AND old IS NOT NULL) / count(old), 9) END AS replaced,
    CASE WHEN count(old) > 0 THEN round(sum(abs(coalesce(new, 0) - coalesce(old, 0))) / 2, 9) END AS turnover FROM x GROUP BY 1, 2"""


@query("w29_monthly_turnover", CHANGES_SQL)
def w29(v: Views) -> DataFrame:
    held = v.holding.withColumn("w", F.col("w") * (1 + number("ticker") % 3))
    return rounded(features.monthly_changes(held), ["etf_id", "month"], replaced=9, turnover=9)


@query("w30_performance_summary", """SELECT etf_id, min(dd) AS max_drawdown, round(avg(ret) / stddev_samp(ret) * sqrt(252), 9) AS sharpe, round(stddev_samp(ret) * sqrt(252), 9) AS vol
    FROM (SELECT etf_id, nav / max(nav) OVER (PARTITION BY etf_id ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd,
    nav / lag(nav) OVER (PARTITION BY etf_id ORDER BY date) - 1 AS ret FROM fx_curve) GROUP BY etf_id""")
def w30(v: Views) -> DataFrame:
    return features.performance(v.curve).select("etf_id", "max_drawdown", r(F.col("sharpe"), 9).alias("sharpe"), r(F.col("vol"), 9).alias("vol"))


@query("w31_schedule_index", "SELECT date, month, k, n FROM fx_calendar")
def w31(v: Views) -> DataFrame:
    return v.calendar.select("date", "month", "k", "n")
