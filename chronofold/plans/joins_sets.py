"""Filters, joins, aggregates, order and set operations over the market views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.statistics import kurtosis_unbiased, skewness_unbiased
from chronofold.operators import relational as R

from .catalog import query
from .views import Views


@query("f01_universe_filter", "SELECT date, ticker, traded_value FROM fx_dense WHERE traded_value >= 400000 AND market_cap IS NOT NULL AND ticker = '1110'")
def f01(v: Views) -> DataFrame:
    return v.dense.where((F.col("traded_value") >= 400000) & F.col("market_cap").isNotNull() & F.col("ticker").eqNullSafe("1110")).select("date", "ticker", "traded_value")


@query("f02_exclusion_cascade", """SELECT s.date, s.ticker, CASE WHEN NOT regexp_matches(s.ticker, '^[1-9][0-9]{3}$') THEN 'not_common' WHEN m.ticker IS NULL THEN 'missing_master' WHEN m.list_date > s.date THEN 'not_listed'
  WHEN m.delist_date <= s.date THEN 'delisted' WHEN s.market_state = 'HALTED' THEN 'halted' WHEN s.market_state = 'MISSING' THEN 'missing_state' END AS reason
  FROM fx_state s LEFT JOIN (SELECT * FROM fx_master WHERE ticker <> '1120') m ON m.ticker = s.ticker""")
def f02(v: Views) -> DataFrame:
    master = v.master.where("ticker <> '1120'").select(F.col("ticker"), "list_date", "delist_date", F.lit(True).alias("known"))
    reason = R.cascade(("not_common", ~F.col("ticker").rlike("^[1-9][0-9]{3}$")), ("missing_master", F.col("known").isNull()), ("not_listed", F.col("list_date") > F.col("date")), ("delisted", F.col("delist_date") <= F.col("date")), ("halted", F.col("market_state") == "HALTED"), ("missing_state", F.col("market_state") == "MISSING"))
    return R.checked_join(v.state, master, ["ticker"]).select("date", "ticker", reason.alias("reason"))


@query("f04_industry_filter", "SELECT ticker, main_industry FROM fx_master WHERE main_industry IN ('financial', 'shipping') AND main_industry NOT IN ('shipping')")
def f04(v: Views) -> DataFrame:
    return v.master.where(F.col("main_industry").isin("financial", "shipping") & ~F.col("main_industry").isin("shipping")).select("ticker", "main_industry")


@query("f06_event_range", "SELECT ticker, delist_date FROM fx_master WHERE delist_date IS NULL OR delist_date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'")
def f06(v: Views) -> DataFrame:
    return v.master.where(F.col("delist_date").isNull() | F.col("delist_date").between("1999-01-01", "2000-12-31")).select("ticker", "delist_date")


@query("f07_split_filter", "SELECT etf_id, bar FROM fx_bar WHERE start_date <= DATE '1999-06-30' AND end_date < DATE '1999-06-30'")
def f07(v: Views) -> DataFrame:
    return v.bar.where((F.col("start_date") <= F.lit("1999-06-30").cast("date")) & (F.col("end_date") < F.lit("1999-06-30").cast("date"))).select("etf_id", "bar")


@query("j01_left_join_one_to_one", "SELECT p.date, p.ticker, m.main_industry, m.delist_date FROM fx_price p LEFT JOIN fx_master m ON m.ticker = p.ticker")
def j01(v: Views) -> DataFrame:
    return R.checked_join(v.price, v.master, ["ticker"]).select("date", "ticker", "main_industry", "delist_date")


@query("j02_inner_join_without_loss", "SELECT b.etf_id, b.bar, c.nav FROM fx_bar b JOIN fx_curve c ON c.etf_id = b.etf_id AND c.date = b.end_date")
def j02(v: Views) -> DataFrame:
    return R.checked_join(v.bar.withColumn("date", F.col("end_date")), v.curve, ["etf_id", "date"], "inner1", "1:1").select("etf_id", "bar", "nav")


@query("j03_many_to_one_index", "SELECT p.date, p.ticker, p.traded_value / i.traded_value AS share FROM fx_price p LEFT JOIN fx_index i ON i.date = p.date")
def j03(v: Views) -> DataFrame:
    index = v.index.select("date", F.col("traded_value").alias("total"))
    return R.checked_join(v.price, index, ["date"]).select("date", "ticker", (F.col("traded_value") / F.col("total")).alias("share"))


@query("j04_previous_session_holdings", """SELECT d.date, h.ticker, h.w, d.etf_id FROM (SELECT date, etf_id, lag(date) OVER (PARTITION BY etf_id ORDER BY date) AS prior FROM (SELECT DISTINCT date, etf_id FROM fx_holding)) d
  LEFT JOIN fx_holding h ON h.etf_id = d.etf_id AND h.date = d.prior""")
def j04(v: Views) -> DataFrame:
    days = v.holding.select("date", "etf_id").distinct().withColumn("prior", F.lag("date").over(Window.partitionBy("etf_id").orderBy("date")))
    held = v.holding.select(F.col("date").alias("prior"), "etf_id", "ticker", "w")
    return days.join(held, ["etf_id", "prior"], "left").select("date", "etf_id", "ticker", "w")


@query("j05_many_to_many_constituents", "SELECT b.etf_id, b.bar, h.ticker, h.w FROM fx_bar b LEFT JOIN fx_holding h ON h.etf_id = b.etf_id AND h.date = CAST(date_trunc('week', b.end_date) AS DATE)")
def j05(v: Views) -> DataFrame:
    bars = v.bar.select("etf_id", "bar", F.date_trunc("week", "end_date").cast("date").alias("date"))
    return bars.join(v.holding, ["etf_id", "date"], "left").select("etf_id", "bar", "ticker", "w")


@query("j06_left_anti_coverage", "SELECT s.date, s.ticker FROM fx_state s WHERE NOT EXISTS (SELECT 1 FROM fx_price p WHERE p.date = s.date AND p.ticker = s.ticker)")
def j06(v: Views) -> DataFrame:
    return v.state.join(v.price, ["date", "ticker"], "left_anti").select("date", "ticker")


@query("j07_full_outer_key_check", """SELECT coalesce(a.date, b.date) AS date, CASE WHEN b.date IS NULL THEN 'left_only' ELSE 'right_only' END AS side
  FROM (SELECT DISTINCT date FROM fx_curve) a FULL JOIN (SELECT date FROM fx_calendar) b ON a.date = b.date WHERE a.date IS NULL OR b.date IS NULL""")
def j07(v: Views) -> DataFrame:
    return R.key_mismatch(v.curve, v.calendar, ["date"])


@query("j08_asof_backward", "SELECT c.date, c.etf_id, i.traded_value AS index_value FROM fx_curve c ASOF LEFT JOIN fx_index i ON c.date >= i.date")
def j08(v: Views) -> DataFrame:
    index = v.index.select(F.col("date").alias("d"), F.col("traded_value").alias("index_value"))
    return R.asof_join(v.curve, index, "date", "d", ["index_value"]).select("date", "etf_id", "index_value")


@query("j09_asof_by_key", """SELECT p.date, p.ticker, f.r103 FROM fx_price p ASOF LEFT JOIN (SELECT ticker, available, arg_max(r103, row_no) AS r103 FROM fx_financial GROUP BY 1, 2) f ON p.ticker = f.ticker AND p.date >= f.available""")
def j09(v: Views) -> DataFrame:
    return R.asof_join(v.price, v.financial, "date", "available", ["r103"], by=["ticker"], tie=["row_no"]).select("date", "ticker", "r103")


@query("j10_asof_backward_strict", "SELECT p.date, p.ticker, s.r18 FROM fx_price p ASOF LEFT JOIN (SELECT ticker, available, r18 FROM fx_sales WHERE revision = 1) s ON p.ticker = s.ticker AND p.date > s.available")
def j10(v: Views) -> DataFrame:
    return R.asof_join(v.price, v.sales.where("revision = 1"), "date", "available", ["r18"], by=["ticker"], allow_exact=False).select("date", "ticker", "r18")


@query("j11_asof_bars_index", "SELECT b.etf_id, b.bar, i.session_idx FROM fx_bar b ASOF LEFT JOIN fx_index i ON b.end_date >= i.date")
def j11(v: Views) -> DataFrame:
    return R.asof_join(v.bar, v.index.withColumnRenamed("date", "d"), "end_date", "d", ["session_idx"]).select("etf_id", "bar", "session_idx")


@query("j12_asof_month_before", """SELECT b.etf_id, b.bar, m.month, m.nav FROM (SELECT etf_id, bar, CAST(date_trunc('month', end_date) AS DATE) AS own FROM fx_bar) b
  ASOF LEFT JOIN (SELECT etf_id, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(nav, date) AS nav FROM fx_curve GROUP BY 1, 2) m ON m.etf_id = b.etf_id AND b.own > m.month""")
def j12(v: Views) -> DataFrame:
    months = v.curve.groupBy("etf_id", F.trunc("date", "month").alias("month")).agg(F.max_by("nav", "date").alias("nav"))
    return R.asof_join(v.bar.withColumn("own", F.trunc("end_date", "month")), months, "own", "month", ["month", "nav"], by=["etf_id"], allow_exact=False).select("etf_id", "bar", "month", "nav")


@query("j13_carry_identity_forward", """SELECT date, ticker, last_value(nullif(trim(mkt), '') IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS market
  FROM (SELECT date, ticker, CASE WHEN session_idx % 9 = 0 THEN CASE WHEN session_idx % 18 = 0 THEN 'TSE' ELSE 'OTC' END WHEN session_idx % 2 = 0 THEN '  ' END AS mkt FROM fx_dense)""")
def j13(v: Views) -> DataFrame:
    s = F.col("session_idx")
    mkt = F.when(s % 9 == 0, F.when(s % 18 == 0, "TSE").otherwise("OTC")).when(s % 2 == 0, "  ")
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return v.dense.withColumn("mkt", mkt).select("date", "ticker", F.last(F.nullif(F.trim("mkt"), F.lit("")), ignorenulls=True).over(w).alias("market"))


@query("j14_asof_forward", "SELECT s.ticker, s.period, s.row_id, p.date AS first_date FROM fx_sales s ASOF LEFT JOIN fx_price p ON s.ticker = p.ticker AND s.available <= p.date")
def j14(v: Views) -> DataFrame:
    price = v.price.select("ticker", F.col("date").alias("first_date"))
    return R.asof_join(v.sales, price, "available", "first_date", ["first_date"], by=["ticker"], forward=True).select("ticker", "period", "row_id", "first_date")


@query("j15_next_session", "SELECT s.row_id, s.period, min(c.date) AS next_session FROM fx_sales s LEFT JOIN fx_calendar c ON c.date > s.available GROUP BY 1, 2")
def j15(v: Views) -> DataFrame:
    days = v.calendar.select(F.col("date").alias("next_session"))
    return R.asof_join(v.sales, days, "available", "next_session", ["next_session"], forward=True, allow_exact=False).select("row_id", "period", "next_session")


@query("j16_interval_join_path", "SELECT b.etf_id, b.bar, count(*) AS n, max(c.nav) AS high FROM fx_bar b JOIN fx_curve c ON c.etf_id = b.etf_id AND c.date > b.end_date AND c.date <= b.end_date + 30 GROUP BY 1, 2")
def j16(v: Views) -> DataFrame:
    spans = v.bar.select("etf_id", "bar", F.col("end_date").alias("low"), F.date_add("end_date", 30).alias("high_date"))
    return R.interval_join(v.curve, spans, ["etf_id"], "date", "low", "high_date").groupBy("etf_id", "bar").agg(F.count("*").alias("n"), F.max("nav").alias("high"))


@query("j17_bar_range_join", "SELECT a.etf_id, a.bar, max(ln(b.high / a.close)) AS best, min(ln(b.low / a.close)) AS worst FROM fx_bar a JOIN fx_bar b ON a.etf_id = b.etf_id AND b.bar > a.bar AND b.bar <= a.bar + 5 GROUP BY 1, 2")
def j17(v: Views) -> DataFrame:
    spans = v.bar.select("etf_id", F.col("bar").alias("own"), F.col("close").alias("entry"), (F.col("bar") + 5).alias("until"))
    pairs = R.interval_join(v.bar, spans, ["etf_id"], "bar", "own", "until")
    return pairs.groupBy("etf_id", F.col("own").alias("bar")).agg(F.max(F.ln(F.col("high") / F.col("entry"))).alias("best"), F.min(F.ln(F.col("low") / F.col("entry"))).alias("worst"))


@query("j18_purge_overlapping", "SELECT etf_id, bar FROM fx_bar a WHERE NOT EXISTS (SELECT 1 FROM fx_bar b WHERE b.bar % 20 = 7 AND b.etf_id = a.etf_id AND a.start_date <= b.end_date AND a.end_date >= b.start_date)")
def j18(v: Views) -> DataFrame:
    held = v.bar.where("bar % 20 = 7").select("etf_id", F.col("start_date").alias("held_from"), F.col("end_date").alias("held_to"))
    return R.without_overlap(v.bar, held, ["etf_id"], ("start_date", "end_date"), ("held_from", "held_to")).select("etf_id", "bar")


@query("j19_lifecycle_sessions", "SELECT c.date, m.ticker, p.close FROM fx_calendar c JOIN fx_master m ON m.list_date <= c.date AND (m.delist_date IS NULL OR c.date < m.delist_date) LEFT JOIN fx_price p ON p.date = c.date AND p.ticker = m.ticker")
def j19(v: Views) -> DataFrame:
    inside = (F.col("list_date") <= F.col("date")) & (F.col("delist_date").isNull() | (F.col("date") < F.col("delist_date")))
    return v.master.join(F.broadcast(v.calendar.select("date")), inside).join(v.price.select("date", "ticker", "close"), ["date", "ticker"], "left").select("date", "ticker", "close")


@query("a01_group_aggregates", "SELECT ticker, count(*) AS n, sum(volume) AS volume, max(close) AS high, min(close) AS low, arg_min(close, date) AS first_close, bool_and(volume > 20) AS busy FROM fx_price GROUP BY ticker")
def a01(v: Views) -> DataFrame:
    return v.price.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.max("close").alias("high"), F.min("close").alias("low"), F.min_by("close", "date").alias("first_close"), F.bool_and(F.col("volume") > 20).alias("busy"))


@query("a02_all_present_or_null", "SELECT h.date, h.etf_id, CASE WHEN count(*) = count(c.qfii) THEN round(sum(h.w * c.qfii), 6) END AS flow FROM fx_holding h LEFT JOIN fx_chip c ON c.date = h.date AND c.ticker = h.ticker GROUP BY 1, 2")
def a02(v: Views) -> DataFrame:
    rows = v.holding.join(v.chip, ["date", "ticker"], "left")
    return rows.groupBy("date", "etf_id").agg(F.when(F.count("*") == F.count("qfii"), F.round(F.sum(F.col("w") * F.col("qfii")), 6)).alias("flow"))


@query("a03_concentration", "SELECT date, etf_id, round(sum(w * w), 9) AS hhi FROM fx_holding GROUP BY 1, 2")
def a03(v: Views) -> DataFrame:
    return v.holding.groupBy("date", "etf_id").agg(F.round(F.sum(F.col("w") * F.col("w")), 9).alias("hhi"))


@query("a04_month_ends", "SELECT month, max(date) AS formation_date FROM fx_calendar GROUP BY month")
def a04(v: Views) -> DataFrame:
    return v.calendar.groupBy("month").agg(F.max("date").alias("formation_date"))


@query("a05_conditional_counts", "SELECT ticker, count(*) FILTER (WHERE market_state = 'TRADING') AS trading, count(*) FILTER (WHERE market_state = 'HALTED') AS halted, count(DISTINCT amount_state) AS states FROM fx_state GROUP BY 1")
def a05(v: Views) -> DataFrame:
    return v.state.groupBy("ticker").agg(F.count_if(F.col("market_state") == "TRADING").alias("trading"), F.count_if(F.col("market_state") == "HALTED").alias("halted"), F.countDistinct("amount_state").alias("states"))


@query("a06_distinct_conflict", "SELECT ticker, period_end, CASE WHEN count(DISTINCT r103) = 1 THEN max(r103) END AS r103, count(DISTINCT r103) > 1 AS conflict FROM fx_financial GROUP BY 1, 2")
def a06(v: Views) -> DataFrame:
    n = F.count_distinct("r103")
    return v.financial.groupBy("ticker", "period_end").agg(F.when(n == 1, F.max("r103")).alias("r103"), (n > 1).alias("conflict"))


@query("a07_ordered_float_sum", "SELECT date, etf_id, list_reduce(list(w ORDER BY ticker), lambda a, b: a + b) AS total FROM fx_holding GROUP BY 1, 2")
def a07(v: Views) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ticker", F.col("w").cast("double").alias("w"))))
    return v.holding.groupBy("date", "etf_id").agg(F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["w"]).alias("total"))


@query("a08_exact_quantiles", "SELECT ticker, quantile_cont(close, 0.05) AS q05, quantile_cont(close, 0.5) AS q50, quantile_cont(close, 0.95) AS q95 FROM fx_price GROUP BY 1")
def a08(v: Views) -> DataFrame:
    return v.price.groupBy("ticker").agg(*[F.percentile("close", q).alias(n) for n, q in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95))])


@query("a09_lagged_rolling_median", "SELECT date, ticker, quantile_cont(volume, 0.5) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS median20 FROM fx_dense")
def a09(v: Views) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-20, -1)
    return v.dense.select("date", "ticker", F.percentile("volume", 0.5).over(w).alias("median20"))


@query("a10_correlation_matrix", """WITH r AS (SELECT date, etf_id, nav / lag(nav) OVER (PARTITION BY etf_id ORDER BY date) - 1 AS r FROM fx_curve)
  SELECT a.etf_id AS a, b.etf_id AS b, count(*) AS n, round(covar_samp(a.r, b.r), 9) AS cov, round(corr(a.r, b.r), 9) AS cor FROM r a JOIN r b ON a.date = b.date AND a.etf_id <= b.etf_id WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2""")
def a10(v: Views) -> DataFrame:
    r = v.curve.select("date", "etf_id", (F.col("nav") / F.lag("nav").over(Window.partitionBy("etf_id").orderBy("date")) - 1).alias("r")).where("r is not null")
    pairs = r.select("date", F.col("etf_id").alias("a"), F.col("r").alias("x")).join(r.select("date", F.col("etf_id").alias("b"), F.col("r").alias("y")), "date").where("a <= b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.covar_samp("x", "y"), 9).alias("cov"), F.round(F.corr("x", "y"), 9).alias("cor"))


@query("a11_unbiased_moments", "SELECT ticker, round(skewness(close), 6) AS skew, round(kurtosis(close), 6) AS kurt FROM fx_price GROUP BY 1")
def a11(v: Views) -> DataFrame:
    return v.price.groupBy("ticker").agg(F.round(skewness_unbiased("close"), 6).alias("skew"), F.round(kurtosis_unbiased("close"), 6).alias("kurt"))


@query("a12_pivot_fixed_columns", "SELECT date, max(nav) FILTER (WHERE etf_id = '1-URGENT') AS urgent, max(nav) FILTER (WHERE etf_id = '2-HIGH') AS high, max(nav) FILTER (WHERE etf_id = '5-LOW') AS low FROM fx_curve GROUP BY date")
def a12(v: Views) -> DataFrame:
    ids = ["1-URGENT", "2-HIGH", "5-LOW"]
    return v.curve.groupBy("date").pivot("etf_id", ids).agg(F.max("nav")).toDF("date", "urgent", "high", "low")


@query("a13_store_ranges", "SELECT extract(year FROM date) AS year, min(date) AS low, max(date) AS high, count(*) AS n, count(DISTINCT ticker) AS tickers FROM fx_price GROUP BY 1")
def a13(v: Views) -> DataFrame:
    return v.price.groupBy(F.year("date").cast("long").alias("year")).agg(F.min("date").alias("low"), F.max("date").alias("high"), F.count("*").alias("n"), F.count_distinct("ticker").alias("tickers"))


SCORED = "SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, (event_id * 37 % 101) / 101.0 AS p, 1.0 + user_id % 3 AS w FROM fx_event"


@query("a14_classification_metrics", f"""WITH s AS ({SCORED}), r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS mid FROM s)
  SELECT round((sum(mid) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 9) AS auc,
  round(sum(w * (p - y) * (p - y)) / sum(w), 9) AS brier, round(-sum(w * ln(greatest(1e-15, CASE WHEN y = 1 THEN p ELSE 1 - p END))) / sum(w), 9) AS log_loss,
  round(2 * sum(w) FILTER (WHERE y = 1 AND p >= 0.5) / (sum(w) FILTER (WHERE y = 1) + sum(w) FILTER (WHERE p >= 0.5)), 9) AS f1 FROM r""")
def a14(v: Views) -> DataFrame:
    from chronofold.functions.statistics import classification_metrics

    rows = v.event.select("event_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"), (F.col("event_id") * 37 % 101 / 101.0).alias("p"), (1.0 + F.col("user_id") % 3).alias("w"))
    return classification_metrics(rows, "y", "p", "w").select(*[F.round(c, 9).alias(c) for c in ("auc", "brier", "log_loss", "f1")])


@query("o03_universe_top_n", "SELECT date, ticker, CAST(rank AS INTEGER) AS rank FROM (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY traded_value DESC NULLS FIRST, ticker DESC NULLS FIRST) AS rank FROM fx_dense) WHERE rank <= 5")
def o03(v: Views) -> DataFrame:
    return R.top_k(v.dense, ["date"], [F.desc_nulls_first("traded_value"), F.desc_nulls_first("ticker")], 5).select("date", "ticker", "rank")


@query("o04_latest_per_key", "SELECT ticker, period, row_id, r18 FROM (SELECT *, row_number() OVER (PARTITION BY ticker, period ORDER BY available DESC, row_id DESC) AS n FROM fx_sales) WHERE n = 1")
def o04(v: Views) -> DataFrame:
    return R.latest_per_key(v.sales, ["ticker", "period"], [F.desc("available"), F.desc("row_id")]).select("ticker", "period", "row_id", "r18")


@query("o05_first_legal_open", "SELECT b.etf_id, b.bar, s.ticker, min(s.date) AS entry_date FROM fx_bar b JOIN fx_state s ON s.date > b.end_date AND s.date <= b.end_date + 60 WHERE s.tradable GROUP BY 1, 2, 3")
def o05(v: Views) -> DataFrame:
    legal = v.state.where("tradable").select("ticker", F.col("date").alias("entry_date"))
    wanted = v.bar.select("etf_id", "bar", "end_date").join(F.broadcast(v.master.select("ticker")))
    found = R.asof_join(wanted, legal, "end_date", "entry_date", ["entry_date"], by=["ticker"], forward=True, allow_exact=False)
    return found.where(F.col("entry_date") <= F.date_add("end_date", 60)).select("etf_id", "bar", "ticker", "entry_date")


@query("o06_first_touch", "SELECT a.etf_id, a.bar, min(c.date) AS touch, arg_min(c.nav, c.date) AS nav FROM fx_bar a JOIN fx_curve c ON c.etf_id = a.etf_id AND c.date > a.end_date AND c.date <= a.end_date + 60 WHERE abs(ln(c.nav / a.close)) >= 0.1 GROUP BY 1, 2")
def o06(v: Views) -> DataFrame:
    spans = v.bar.select("etf_id", "bar", F.col("close").alias("entry"), F.col("end_date").alias("low"), F.date_add("end_date", 60).alias("until"))
    path = R.interval_join(v.curve, spans, ["etf_id"], "date", "low", "until")
    touched = path.where(F.abs(F.ln(F.col("nav") / F.col("entry"))) >= 0.1)
    return touched.groupBy("etf_id", "bar").agg(F.min("date").alias("touch"), F.min_by("nav", "date").alias("nav"))


@query("o07_sorted_output", "SELECT date, ticker, close FROM fx_price ORDER BY date, ticker")
def o07(v: Views) -> DataFrame:
    return v.price.select("date", "ticker", "close").orderBy("date", "ticker")


@query("u01_keyed_upsert", """WITH new AS (SELECT ticker, period, r18 + 1 AS r18 FROM fx_sales WHERE revision = 2), old AS (SELECT ticker, period, r18 FROM fx_sales WHERE revision = 1)
  SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.ticker = old.ticker AND new.period = old.period) UNION ALL SELECT * FROM new""")
def u01(v: Views) -> DataFrame:
    rows = v.sales.select("ticker", "period", "r18", "revision")
    return R.upsert(rows.where("revision = 1").drop("revision"), rows.where("revision = 2").select("ticker", "period", (F.col("r18") + 1).alias("r18")), ["ticker", "period"])


@query("u02_union_aligned", "SELECT date, ticker AS id, close, NULL::DOUBLE AS nav FROM fx_price UNION ALL SELECT date, etf_id, NULL, nav FROM fx_curve")
def u02(v: Views) -> DataFrame:
    return v.price.select("date", F.col("ticker").alias("id"), "close").unionByName(v.curve.select("date", F.col("etf_id").alias("id"), "nav"), allowMissingColumns=True)


@query("u03_missing_sessions", "SELECT c.date, t.ticker FROM fx_calendar c CROSS JOIN (SELECT DISTINCT ticker FROM fx_price) t EXCEPT SELECT date, ticker FROM fx_price")
def u03(v: Views) -> DataFrame:
    return v.dense.select("date", "ticker").exceptAll(v.price.select("date", "ticker"))


@query("u04_soft_delete", """WITH a AS (SELECT DISTINCT ticker FROM fx_holding WHERE etf_id = '1-URGENT' AND date < DATE '1998-01-01'), b AS (SELECT DISTINCT ticker FROM fx_holding WHERE etf_id = '1-URGENT' AND date >= DATE '2001-07-01')
  SELECT ticker, true AS included, NULL::VARCHAR AS reason FROM b UNION ALL SELECT ticker, false, 'no_longer_selected' FROM a WHERE ticker NOT IN (SELECT ticker FROM b)""")
def u04(v: Views) -> DataFrame:
    own = v.holding.where("etf_id = '1-URGENT'")
    return R.soft_delete(own.where("date < date'1998-01-01'").select("ticker").distinct(), own.where("date >= date'2001-07-01'").select("ticker").distinct(), ["ticker"], "no_longer_selected")


@query("u05_prepend_earlier", "SELECT etf_id, bar, 'old' AS origin FROM fx_bar WHERE bar < 30 UNION ALL SELECT etf_id, bar, 'new' FROM fx_bar WHERE bar >= 30")
def u05(v: Views) -> DataFrame:
    new = v.bar.where("bar >= 30").select("etf_id", "bar", F.lit("new").alias("origin"))
    least = new.groupBy("etf_id").agg(F.min("bar").alias("least"))
    old = v.bar.where("bar < 45").join(least, "etf_id", "left").where("least is null or bar < least").select("etf_id", "bar", F.lit("old").alias("origin"))
    return old.unionByName(new)


@query("u06_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def u06(v: Views) -> DataFrame:
    return R.duplicates(v.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("u07_distinct_dimension", "SELECT DISTINCT market, main_industry FROM fx_master")
def u07(v: Views) -> DataFrame:
    return v.master.select("market", "main_industry").distinct()


@query("u08_keep_latest_stamp", "SELECT ticker, period_end, row_no, r103 FROM (SELECT *, rank() OVER (PARTITION BY ticker, period_end ORDER BY available DESC, revision_date DESC NULLS LAST, row_no DESC) AS n FROM fx_financial) WHERE n = 1")
def u08(v: Views) -> DataFrame:
    rows = v.financial.withColumn("n", F.rank().over(Window.partitionBy("ticker", "period_end").orderBy(F.desc("available"), F.desc_nulls_last("revision_date"), F.desc("row_no")))).where("n = 1")
    return R.require_unique(rows, ["ticker", "period_end"], "latest rows").select("ticker", "period_end", "row_no", "r103")


@query("s02_date_window_strings", "SELECT count(*) AS n, min(d) AS low, max(d) AS high FROM fx_orders WHERE d BETWEEN DATE '1996-02-01' AND DATE '1996-02-29'")
def s02(v: Views) -> DataFrame:
    text = v.orders.withColumn("d", F.date_format("d", "yyyy-MM-dd"))
    return text.where(F.col("d").cast("date").between("1996-02-01", "1996-02-29")).agg(F.count("*").alias("n"), F.min(F.to_date("d")).alias("low"), F.max(F.to_date("d")).alias("high"))


@query("s04_row_identity", "SELECT ticker, period, sha256(ticker || '|' || strftime(period, '%Y-%m-%d') || '|' || row_id) AS row_hash FROM fx_sales")
def s04(v: Views) -> DataFrame:
    return v.sales.select("ticker", "period", F.sha2(F.concat_ws("|", "ticker", F.date_format("period", "yyyy-MM-dd"), "row_id"), 256).alias("row_hash"))


@query("s14_suffix_per_key", "WITH h AS (SELECT ticker, max(available) - 100 AS horizon FROM fx_sales GROUP BY 1) SELECT p.date, p.ticker FROM fx_price p JOIN h ON h.ticker = p.ticker AND p.date >= h.horizon")
def s14(v: Views) -> DataFrame:
    h = v.sales.groupBy("ticker").agg(F.date_sub(F.max("available"), 100).alias("horizon"))
    return v.price.join(h, "ticker").where("date >= horizon").select("date", "ticker")


