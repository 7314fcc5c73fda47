"""Composite queries: point in time, corporate actions, market state, universes, portfolios, bars, labels, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold import lab
from chronofold.operators import bars as B
from chronofold.operators import corporate, labels, market, pit, structure, validators
from chronofold.operators import portfolio as P
from chronofold.operators import relational as R
from chronofold.sources import extraction

from .catalog import query
from .views import Views, number

FORMATION_SQL = "SELECT max(date) AS formation_date FROM fx_calendar GROUP BY month"


def formations(v: Views) -> DataFrame:
    return v.calendar.groupBy("month").agg(F.max("date").alias("formation_date")).select("formation_date")


@query("p01_normalize_family", "SELECT CAST(d AS DATE) AS date, ticker, CAST(price AS DOUBLE) AS price, CASE WHEN trim(CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE etf_id END) = '' THEN true ELSE false END AS is_trading_day FROM fx_orders")
def p01(v: Views) -> DataFrame:
    raw = v.orders.select(F.date_format("d", "yyyy-MM-dd").alias("zdate"), "ticker", F.col("price").cast("string").alias("amt"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("etf_id")).alias("date_rmk"))
    return extraction.normalize(raw, "trading_calendar").select("date", "ticker", F.col("amt").try_cast("double").alias("price"), "is_trading_day")


@query("p02_select_latest", "SELECT ticker, period, revision, r18 FROM (SELECT *, rank() OVER (PARTITION BY ticker, period ORDER BY available DESC, revision DESC) AS n FROM fx_sales WHERE available <= DATE '1999-12-31') WHERE n = 1")
def p02(v: Views) -> DataFrame:
    return pit.select_latest(v.sales, ["ticker", "period"], "available", "revision", F.lit("1999-12-31").cast("date")).select("ticker", "period", "revision", "r18")


@query("p03_snapshot_grid", f"SELECT formation_date, ticker, period, r18 FROM (SELECT f.formation_date, s.*, row_number() OVER (PARTITION BY f.formation_date, s.ticker ORDER BY s.period DESC, s.available DESC) AS n FROM ({FORMATION_SQL}) f JOIN fx_sales s ON s.available <= f.formation_date) WHERE n = 1")
def p03(v: Views) -> DataFrame:
    return pit.snapshots(v.sales, formations(v), "formation_date", ["ticker"], "available", [F.desc("period"), F.desc("available")]).select("formation_date", "ticker", "period", "r18")


@query("p04_state_updates", f"SELECT formation_date, ticker, period, r18 FROM (SELECT *, row_number() OVER (PARTITION BY formation_date, ticker ORDER BY period DESC, available DESC) AS n FROM fx_sales s ASOF JOIN ({FORMATION_SQL}) f ON s.available <= f.formation_date) WHERE n = 1")
def p04(v: Views) -> DataFrame:
    return pit.state_updates(v.sales, formations(v), "formation_date", ["ticker"], "available", [F.desc("period"), F.desc("available")]).select("formation_date", "ticker", "period", "r18")


SALES_PICK = f"""SELECT formation_date, ticker, r18, age FROM (SELECT f.formation_date, s.ticker, s.r18, s.age, row_number() OVER (PARTITION BY f.formation_date, s.ticker ORDER BY s.period DESC, s.available DESC, s.row_id DESC) AS n FROM
  (SELECT s.*, f.formation_date AS fd, (year(f.formation_date) * 12 + month(f.formation_date)) - (year(period) * 12 + month(period)) AS age FROM fx_sales s JOIN ({FORMATION_SQL}) f ON s.available <= f.formation_date) s JOIN ({FORMATION_SQL}) f ON f.formation_date = s.fd WHERE s.age BETWEEN 0 AND 2) WHERE n = 1"""


@query("p05_monthly_sales_pick", SALES_PICK)
def p05(v: Views) -> DataFrame:
    return pit.pick_sales(v.sales, formations(v)).select("formation_date", "ticker", "r18", F.col("age").cast("long").alias("age"))


ROE_PICK = f"""SELECT formation_date, ticker, r103 FROM (SELECT f.formation_date, x.ticker, x.r103, row_number() OVER (PARTITION BY f.formation_date, x.ticker ORDER BY x.period_end DESC, x.available DESC, x.revision_date DESC NULLS LAST, x.row_no DESC) AS n
  FROM fx_financial x JOIN ({FORMATION_SQL}) f ON x.available <= f.formation_date AND (x.revision_date IS NULL OR x.revision_date <= f.formation_date) WHERE x.r103 > 0 AND f.formation_date - x.available BETWEEN 0 AND 180) WHERE n = 1"""


@query("p06_fundamental_pick", ROE_PICK)
def p06(v: Views) -> DataFrame:
    return pit.pick_fundamentals(v.financial, formations(v)).select("formation_date", "ticker", "r103")


@query("p07_conflict_collapse", "SELECT ticker, period_end, available, CASE WHEN count(DISTINCT r103) = 1 THEN max(r103) END AS r103, count(DISTINCT r103) > 1 AS conflict, arg_min(row_no, row_no) AS row_no FROM fx_financial GROUP BY 1, 2, 3")
def p07(v: Views) -> DataFrame:
    n = F.count_distinct("r103")
    return v.financial.groupBy("ticker", "period_end", "available").agg(F.when(n == 1, F.max("r103")).alias("r103"), (n > 1).alias("conflict"), F.min("row_no").alias("row_no"))


@query("p08_listing_market", """SELECT ticker, CASE WHEN tse IS NULL AND otc IS NULL THEN 'EMERGING' WHEN otc IS NULL OR tse > otc THEN 'TSE' ELSE 'OTC' END AS market FROM
  (SELECT ticker, CASE WHEN CAST(ticker AS INTEGER) % 3 <> 1 THEN list_date END AS tse, CASE WHEN CAST(ticker AS INTEGER) % 2 = 0 THEN list_date + 30 END AS otc FROM fx_master)""")
def p08(v: Views) -> DataFrame:
    rows = v.master.select("ticker", F.when(number("ticker") % 3 != 1, F.col("list_date")).alias("tse"), F.when(number("ticker") % 2 == 0, F.date_add("list_date", 30)).alias("otc"))
    return rows.select("ticker", market.listing_market(F.col("tse"), F.col("otc")).alias("market"))


@query("p09_held_only", "SELECT p.date, p.ticker, p.close FROM fx_price p WHERE EXISTS (SELECT 1 FROM fx_holding h WHERE h.date = p.date AND h.ticker = p.ticker)")
def p09(v: Views) -> DataFrame:
    return v.price.join(v.holding, ["date", "ticker"], "left_semi").select("date", "ticker", "close")


WIDE_SQL = """SELECT CAST(1101 + p_partkey % 40 AS VARCHAR) AS ticker, p_partkey AS row_no, CASE WHEN p_partkey % 2 = 0 THEN DATE '1996-01-01' + CAST(p_partkey % 1500 AS INTEGER) END AS q1_date, 1.0 + p_size % 5 AS q1_cash,
  CASE WHEN p_partkey % 5 = 0 THEN DATE '1997-01-01' + CAST(p_partkey % 900 AS INTEGER) END AS q2_date, 2.0 AS q2_cash, CASE WHEN p_partkey % 7 = 0 THEN DATE '1998-03-02' + CAST(p_partkey % 700 AS INTEGER) END AS stock_date, 0.5 * (p_size % 4) AS stock_value FROM part"""


def wide(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    day = lambda first, span: F.date_add(F.lit(first).cast("date"), (k % span).cast("int"))
    none = F.lit(None)
    return v.table("part").select((1101 + k % 40).cast("string").alias("ticker"), k.alias("row_no"), F.when(k % 2 == 0, day("1996-01-01", 1500)).alias("q1_date"), (1.0 + F.col("p_size") % 5).alias("q1_cash"), F.when(k % 5 == 0, day("1997-01-01", 900)).alias("q2_date"), F.lit(2.0).alias("q2_cash"), none.cast("date").alias("q3_date"), none.cast("double").alias("q3_cash"), none.cast("date").alias("q4_date"), none.cast("double").alias("q4_cash"), F.when(k % 7 == 0, day("1998-03-02", 700)).alias("stock_date"), (0.5 * (F.col("p_size") % 4)).alias("stock_value"))


DIVIDEND_SQL = f"""SELECT ticker, ex_date, kind, cash, ratio FROM (SELECT *, row_number() OVER (PARTITION BY ticker, ex_date, kind ORDER BY row_no DESC, quarter DESC) AS n FROM (
  SELECT ticker, row_no, 1 AS quarter, q1_date AS ex_date, 'cash' AS kind, CAST(q1_cash AS DOUBLE) AS cash, CAST(0 AS DOUBLE) AS ratio FROM ({WIDE_SQL}) UNION ALL SELECT ticker, row_no, 2, q2_date, 'cash', CAST(q2_cash AS DOUBLE), 0 FROM ({WIDE_SQL})
  UNION ALL SELECT ticker, row_no, 0, stock_date, 'stock', 0, CAST(stock_value AS DOUBLE) / 10 FROM ({WIDE_SQL})) WHERE ex_date IS NOT NULL AND (cash > 0 OR ratio > 0)) WHERE n = 1"""


# q1 and q2 can name the same date in one row; the last quarter wins.
@query("q01_dividend_events", f"SELECT ticker, ex_date, kind, cash, ratio FROM ({DIVIDEND_SQL})")
def q01(v: Views) -> DataFrame:
    return corporate.dividend_events(wide(v)).select("ticker", "ex_date", "kind", "cash", "ratio")


CAPITAL_SQL = """SELECT CAST(1101 + p_partkey % 40 AS VARCHAR) AS ticker, DATE '1996-06-03' + CAST(p_partkey % 2000 AS INTEGER) AS date, CASE WHEN p_partkey % 9 = 0 THEN 10.0 * (1 + p_size % 5) END AS reduce_pct, CASE WHEN p_partkey % 11 = 0 THEN 2.0 END AS split_new,
  CASE WHEN p_partkey % 11 = 0 THEN 1.0 END AS split_old, CASE WHEN p_partkey % 13 = 0 THEN p_retailprice END AS last_close, CASE WHEN p_partkey % 13 = 0 THEN p_retailprice - 100 END AS reference FROM part"""


def capital_rows(v: Views) -> DataFrame:
    """Every row of part; the days are folded, as the calendar does not grow with the keys."""
    k = F.col("p_partkey")
    return v.table("part").select((1101 + k % 40).cast("string").alias("ticker"), F.date_add(F.lit("1996-06-03").cast("date"), (k % 2000).cast("int")).alias("date"), F.when(k % 9 == 0, 10.0 * (1 + F.col("p_size") % 5)).alias("reduce_pct"), F.when(k % 11 == 0, 2.0).alias("split_new"), F.when(k % 11 == 0, 1.0).alias("split_old"), F.when(k % 13 == 0, F.col("p_retailprice")).alias("last_close"), F.when(k % 13 == 0, F.col("p_retailprice") - 100).alias("reference"))


CAPITAL_EVENTS = f"""SELECT ticker, date, 'reduction' AS kind, CAST(1 - reduce_pct / 100 AS DOUBLE) AS factor FROM ({CAPITAL_SQL}) WHERE reduce_pct > 0 UNION ALL SELECT ticker, date, 'split', CAST(split_new AS DOUBLE) / split_old FROM ({CAPITAL_SQL}) WHERE split_new > 0
  UNION ALL SELECT ticker, date, 'price', last_close / reference FROM ({CAPITAL_SQL}) WHERE last_close > 0 AND reference > 0"""


@query("q02_capital_actions", f"SELECT ticker, date, kind, round(factor, 9) AS factor FROM ({CAPITAL_EVENTS})")
def q02(v: Views) -> DataFrame:
    return corporate.capital_actions(capital_rows(v)).select("ticker", "date", "kind", F.round("factor", 9).alias("factor"))


@query("q03_unified_actions", f"SELECT ticker, ex_date AS date, kind, cash, round(1 + ratio, 9) AS factor FROM ({DIVIDEND_SQL}) UNION ALL SELECT ticker, date, kind, 0, round(factor, 9) FROM ({CAPITAL_EVENTS})")
def q03(v: Views) -> DataFrame:
    return corporate.corporate_actions(corporate.dividend_events(wide(v)), corporate.capital_actions(capital_rows(v))).withColumn("factor", F.round("factor", 9))


def price_actions(v: Views) -> DataFrame:
    """Every dividend and capital action, with the cash of sales."""
    actions = corporate.corporate_actions(corporate.dividend_events(wide(v)), corporate.capital_actions(capital_rows(v))).select("ticker", "date", "cash", "factor")
    cash = v.sales.where("revision = 2").select("ticker", F.col("period").alias("date"), F.lit(50.0).alias("cash"), F.lit(1.0).alias("factor"))
    return actions.unionByName(cash)


FACTOR_SQL = f"""WITH a AS (SELECT ticker, ex_date AS date, cash, 1 + ratio AS factor FROM ({DIVIDEND_SQL}) UNION ALL SELECT ticker, date, 0, factor FROM ({CAPITAL_EVENTS}) UNION ALL SELECT ticker, period, 50.0, 1 FROM fx_sales WHERE revision = 2),
  m AS (SELECT a.ticker, p.date, sum(a.cash) AS cash, sum(ln(a.factor)) AS lf FROM a ASOF JOIN fx_price p ON p.ticker = a.ticker AND a.date <= p.date GROUP BY 1, 2),
  r AS (SELECT p.date, p.ticker, p.close, coalesce(m.lf, 0) AS lf, m.cash, lag(p.close) OVER (PARTITION BY p.ticker ORDER BY p.date) AS prev FROM fx_price p LEFT JOIN m ON m.ticker = p.ticker AND m.date = p.date),
  f AS (SELECT date, ticker, round(exp(sum(lf + CASE WHEN cash > 0 AND prev > cash THEN ln(prev / (prev - cash)) ELSE 0 END) OVER (PARTITION BY ticker ORDER BY date)), 6) AS factor FROM r)
  SELECT date, ticker, factor FROM f"""


@query("q04_adjusted_prices", FACTOR_SQL)
def q04(v: Views) -> DataFrame:
    return corporate.adjustment_factors(v.price, price_actions(v)).select("date", "ticker", F.round("factor", 6).alias("factor"))


@query("q06_price_validator", """SELECT count(*) AS rows, count(*) FILTER (WHERE (close IS NULL) <> (adj_close IS NULL)) AS null_mismatch, count(*) FILTER (WHERE abs(adj_close - close * factor) > greatest(1e-8, 1e-10 * abs(close * factor))) AS product_off,
  count(*) FILTER (WHERE NOT (low <= least(open, close) AND greatest(open, close) <= high)) AS disordered, count(*) FILTER (WHERE NOT factor > 0) AS bad_factor, count(*) FILTER (WHERE close <= 0) AS bad_close FROM
  (SELECT CASE WHEN session_idx % 7 = 0 THEN NULL ELSE close END AS close, adj_close, close AS open, close * 1.25 AS high, CASE WHEN session_idx % 5 = 0 THEN close * 1.5 ELSE close * 0.75 END AS low, CASE WHEN session_idx % 3 = 0 THEN 0 ELSE adj_close / close END AS factor FROM fx_dense WHERE close IS NOT NULL)""")
def q06(v: Views) -> DataFrame:
    k, close = F.col("session_idx"), F.col("close")
    rows = v.dense.where("close is not null").select("date", "ticker", F.when(k % 7 != 0, close).alias("close"), "adj_close", close.alias("open"), (close * 1.25).alias("high"), F.when(k % 5 == 0, close * 1.5).otherwise(close * 0.75).alias("low"), F.when(k % 3 == 0, 0.0).otherwise(F.col("adj_close") / close).alias("factor"))
    return corporate.price_violations(rows)


@query("q08_restart_dates", "SELECT ticker, min(date) AS start FROM (SELECT ticker, available AS date FROM fx_sales WHERE revision = 2 UNION ALL SELECT ticker, date FROM fx_price WHERE volume > 500) GROUP BY 1")
def q08(v: Views) -> DataFrame:
    return corporate.restart_dates(v.price.where("volume > 500"), v.sales.where("revision = 2").select("ticker", F.col("available").alias("date")))


STATE_SQL = """SELECT k.date, k.ticker, p.close, p.traded_value, CASE WHEN p.close IS NOT NULL AND a.s THEN 'price_suspended' WHEN p.close IS NOT NULL THEN 'price' WHEN a.s THEN 'suspended' WHEN a.s IS NOT NULL THEN 'attribute_only' ELSE 'no_rows' END AS reason
  FROM (SELECT c.date, m.ticker FROM fx_calendar c JOIN fx_master m ON m.list_date <= c.date AND (m.delist_date IS NULL OR c.date < m.delist_date) UNION SELECT date, ticker FROM fx_price) k LEFT JOIN fx_price p ON p.date = k.date AND p.ticker = k.ticker
  LEFT JOIN (SELECT date, ticker, (session_idx + CAST(ticker AS INTEGER)) % 11 = 0 AS s FROM fx_dense WHERE (session_idx + CAST(ticker AS INTEGER)) % 3 <> 1) a ON a.date = k.date AND a.ticker = k.ticker"""


@query("m01_daily_state", f"""SELECT date, ticker, close, traded_value, reason, CASE reason WHEN 'price' THEN 'TRADING' WHEN 'attribute_only' THEN 'MISSING' ELSE 'HALTED' END AS market_state,
  CASE reason WHEN 'price' THEN 'OBSERVED' WHEN 'price_suspended' THEN 'OBSERVED' WHEN 'attribute_only' THEN 'MISSING' ELSE 'ZERO_AUTHORIZED' END AS amount_state, CASE reason WHEN 'price' THEN true WHEN 'attribute_only' THEN NULL ELSE false END AS tradable, CASE WHEN close IS NOT NULL THEN traded_value WHEN reason <> 'attribute_only' THEN 0 END AS amount FROM ({STATE_SQL})""")
def m01(v: Views) -> DataFrame:
    mark = F.col("session_idx") + number("ticker")
    attributes = v.dense.where(mark % 3 != 1).select("date", "ticker", (mark % 11 == 0).alias("suspended"))
    return market.daily_state(v.calendar, v.master, v.price, attributes)


@query("m04_venue_mapping", "SELECT ticker, CASE market WHEN 'TSE' THEN 'TWSE' WHEN 'OTC' THEN 'TPEX' END AS venue FROM fx_master")
def m04(v: Views) -> DataFrame:
    return v.master.select("ticker", market.venue(F.concat(F.lit(" "), F.lower("market"))).alias("venue"))


CHECK = "SELECT '{0}' AS check, count(*) FILTER (WHERE {1}) AS violations FROM {2}"
STATE_CHECKS = {
    "state_pair": "(market_state, amount_state) NOT IN (('TRADING', 'OBSERVED'), ('HALTED', 'OBSERVED'), ('HALTED', 'ZERO_AUTHORIZED'), ('MISSING', 'MISSING'))",
    "tradable": "tradable IS DISTINCT FROM CASE market_state WHEN 'TRADING' THEN true WHEN 'HALTED' THEN false END",
    "amount": "CASE amount_state WHEN 'OBSERVED' THEN coalesce(traded_value < 0, true) WHEN 'ZERO_AUTHORIZED' THEN traded_value IS DISTINCT FROM 0 ELSE traded_value IS NOT NULL END",
    "price": "market_state = 'TRADING' AND coalesce(close <= 0, true)",
    "lifecycle": "m.ticker IS NULL OR date < list_date OR coalesce(date >= delist_date, false)",
    "repeated_key": "i > 1",
}
STATE_ROWS = "(SELECT *, row_number() OVER (PARTITION BY date, ticker) AS i FROM fx_state) s LEFT JOIN fx_master m ON m.ticker = s.ticker"


# The fixture's states break some of the rules, so that the counts show.
@query("m05_state_validator", " UNION ALL ".join(CHECK.format(name, rule, STATE_ROWS) for name, rule in STATE_CHECKS.items()))
def m05(v: Views) -> DataFrame:
    return validators.state_violations(v.state, v.master, "traded_value")


PANEL_SQL = """SELECT p.date, p.ticker, avg(p.traded_value) OVER (PARTITION BY p.ticker ORDER BY p.date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS adv20, CASE WHEN m.market IS NULL THEN g.effective_date ELSE c.effective_date END AS effective_date, m.list_date <= p.date AND (m.delist_date IS NULL OR p.date < m.delist_date) AS listed, p.market_cap, m.main_industry
  FROM fx_price p LEFT JOIN fx_master m ON m.ticker = p.ticker LEFT JOIN (SELECT date, lead(date) OVER (ORDER BY date) AS effective_date FROM fx_calendar) g ON g.date = p.date
  LEFT JOIN (SELECT date, market, lead(date) OVER (PARTITION BY market ORDER BY date) AS effective_date FROM (SELECT date, 'TSE' AS market FROM fx_calendar UNION ALL SELECT date, 'OTC' FROM fx_calendar WHERE session_idx % 9 <> 4)) c ON c.date = p.date AND c.market = m.market"""


def panel(v: Views) -> DataFrame:
    days = v.calendar.withColumn("market", F.explode(F.when(F.col("session_idx") % 9 == 4, F.array(F.lit("TSE"))).otherwise(F.array(F.lit("TSE"), F.lit("OTC")))))
    return market.security_panel(v.price, v.master, days)


@query("n01_latest_panel", f"SELECT ticker, round(adv20, 4) AS adv20, listed FROM ({PANEL_SQL}) WHERE date = (SELECT max(date) FROM fx_price)")
def n01(v: Views) -> DataFrame:
    last = v.price.agg(F.max("date").alias("last"))
    return panel(v).join(F.broadcast(last), F.col("date") == F.col("last")).select("ticker", F.round("adv20", 4).alias("adv20"), "listed")


@query("n02_historical_panel", f"SELECT date, ticker, round(adv20, 4) AS adv20, effective_date, listed FROM ({PANEL_SQL})")
def n02(v: Views) -> DataFrame:
    return panel(v).select("date", "ticker", F.round("adv20", 4).alias("adv20"), "effective_date", "listed")


@query("n03_universe_members", f"""SELECT effective_date AS date, 'liquid' AS universe, ticker, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY effective_date ORDER BY round(adv20, 4) DESC NULLS FIRST, ticker DESC) AS rank FROM ({PANEL_SQL}) WHERE effective_date IS NOT NULL AND listed AND adv20 >= 300000) WHERE rank <= 10
  UNION ALL SELECT effective_date, 'shipping', ticker, CAST(row_number() OVER (PARTITION BY effective_date ORDER BY ticker) AS INTEGER) FROM ({PANEL_SQL}) WHERE effective_date IS NOT NULL AND main_industry = 'shipping'""")
def n03(v: Views) -> DataFrame:
    specs = [market.UniverseSpec("liquid", "adv20", 10, (("listed", "eq", True), ("adv20", "gte", 300000.0))), market.UniverseSpec("shipping", None, None, (("main_industry", "eq", "shipping"),))]
    return market.universes(panel(v).withColumn("adv20", F.round("adv20", 4)), specs)


def market_of(v: Views) -> lab.Market:
    return lab.Market(v.calendar.select("date"), v.price, v.chip, v.master, v.state, v.sales, v.financial, v.index)


def candidates(v: Views) -> DataFrame:
    return lab.candidate_table(market_of(v))


SIGNAL_SQL = """SELECT date, ticker, close, market_cap, adv20, sum20, n20, turnover_20d, CASE WHEN base > 0 THEN v20 / base END AS volume_ratio, chip_20d, CASE WHEN a > 0 AND b > 0 THEN a / b - 1 END AS momentum_12_1,
  CASE WHEN nr >= 20 AND sd > 0 THEN sd * sqrt(252) END AS vol_60d, CASE WHEN nr = 60 AND sd > 0 THEN mr / sd * sqrt(252) END AS sharpe_60d, CASE WHEN nr = 60 AND md > 0 THEN mr / sqrt(md) * sqrt(252) END AS sortino_60d FROM
  (SELECT *, count(traded_value) OVER w20 AS n20, CASE WHEN count(traded_value) OVER w20 = 20 THEN avg(traded_value) OVER w20 END AS adv20, CASE WHEN count(traded_value) OVER w20 = 20 THEN sum(traded_value) OVER w20 END AS sum20,
    CASE WHEN count(turnover) OVER w20 = 20 THEN avg(turnover) OVER w20 END AS turnover_20d, CASE WHEN count(volume) OVER w20 = 20 THEN avg(volume) OVER w20 END AS v20, CASE WHEN count(volume) OVER far = 60 THEN avg(volume) OVER far END AS base,
    CASE WHEN count(flow) OVER w20 = 20 THEN sum(flow) OVER w20 END AS chip_20d, lag(adj_close, 21) OVER o AS a, lag(adj_close, 252) OVER o AS b, count(ret) OVER w60 AS nr, stddev_samp(ret) OVER w60 AS sd, avg(ret) OVER w60 AS mr, avg(pow(least(ret, 0), 2)) FILTER (WHERE ret IS NOT NULL) OVER w60 AS md
    FROM (SELECT d.*, c.qfii + c.fund + c.dlrp AS flow, d.adj_close / nullif(lag(d.adj_close) OVER (PARTITION BY d.ticker ORDER BY d.date), 0) - 1 AS ret FROM fx_dense d LEFT JOIN fx_chip c ON c.date = d.date AND c.ticker = d.ticker)
    WINDOW o AS (PARTITION BY ticker ORDER BY date), w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w60 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), far AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 79 PRECEDING AND 20 PRECEDING))"""


def _literal(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()


RULE_SQL = ", ".join(f"({', '.join(map(_literal, (r.etf_id, r.signal, r.ascending, r.by_market_cap, r.preferred, r.floor, r.adaptive, r.include, r.exclude)))})" for r in P.RULES)
#: All portfolios' audit: every candidate under every rule, the first reason against it, its rank, selection and weight.
AUDIT_SQL = f"""WITH x AS ({SIGNAL_SQL}), i AS (SELECT date, CASE WHEN count(*) OVER w = 20 THEN sum(traded_value) OVER w END AS total FROM fx_index WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  c AS (SELECT x.date AS formation_date, x.* EXCLUDE (date), sp.r18, rp.r103, x.sum20 / i.total AS ratio, m.list_date, m.delist_date, m.main_industry, s.market_state FROM x JOIN ({FORMATION_SQL}) f ON f.formation_date = x.date LEFT JOIN i ON i.date = x.date
    LEFT JOIN fx_master m ON m.ticker = x.ticker LEFT JOIN fx_state s ON s.date = x.date AND s.ticker = x.ticker LEFT JOIN ({SALES_PICK}) sp ON sp.formation_date = x.date AND sp.ticker = x.ticker LEFT JOIN ({ROE_PICK}) rp ON rp.formation_date = x.date AND rp.ticker = x.ticker),
  q AS (SELECT c.*, r.*, CASE r.signal {" ".join(f"WHEN '{n}' THEN c.{n}" for n in sorted({r.signal for r in P.RULES}))} END AS value FROM c CROSS JOIN (VALUES {RULE_SQL}) r(etf_id, signal, rising, by_cap, preferred, floor_, adaptive, include, exclude)),
  r0 AS (SELECT *, CASE WHEN NOT regexp_full_match(ticker, '[1-9][0-9]{{3}}') THEN 'not_common' WHEN list_date IS NULL THEN 'missing_master' WHEN list_date > formation_date THEN 'not_listed' WHEN delist_date <= formation_date THEN 'delisted'
    WHEN close IS NULL OR close <= 0 THEN 'invalid_close' WHEN market_state = 'HALTED' THEN 'halted' WHEN market_state IS NULL OR market_state = 'MISSING' THEN 'missing_state' WHEN include IS NOT NULL AND main_industry IS DISTINCT FROM include THEN 'industry_not_included'
    WHEN main_industry = exclude THEN 'industry_excluded' WHEN value IS NULL THEN 'no_signal' WHEN n20 <> 20 THEN 'incomplete_window' WHEN ratio IS NULL OR ratio < 0 THEN 'invalid_ratio' END AS why FROM q),
  t AS (SELECT *, CASE WHEN adaptive AND count(*) FILTER (WHERE why IS NULL AND ratio >= preferred) OVER (PARTITION BY formation_date, etf_id) < 5 THEN floor_ ELSE preferred END AS threshold FROM r0),
  u AS (SELECT *, CASE WHEN why IS NULL AND ratio < threshold THEN 'illiquid' ELSE why END AS reason FROM t),
  k AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY formation_date, etf_id ORDER BY reason IS NOT NULL, CASE WHEN rising THEN value ELSE -value END NULLS LAST, adv20 DESC NULLS LAST, market_cap DESC NULLS LAST, ticker) END AS rank FROM u)
  SELECT formation_date, etf_id, ticker, reason, CAST(rank AS INTEGER) AS rank, coalesce(rank <= 10, false) AS selected,
    round(CASE WHEN rank <= 10 THEN CASE WHEN by_cap THEN market_cap / sum(market_cap) FILTER (WHERE rank <= 10) OVER (PARTITION BY formation_date, etf_id) ELSE 1.0 / count(*) FILTER (WHERE rank <= 10) OVER (PARTITION BY formation_date, etf_id) END END, 9) AS weight FROM k"""


@query("x01_all_portfolio_targets", f"SELECT formation_date, etf_id, ticker, rank, weight FROM ({AUDIT_SQL}) WHERE selected")
def x01(v: Views) -> DataFrame:
    return P.candidate_audit(candidates(v)).where("selected").select("formation_date", "etf_id", "ticker", "rank", F.round("weight", 9).alias("weight"))


@query("x02_candidate_audit", AUDIT_SQL)
def x02(v: Views) -> DataFrame:
    return P.candidate_audit(candidates(v)).select("formation_date", "etf_id", "ticker", "reason", "rank", "selected", F.round("weight", 9).alias("weight"))


@query("x03_weights", "SELECT date, ticker, round(market_cap / sum(market_cap) OVER (PARTITION BY date), 9) AS weight, round(1.0 / count(*) OVER (PARTITION BY date), 9) AS equal FROM fx_price")
def x03(v: Views) -> DataFrame:
    w = Window.partitionBy("date")
    return v.price.select("date", "ticker", F.round(F.col("market_cap") / F.sum("market_cap").over(w), 9).alias("weight"), F.round(1.0 / F.count("*").over(w), 9).alias("equal"))


@query("x04_trade_costs", "SELECT o_orderkey, CAST(greatest(1, round(price * 0.001425, 0)) AS BIGINT) AS buy_fee, CAST(greatest(1, round(price * 0.001425, 0)) + round(price * 0.003, 0) AS BIGINT) AS sell_fee FROM fx_orders")
def x04(v: Views) -> DataFrame:
    return v.orders.select("o_orderkey", P.fee(F.col("price"), F.lit(False)).alias("buy_fee"), P.fee(F.col("price"), F.lit(True)).alias("sell_fee"))


@query("x05_schedule", "SELECT c.date, p.ticker, CAST(100 + sign(CAST(p.volume AS BIGINT) - 100) * floor(abs(CAST(p.volume AS BIGINT) - 100) * c.k / CAST(c.n AS DOUBLE) + 0.5) AS BIGINT) AS shares FROM fx_price p JOIN fx_calendar c ON c.date = p.date")
def x05(v: Views) -> DataFrame:
    return v.price.join(F.broadcast(v.calendar), "date").select("date", "ticker", P.scheduled(F.lit(100), F.col("volume").cast("long"), F.col("k"), F.col("n")).alias("shares"))


def simulated(v: Views) -> DataFrame:
    """Ledger of all portfolios over the fixture market; targets of a formation apply in the next month."""
    return lab.run_all(market_of(v)).ledger


@query("x07_portfolio_simulation")
def x07(v: Views) -> DataFrame:
    return simulated(v)


@query("x10_traded_amount", """WITH d AS (SELECT date, lag(date) OVER (ORDER BY date) AS prior FROM fx_calendar) SELECT d.date, h.etf_id, round(sum(CASE WHEN s.amount_state = 'OBSERVED' THEN h.w * s.traded_value END), 4) AS etf_amount, count(*) FILTER (WHERE s.amount_state IS DISTINCT FROM 'OBSERVED') AS missing_count
  FROM d JOIN fx_holding h ON h.date = d.prior LEFT JOIN fx_state s ON s.date = d.date AND s.ticker = h.ticker GROUP BY 1, 2""")
def x10(v: Views) -> DataFrame:
    days = v.calendar.select("date", F.lag("date").over(Window.orderBy("date")).alias("prior"))
    return P.traded_amount(v.holding, v.state, days).withColumn("etf_amount", F.round("etf_amount", 4))


@query("x12_selection_diagnostics", f"SELECT formation_date, etf_id, count(*) FILTER (WHERE selected) AS selected, CASE WHEN count(*) FILTER (WHERE selected) = 0 THEN 'none' WHEN count(*) FILTER (WHERE selected) < 5 THEN 'short' ELSE 'ok' END AS status FROM ({AUDIT_SQL}) GROUP BY 1, 2")
def x12(v: Views) -> DataFrame:
    n = F.count_if("selected")
    return x02(v).groupBy("formation_date", "etf_id").agg(n.alias("selected"), F.when(n == 0, "none").when(n < P.LEAST, "short").otherwise("ok").alias("status"))


@query("x13_ledger_identities")
def x13(v: Views) -> DataFrame:
    """Counts of violated identities of the simulated ledgers; every count is zero."""
    rows = simulated(v)
    held = rows.where("kind = 'holding'").groupBy("etf_id", "date").agg(F.sum(F.col("shares") * F.col("price")).alias("value"), F.sum("shares").alias("n"))
    daily = rows.where("kind = 'daily'").select("etf_id", "date", "cash", "assets", "nav", F.col("shares").alias("total")).join(held, ["etf_id", "date"], "left")
    value = F.coalesce("value", F.lit(0.0))
    return daily.groupBy("etf_id").agg(F.count_if(F.abs(F.col("assets") - F.col("cash") - value) > 0.01).alias("assets_off"), F.count_if(F.col("cash") < 0).alias("negative_cash"), F.count_if(F.abs(F.col("nav") - F.col("assets") / 1e6) > 1e-6).alias("nav_off"), F.count_if(F.col("total") != F.coalesce("n", F.lit(0))).alias("shares_off"), F.count("*").alias("days"))


FOLD = "SELECT etf_id, date, i, etf_amount, nav, CASE WHEN count(etf_amount) OVER w >= 20 THEN 2.0 * quantile_cont(etf_amount, 0.5) OVER w END AS t FROM fx_curve WINDOW w AS (PARTITION BY etf_id ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
BARS_SQL = f"""WITH RECURSIVE days AS MATERIALIZED ({FOLD}), walk(etf_id, i, is_open, total, lim, bar, closes) AS (
  SELECT etf_id, 0::BIGINT, false, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT, false FROM (SELECT DISTINCT etf_id FROM days)
  UNION ALL SELECT w.etf_id, d.i, CASE WHEN NOT w.is_open AND d.t IS NULL THEN false ELSE (CASE WHEN w.is_open THEN w.total ELSE 0 END) + d.etf_amount < (CASE WHEN w.is_open THEN w.lim ELSE d.t END) END,
    CASE WHEN NOT w.is_open AND d.t IS NULL THEN 0 ELSE (CASE WHEN w.is_open THEN w.total ELSE 0 END) + d.etf_amount END, CASE WHEN w.is_open THEN w.lim ELSE coalesce(d.t, 0) END,
    w.bar + CASE WHEN w.closes THEN 1 ELSE 0 END, NOT (NOT w.is_open AND d.t IS NULL) AND (CASE WHEN w.is_open THEN w.total ELSE 0 END) + d.etf_amount >= (CASE WHEN w.is_open THEN w.lim ELSE d.t END)
  FROM walk w JOIN days d ON d.etf_id = w.etf_id AND d.i = w.i + 1),
  member AS (SELECT w.etf_id, w.bar, d.date, d.nav, d.etf_amount, w.closes FROM walk w JOIN days d ON d.etf_id = w.etf_id AND d.i = w.i WHERE w.is_open OR w.closes),
  closed AS (SELECT etf_id, bar FROM member GROUP BY 1, 2 HAVING bool_or(closes))
  SELECT m.etf_id, m.bar, min(m.date) AS start_date, max(m.date) AS end_date, arg_min(m.nav, m.date) AS open, max(m.nav) AS high, min(m.nav) AS low, arg_max(m.nav, m.date) AS close, count(*) AS days, round(sum(m.etf_amount), 2) AS amount FROM member m JOIN closed c ON c.etf_id = m.etf_id AND c.bar = m.bar GROUP BY 1, 2"""


@query("d02_dollar_bars", BARS_SQL)
def d02(v: Views) -> DataFrame:
    return B.bar_table(B.assign_bars(v.curve, 2.0)).select("etf_id", "bar", "start_date", "end_date", "open", "high", "low", "close", "days", F.round("amount", 2).alias("amount"))


@query("d01_bar_calibration")
def d01(v: Views) -> DataFrame:
    return B.calibrate(v.curve, tuple(k / 20 for k in range(1, 20)))


@query("d03_bar_returns", "SELECT etf_id, bar, round(ln(close) - ln(lag(close) OVER (PARTITION BY etf_id ORDER BY bar)), 9) AS log_return, round(close / open - 1, 9) AS change FROM fx_bar")
def d03(v: Views) -> DataFrame:
    return v.bar.select("etf_id", "bar", F.round(F.ln("close") - F.ln(F.lag("close").over(Window.partitionBy("etf_id").orderBy("bar"))), 9).alias("log_return"), F.round(F.col("close") / F.col("open") - 1, 9).alias("change"))


@query("d04_stitched_bars", "SELECT etf_id, bar, round(ln(close) - ln(lag(close) OVER (PARTITION BY etf_id ORDER BY bar)), 9) AS log_return FROM fx_bar")
def d04(v: Views) -> DataFrame:
    live = v.bar.where("bar >= 40").withColumn("bar", F.col("bar") - 40)
    return B.stitch(v.bar.where("bar < 40"), live).select("etf_id", "bar", F.round("log_return", 9).alias("log_return"))


@query("d05_open_tails")
def d05(v: Views) -> DataFrame:
    return B.open_tails(B.assign_bars(v.curve, 2.0))


@query("r01_ffd_weights", "WITH RECURSIVE w(k, x) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT k + 1, -x * (0.4 - (k + 1) + 1) / (k + 1) FROM w WHERE abs(-x * (0.4 - (k + 1) + 1) / (k + 1)) >= 0.001) SELECT CAST(k AS INTEGER) AS k, round(x, 12) AS weight FROM w")
def r01(v: Views) -> DataFrame:
    return v.spark.createDataFrame([(k, round(float(x), 12)) for k, x in enumerate(structure.ffd_weights(0.4, 0.001))], "k int, weight double")


@query("r02_fractional_difference", """WITH RECURSIVE w(k, x) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT k + 1, -x * (0.4 - (k + 1) + 1) / (k + 1) FROM w WHERE abs(-x * (0.4 - (k + 1) + 1) / (k + 1)) >= 0.001), n AS (SELECT count(*) AS n FROM w)
  SELECT c.etf_id, c.date, CASE WHEN c.i >= (SELECT n FROM n) THEN round(sum(w.x * ln(p.nav)), 9) END AS ffd FROM fx_curve c JOIN w ON true LEFT JOIN fx_curve p ON p.etf_id = c.etf_id AND p.i = c.i - w.k GROUP BY c.etf_id, c.date, c.i""")
def r02(v: Views) -> DataFrame:
    rows = v.curve.select("etf_id", "date", F.ln("nav").alias("y"))
    return structure.fractional_difference(rows, "etf_id", "date", "y", 0.4, 0.001).select("etf_id", "date", F.round("ffd", 9).alias("ffd"))


@query("r03_order_search")
def r03(v: Views) -> DataFrame:
    return structure.choose_d(v.curve.select("etf_id", "i", F.ln("nav").alias("y")), "etf_id", "i", "y", tolerance=1e-3)


@query("r06_structural_breaks")
def r06(v: Views) -> DataFrame:
    return structure.structural_breaks(v.bar.select("etf_id", "bar", F.ln("close").alias("y")), "etf_id", "bar", "y")


@query("w27_ewma_volatility", """WITH RECURSIVE x AS MATERIALIZED (SELECT etf_id, bar, ln(close) - ln(lag(close) OVER (PARTITION BY etf_id ORDER BY bar)) AS x FROM fx_bar),
  e(etf_id, bar, n, m, c, w2) AS (SELECT etf_id, bar, 1, x, 0.0::DOUBLE, 1.0::DOUBLE FROM x WHERE bar = 1 UNION ALL
    SELECT e.etf_id, x.bar, e.n + 1, e.m * 59 / 61.0 + x.x * 2 / 61.0, (59 / 61.0) * (e.c + pow(e.m - (e.m * 59 / 61.0 + x.x * 2 / 61.0), 2)) + (2 / 61.0) * pow(x.x - (e.m * 59 / 61.0 + x.x * 2 / 61.0), 2), pow(59 / 61.0, 2) * e.w2 + pow(2 / 61.0, 2) FROM e JOIN x ON x.etf_id = e.etf_id AND x.bar = e.bar + 1)
  SELECT x.etf_id, x.bar, CASE WHEN e.n >= 20 THEN round(sqrt(e.c / (1 - e.w2)), 9) END AS sigma FROM x LEFT JOIN e ON e.etf_id = x.etf_id AND e.bar = x.bar""")
def w27(v: Views) -> DataFrame:
    rows = v.bar.select("etf_id", "bar", (F.ln("close") - F.ln(F.lag("close").over(Window.partitionBy("etf_id").orderBy("bar")))).alias("x"))
    return structure.ewm_volatility(rows, "etf_id", "bar", "x").select("etf_id", "bar", F.round("sigma", 9).alias("sigma"))


@query("w19_ewma_amount_z", """WITH RECURSIVE e(etf_id, bar, n, m, c, w2) AS (SELECT etf_id, bar, 1, amount, 0.0::DOUBLE, 1.0::DOUBLE FROM fx_bar WHERE bar = 0 UNION ALL
    SELECT e.etf_id, x.bar, e.n + 1, e.m * 19 / 21.0 + x.amount * 2 / 21.0, (19 / 21.0) * (e.c + pow(e.m - (e.m * 19 / 21.0 + x.amount * 2 / 21.0), 2)) + (2 / 21.0) * pow(x.amount - (e.m * 19 / 21.0 + x.amount * 2 / 21.0), 2), pow(19 / 21.0, 2) * e.w2 + pow(2 / 21.0, 2) FROM e JOIN fx_bar x ON x.etf_id = e.etf_id AND x.bar = e.bar + 1)
  SELECT x.etf_id, x.bar, CASE WHEN e.n >= 20 AND e.c > 0 THEN round((x.amount - e.m) / sqrt(e.c / (1 - e.w2)), 6) END AS z FROM fx_bar x LEFT JOIN e ON e.etf_id = x.etf_id AND e.bar = x.bar - 1""")
def w19(v: Views) -> DataFrame:
    return structure.ewm_z(v.bar.select("etf_id", "bar", "amount"), "etf_id", "bar", "amount").select("etf_id", "bar", F.round("z", 6).alias("z"))


EVENTS = "SELECT etf_id, bar, end_date AS t0, close AS entry, 0.05 + 0.001 * (bar % 20) AS sigma, lead(end_date, 6) OVER (PARTITION BY etf_id ORDER BY bar) AS vertical FROM fx_bar"
LABEL_SQL = f"""SELECT e.etf_id, e.bar, e.t0, CASE WHEN e.vertical IS NULL THEN NULL WHEN m.touch IS NOT NULL THEN m.touch ELSE e.vertical END AS t1, CASE WHEN e.vertical IS NULL THEN NULL WHEN m.touch IS NOT NULL THEN m.side ELSE CAST(sign(m.last) AS INTEGER) END AS label,
  CASE WHEN e.vertical IS NULL THEN 'unresolved_tail' WHEN m.side = 1 THEN 'upper' WHEN m.side = -1 THEN 'lower' ELSE 'vertical' END AS reason FROM ({EVENTS}) e LEFT JOIN
  (SELECT etf_id, bar, min(date) FILTER (WHERE side <> 0) AS touch, CAST(arg_min(side, date) FILTER (WHERE side <> 0) AS INTEGER) AS side, arg_max(mv, date) AS last FROM (SELECT e.etf_id, e.bar, c.date, ln(c.nav / e.entry) AS mv, CASE WHEN ln(c.nav / e.entry) >= 2 * e.sigma THEN 1 WHEN ln(c.nav / e.entry) <= -2 * e.sigma THEN -1 ELSE 0 END AS side
    FROM ({EVENTS}) e JOIN fx_curve c ON c.etf_id = e.etf_id AND c.date > e.t0 AND c.date <= e.vertical) GROUP BY 1, 2) m ON m.etf_id = e.etf_id AND m.bar = e.bar"""


def labelled(v: Views) -> DataFrame:
    events = v.bar.select("etf_id", "bar", "end_date", "close", (0.05 + 0.001 * (F.col("bar") % 20)).alias("sigma"))
    return labels.triple_barrier(events, v.curve.select("etf_id", "date", "nav"), 2.0, 6)


@query("l01_triple_barrier", LABEL_SQL)
def l01(v: Views) -> DataFrame:
    return labelled(v)


@query("l02_split_eligibility", f"SELECT etf_id, bar, CASE WHEN t1 IS NULL THEN 'unresolved' WHEN t0 <= DATE '1998-12-31' AND t1 > DATE '1998-12-31' THEN 'crossing' WHEN t0 <= DATE '1998-12-31' THEN 'train' WHEN t0 <= DATE '2000-06-30' AND t1 > DATE '2000-06-30' THEN 'crossing' WHEN t0 <= DATE '2000-06-30' THEN 'validation' ELSE 'test' END AS split FROM ({LABEL_SQL})")
def l02(v: Views) -> DataFrame:
    return labelled(v).select("etf_id", "bar", labels.split_of(F.col("t0"), F.col("t1"), "1998-12-31", "2000-06-30").alias("split"))


UNIQUE_SQL = f"""WITH s AS (SELECT e.etf_id, e.bar, c.date FROM ({LABEL_SQL}) e JOIN fx_curve c ON c.etf_id = e.etf_id AND c.date >= e.t0 AND c.date <= e.t1), n AS (SELECT etf_id, date, count(*) AS c FROM s GROUP BY 1, 2)
  SELECT s.etf_id, s.bar, arg_min(n.c, s.date) AS at_start, max(n.c) AS most, round(avg(1.0 / n.c), 9) AS uniqueness FROM s JOIN n ON n.etf_id = s.etf_id AND n.date = s.date GROUP BY 1, 2"""


@query("l03_uniqueness", UNIQUE_SQL)
def l03(v: Views) -> DataFrame:
    return labels.uniqueness(labelled(v), v.curve.select("etf_id", "date")).withColumn("uniqueness", F.round("uniqueness", 9))


@query("l06_barrier_diagnostics", f"SELECT e.etf_id, e.bar, round(max(ln(c.nav / b.close)), 9) AS mfe, round(min(ln(c.nav / b.close)), 9) AS mae, e.t1 - e.t0 AS days FROM ({LABEL_SQL}) e JOIN fx_bar b ON b.etf_id = e.etf_id AND b.bar = e.bar JOIN fx_curve c ON c.etf_id = e.etf_id AND c.date > e.t0 AND c.date <= e.t1 GROUP BY e.etf_id, e.bar, e.t0, e.t1")
def l06(v: Views) -> DataFrame:
    events = labelled(v).where("t1 is not null").join(v.bar.select("etf_id", "bar", "close"), ["etf_id", "bar"])
    path = R.interval_join(v.curve.select("etf_id", "date", "nav"), events, ["etf_id"], "date", "t0", "t1").withColumn("move", F.ln(F.col("nav") / F.col("close")))
    return path.groupBy("etf_id", "bar", "t0", "t1").agg(F.round(F.max("move"), 9).alias("mfe"), F.round(F.min("move"), 9).alias("mae")).select("etf_id", "bar", "mfe", "mae", F.datediff("t1", "t0").cast("long").alias("days"))


@query("l05_raw_open_proxy", """WITH p AS (SELECT date, ticker, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev, tradable FROM fx_state), h AS (SELECT c.date, x.etf_id, x.ticker, x.w FROM (SELECT date, lag(date) OVER (ORDER BY date) AS prior FROM fx_calendar) c JOIN fx_holding x ON x.date = c.prior)
  SELECT h.date, h.etf_id, bool_and(coalesce(p.tradable, false)) AS legal, round(sum(h.w * p.close / p.prev), 9) AS growth FROM h LEFT JOIN p ON p.date = h.date AND p.ticker = h.ticker GROUP BY 1, 2""")
def l05(v: Views) -> DataFrame:
    p = v.state.select("date", "ticker", "close", "tradable", F.lag("close").over(Window.partitionBy("ticker").orderBy("date")).alias("prev"))
    days = v.calendar.select(F.col("date").alias("today"), F.lag("date").over(Window.orderBy("date")).alias("date"))
    held = v.holding.join(F.broadcast(days), "date").select(F.col("today").alias("date"), "etf_id", "ticker", "w")
    rows = held.join(p, ["date", "ticker"], "left")
    return rows.groupBy("date", "etf_id").agg(F.bool_and(F.coalesce("tradable", F.lit(False))).alias("legal"), F.round(F.sum(F.col("w") * F.col("close") / F.col("prev")), 9).alias("growth"))


FOLD_SQL = f"""WITH e AS (SELECT * FROM ({LABEL_SQL}) WHERE t1 IS NOT NULL), b AS (SELECT t0, ntile(4) OVER (ORDER BY t0) - 1 AS block FROM (SELECT DISTINCT t0 FROM e)), s AS (SELECT block AS fold, min(t0) AS first FROM b WHERE block > 0 GROUP BY 1)
  SELECT s.fold, e.etf_id, e.bar, CASE WHEN b.block = s.fold THEN 'validation' ELSE 'train' END AS part FROM e JOIN b ON b.t0 = e.t0 JOIN s ON b.block <= s.fold WHERE b.block = s.fold OR e.t1 < s.first"""


@query("t02_purged_folds", f"SELECT CAST(fold AS INTEGER) AS fold, etf_id, bar, part FROM ({FOLD_SQL})")
def t02(v: Views) -> DataFrame:
    return labels.purged_folds(labelled(v).where("t1 is not null"), 3).select("fold", "etf_id", "bar", "part")


@query("t03_fold_audit", f"SELECT CAST(fold AS INTEGER) AS fold, part, count(*) AS n, min(bar) AS low, max(bar) AS high FROM ({FOLD_SQL}) GROUP BY fold, part")
def t03(v: Views) -> DataFrame:
    return t02(v).groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("bar").alias("low"), F.max("bar").alias("high"))


@query("v01_ml_view", f"SELECT b.etf_id, b.bar, b.close, CASE WHEN l.t1 <= DATE '1999-12-31' THEN l.label END AS label FROM fx_bar b LEFT JOIN ({LABEL_SQL}) l ON l.etf_id = b.etf_id AND l.bar = b.bar WHERE b.end_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def v01(v: Views) -> DataFrame:
    rows = R.checked_join(v.bar.where("end_date between date'1996-01-01' and date'1999-12-31'"), labelled(v), ["etf_id", "bar"], "left", "1:1")
    return rows.select("etf_id", "bar", "close", F.when(F.col("t1") <= F.lit("1999-12-31").cast("date"), F.col("label")).alias("label"))


@query("v02_trading_view", "SELECT i.etf_id, b.bar, CASE WHEN b.bar IS NULL THEN 'no_bar' WHEN DATE '1999-06-30' - b.end_date > 30 THEN 'stale' ELSE 'available' END AS status FROM (SELECT DISTINCT etf_id FROM fx_bar UNION SELECT '9-NONE') i LEFT JOIN (SELECT etf_id, max(bar) AS bar, max(end_date) AS end_date FROM fx_bar WHERE end_date <= DATE '1999-06-30' GROUP BY 1) b ON b.etf_id = i.etf_id")
def v02(v: Views) -> DataFrame:
    as_of = F.lit("1999-06-30").cast("date")
    ids = v.bar.select("etf_id").distinct().unionByName(v.spark.createDataFrame([("9-NONE",)], "etf_id string"))
    last = R.latest_per_key(v.bar.where(F.col("end_date") <= as_of), ["etf_id"], [F.desc("bar")])
    return ids.join(last, "etf_id", "left").select("etf_id", "bar", F.when(F.col("bar").isNull(), "no_bar").when(F.datediff(as_of, "end_date") > 30, "stale").otherwise("available").alias("status"))


SOME_BARS = "(SELECT *, lag(bar) OVER w AS prior, lag(end_date) OVER w AS until FROM (SELECT etf_id, bar, start_date, CASE WHEN bar % 17 = 3 THEN end_date + 20 ELSE end_date END AS end_date FROM fx_bar WHERE bar % 11 <> 4) WINDOW w AS (PARTITION BY etf_id ORDER BY bar))"
BAR_LABELS = f"({LABEL_SQL}) l FULL JOIN {SOME_BARS} b ON b.etf_id = l.etf_id AND b.bar = l.bar"
BAR_CHECKS = {
    "gap": ("bar <> prior + 1", SOME_BARS),
    "overlap": ("start_date <= until", SOME_BARS),
    "bar_order": ("start_date > end_date", SOME_BARS),
    "repeated_bar": ("i > 1", f"(SELECT row_number() OVER (PARTITION BY etf_id, bar) AS i FROM {SOME_BARS})"),
    "repeated_label": ("i > 1", f"(SELECT row_number() OVER (PARTITION BY etf_id, bar) AS i FROM ({LABEL_SQL}))"),
    "label_without_bar": ("b.bar IS NULL", BAR_LABELS),
    "bar_without_label": ("l.bar IS NULL", BAR_LABELS),
    "label_start": ("l.t0 <> b.end_date", BAR_LABELS),
    "label_order": ("l.t1 < l.t0", BAR_LABELS),
}


# Some bars are gone and some end late, so that the counts show.
@query("v03_cross_table_checks", " UNION ALL ".join(CHECK.format(name, rule, rows) for name, (rule, rows) in BAR_CHECKS.items()))
def v03(v: Views) -> DataFrame:
    late = F.when(F.col("bar") % 17 == 3, F.date_add("end_date", 20)).otherwise(F.col("end_date"))
    return validators.bar_violations(v.bar.where("bar % 11 <> 4").withColumn("end_date", late), labelled(v))


@query("v05_readiness", "SELECT etf_id, count(*) AS bars, max(days) AS longest, count(*) >= 120 AS enough, max(days) <= 60 AS short_enough, count(*) >= 120 AND max(days) <= 60 AS ready FROM fx_bar GROUP BY 1")
def v05(v: Views) -> DataFrame:
    return validators.readiness(v.bar)


# A resumed run gives what the whole one gives, which the SQL makes.
@query("q05_resumed_factors", f"{FACTOR_SQL} WHERE date >= DATE '2000-01-03'")
def q05(v: Views) -> DataFrame:
    actions, cut = price_actions(v), "date'2000-01-03'"
    past = corporate.adjustment_factors(v.price.where(f"date < {cut}"), actions)
    seeds = past.groupBy("ticker").agg(F.max_by("factor", "date").alias("factor"), F.max_by("close", "date").alias("close"), F.max("date").alias("date"))
    return corporate.resume_factors(v.price.where(f"date >= {cut}"), actions, seeds).select("date", "ticker", F.round("factor", 6).alias("factor"))


@query("m03_identity_conflicts", "SELECT p.date, p.ticker, CASE WHEN m.market IS NULL THEN 'emerging' ELSE 'outside_lifecycle' END AS reason FROM fx_price p JOIN fx_master m ON m.ticker = p.ticker WHERE m.market IS NULL OR p.date < m.list_date OR p.date >= m.delist_date")
def m03(v: Views) -> DataFrame:
    return market.identity_conflicts(v.price, v.master)


@query("x06_synthetic_actions", """SELECT date, ticker, CAST(floor(1000 * f + 1e-9) AS BIGINT) AS shares, round(greatest(0, 1000 * f - floor(1000 * f + 1e-9)) * close, 6) AS cash FROM (SELECT date, ticker, close, (adj_close / close) / (lag(adj_close) OVER w / lag(close) OVER w) AS f FROM fx_price WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE f IS NOT NULL""")
def x06(v: Views) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    rows = v.price.select("date", "ticker", "close", "adj_close", F.lag("close").over(w).alias("pc"), F.lag("adj_close").over(w).alias("pa")).where("pc is not null")
    moved = rows.withColumn("s", P.synthetic_action(F.col("close"), F.col("adj_close"), F.col("pc"), F.col("pa"), F.lit(1000)))
    return moved.select("date", "ticker", "s.shares", F.round("s.cash", 6).alias("cash"))


@query("v04_capabilities", "SELECT * FROM (VALUES ('realized_volatility', false, 'close'), ('traded_value', true, ''), ('order_flow_toxicity', false, 'buy_volume,sell_volume'), ('price_impact', false, 'signed_volume'), ('true_range', false, 'close,high,low'), ('implied_volatility', false, 'implied_volatility')) t(feature, available, missing)")
def v04(v: Views) -> DataFrame:
    return market.capability_audit(v.index)


@query("v06_coverage_regression", "SELECT t.ticker, extract(year FROM c.date) AS year, count(*) AS sessions, count(p.date) AS covered FROM fx_calendar c CROSS JOIN (SELECT DISTINCT ticker FROM fx_price) t LEFT JOIN fx_price p ON p.date = c.date AND p.ticker = t.ticker GROUP BY 1, 2")
def v06(v: Views) -> DataFrame:
    return v.dense.groupBy("ticker", F.year("date").cast("long").alias("year")).agg(F.count("*").alias("sessions"), F.count("close").alias("covered"))


@query("l07_feature_sidecars", """WITH f AS (SELECT h.date, h.etf_id, CASE WHEN count(*) = count(c.fund) THEN sum(h.w * c.fund) END AS flow FROM fx_holding h LEFT JOIN fx_chip c ON c.date = h.date AND c.ticker = h.ticker GROUP BY 1, 2),
  z AS (SELECT date, etf_id, CASE WHEN count(flow) OVER w = 20 AND stddev_samp(flow) OVER w > 0 THEN (flow - avg(flow) OVER w) / stddev_samp(flow) OVER w END AS z FROM f WINDOW w AS (PARTITION BY etf_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  SELECT b.etf_id, b.bar, round(z.z, 6) AS flow_z FROM fx_bar b ASOF LEFT JOIN z ON z.etf_id = b.etf_id AND b.end_date >= z.date""")
def l07(v: Views) -> DataFrame:
    from chronofold.operators.signals import full, trailing

    flow = F.when(F.count("*") == F.count("fund"), F.sum(F.col("w") * F.col("fund")))
    rows = v.holding.join(v.chip, ["date", "ticker"], "left").groupBy("date", "etf_id").agg(flow.alias("flow"))
    w = trailing("etf_id", "date", 20)
    m, s = full(F.avg, "flow", w, 20), full(F.stddev_samp, "flow", w, 20)
    z = rows.select(F.col("date").alias("day"), "etf_id", F.when(s > 0, (F.col("flow") - m) / s).alias("z"), F.lit(True).alias("there"))
    found = R.asof_join(v.bar, z, "end_date", "day", ["z", "there"], by=["etf_id"])
    return found.select("etf_id", "bar", F.round("z", 6).alias("flow_z"))


@query("l08_target_table", "SELECT b.etf_id, b.bar, c.nav, c.date FROM fx_bar b JOIN fx_curve c ON c.etf_id = b.etf_id AND c.date = b.end_date")
def l08(v: Views) -> DataFrame:
    bars_ = v.bar.select("etf_id", "bar", F.col("end_date").alias("date"))
    return R.checked_join(bars_, v.curve.select("etf_id", "date", "nav"), ["etf_id", "date"], "inner1", "1:1").select("etf_id", "bar", "nav", "date")


@query("s03_per_key_ranges", "SELECT ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date, arg_max(close, date) AS last_close FROM fx_price GROUP BY 1")
def s03(v: Views) -> DataFrame:
    """Fan-out over all tickers, each with its dates and its last row as seed, in one scan."""
    return v.price.groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"))


@query("s07_rename_and_normalize", "SELECT o_orderkey AS order_id, strftime(d, '%Y-%m-%d') AS mdate, CASE WHEN ticker = '1110' THEN NULL ELSE CAST(price AS DOUBLE) END AS amt FROM fx_orders")
def s07(v: Views) -> DataFrame:
    raw = v.orders.select(F.col("o_orderkey").alias("order_id"), F.date_format("d", "yyyy-MM-dd").alias("mdate"), F.when(F.col("ticker") == "1110", float("nan")).otherwise(F.col("price").cast("double")).alias("amt"))
    return raw.withColumn("amt", F.when(~F.isnan("amt"), F.col("amt")))


@query("s05_cutoff_fallback", "SELECT ticker, period, CASE WHEN available > DATE '2000-01-01' THEN DATE '2000-01-01' ELSE available END AS cutoff FROM fx_sales WHERE revision = 1")
def s05(v: Views) -> DataFrame:
    limit = F.lit("2000-01-01").cast("date")
    return v.sales.where("revision = 1").select("ticker", "period", F.when(F.col("available") > limit, limit).otherwise(F.col("available")).alias("cutoff"))
