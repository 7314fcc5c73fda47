"""The market tables that the queries run over, made from the supplied tables.

A session is an ISO week. Money is summed as decimals, so every base column is the same number in any engine and partitioning.
Each view exists twice: as a DataFrame (Views) and as SQL (VIEW_SQL, put in front of a query's SQL by with_views).
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.operators.relational import densify

MONEY = "decimal(18,2)"
VIEW_SQL = {
    "fx_line": "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CAST(1101 + l_suppkey % 40 AS VARCHAR) AS ticker, l_quantity AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS ext, CAST(l_discount AS DECIMAL(4,2)) AS disc, l_returnflag AS flag FROM lineitem",
    "fx_calendar": """SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS session_idx, CAST(date_trunc('month', date) AS DATE) AS month,
      CAST(row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS INTEGER) AS k, CAST(count(*) OVER (PARTITION BY date_trunc('month', date)) AS INTEGER) AS n
      FROM (SELECT DISTINCT date FROM fx_line)""",
    "fx_price": """SELECT date, ticker, CAST(sum(ext) AS DOUBLE) / sum(qty) AS close, CAST(sum(ext * (1 - disc)) AS DOUBLE) / sum(qty) AS adj_close, sum(qty) AS volume,
      CAST(sum(ext) AS DOUBLE) AS traded_value, 1e6 * (1 + CAST(ticker AS INTEGER) % 7) + sum(qty) AS market_cap, sum(qty) / (1000 + CAST(ticker AS INTEGER) % 40) AS turnover FROM fx_line GROUP BY date, ticker""",
    "fx_dense": "SELECT c.date, c.session_idx, c.month, t.ticker, p.close, p.adj_close, p.volume, p.traded_value, p.market_cap, p.turnover FROM fx_calendar c CROSS JOIN (SELECT DISTINCT ticker FROM fx_price) t LEFT JOIN fx_price p ON p.date = c.date AND p.ticker = t.ticker",
    "fx_index": "SELECT p.date, c.session_idx, CAST(sum(CAST(p.traded_value AS DECIMAL(18,2))) AS DOUBLE) AS traded_value FROM fx_price p JOIN fx_calendar c ON c.date = p.date GROUP BY p.date, c.session_idx",
    "fx_chip": """SELECT date, ticker, sum(qty) FILTER (WHERE flag = 'A') AS qfii, sum(qty) FILTER (WHERE flag = 'N') AS fund, sum(qty) FILTER (WHERE flag = 'R') AS dlrp FROM fx_line GROUP BY date, ticker""",
    "fx_master": """SELECT ticker, 'stock ' || ticker AS stock_name, CASE CAST(ticker AS INTEGER) % 3 WHEN 0 THEN 'TSE' WHEN 1 THEN 'OTC' END AS market, min(date) AS list_date,
      CASE WHEN CAST(ticker AS INTEGER) % 13 = 0 THEN DATE '2000-01-03' END AS delist_date,
      CASE CAST(ticker AS INTEGER) % 4 WHEN 0 THEN 'financial' WHEN 1 THEN 'shipping' WHEN 2 THEN 'steel' ELSE 'foods' END AS main_industry FROM fx_price GROUP BY ticker""",
    "fx_state": """SELECT date, session_idx, ticker, close, adj_close, traded_value,
      CASE WHEN close IS NOT NULL THEN 'TRADING' WHEN session_idx % 2 = 0 THEN 'HALTED' ELSE 'MISSING' END AS market_state,
      CASE WHEN close IS NOT NULL THEN 'OBSERVED' WHEN session_idx % 2 = 0 THEN 'ZERO_AUTHORIZED' ELSE 'MISSING' END AS amount_state, close IS NOT NULL AS tradable FROM fx_dense""",
    "fx_orders": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(1101 + o_custkey % 40 AS VARCHAR) AS ticker, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderpriority AS etf_id FROM orders",
    "fx_sales0": "SELECT ticker, CAST(date_trunc('month', d) AS DATE) AS period, CAST(sum(price) AS DOUBLE) AS r18 FROM fx_orders GROUP BY 1, 2",
    "fx_sales": """SELECT ticker, period, CAST(period + INTERVAL 1 MONTH AS DATE) + 10 AS available, 1 AS revision, ticker || '-1' AS row_id, r18 FROM fx_sales0
      UNION ALL SELECT ticker, period, CAST(period + INTERVAL 1 MONTH AS DATE) + 20, 2, ticker || '-2', r18 * 2 FROM fx_sales0 WHERE month(period) % 3 = 0""",
    "fx_financial": """SELECT ticker, q AS period_end, CAST(q + INTERVAL 4 MONTH AS DATE) AS available, CASE WHEN CAST(ticker AS INTEGER) % 5 = 0 THEN NULL ELSE CAST(q + INTERVAL 5 MONTH AS DATE) END AS revision_date, v AS row_no,
      CASE WHEN v = 1 AND CAST(ticker AS INTEGER) % 7 = 0 THEN r + 1 ELSE r END AS r103 FROM
      (SELECT ticker, CAST(date_trunc('quarter', d) AS DATE) AS q, CAST(count(*) - 3 AS DOUBLE) AS r FROM fx_orders GROUP BY 1, 2) CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1) v0""",
    "fx_curve0": "SELECT d AS date, etf_id, CAST(sum(price) AS DOUBLE) AS etf_amount, CAST(avg(CAST(o_orderkey % 100 AS DOUBLE)) AS DOUBLE) AS m FROM fx_orders GROUP BY 1, 2",
    "fx_curve": "SELECT date, etf_id, etf_amount, 100 + m AS nav, CAST(row_number() OVER (PARTITION BY etf_id ORDER BY date) AS BIGINT) AS i FROM fx_curve0",
    "fx_bar": """SELECT etf_id, CAST((i - 1) // 10 AS BIGINT) AS bar, min(date) AS start_date, max(date) AS end_date, arg_min(nav, i) AS open, max(nav) AS high, min(nav) AS low, arg_max(nav, i) AS close,
      CAST(sum(CAST(etf_amount AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(*) AS days FROM fx_curve GROUP BY 1, 2""",
    "fx_holding": """SELECT date, etf_id, ticker, w FROM (SELECT c.date, c.session_idx, e.etf_id, p.ticker, 1.0 / count(*) OVER (PARTITION BY c.date, e.etf_id) AS w
      FROM fx_calendar c CROSS JOIN (SELECT DISTINCT etf_id FROM fx_orders) e JOIN fx_dense p ON p.date = c.date
      WHERE (CAST(p.ticker AS INTEGER) + length(e.etf_id) + extract(year FROM c.date) * 12 + extract(month FROM c.date)) % 5 = 0)""",
    "fx_event": "SELECT event_id, ts, user_id, event_type, value FROM events",
}


def with_views(sql: str) -> str:
    """sql with the views it names in front of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEW_SQL and name not in needed:
                need(VIEW_SQL[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEW_SQL[n]})" for n in needed)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {head},\n{body[14:]}"
    return f"WITH {head},\n{body[4:]}" if body[:4].upper() == "WITH" else f"WITH {head}\n{body}"


def number(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("int")


class Views:
    """The views as DataFrames, each planned once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def line(self) -> DataFrame:
        return self.table("lineitem").select(F.date_trunc("week", "l_shipdate").cast("date").alias("date"), (1101 + F.col("l_suppkey") % 40).cast("string").alias("ticker"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").cast(MONEY).alias("ext"), F.col("l_discount").cast("decimal(4,2)").alias("disc"), F.col("l_returnflag").alias("flag"))

    @cached_property
    def calendar(self) -> DataFrame:
        month = F.trunc("date", "month")
        days = self.line.select("date").distinct()
        w, m = Window.orderBy("date"), Window.partitionBy(month)
        return days.select("date", (F.row_number().over(w) - 1).cast("long").alias("session_idx"), month.alias("month"), F.row_number().over(m.orderBy("date")).alias("k"), F.count("*").over(m).cast("int").alias("n"))

    @cached_property
    def price(self) -> DataFrame:
        sums = self.line.groupBy("date", "ticker").agg(F.sum("ext").cast("double").alias("traded_value"), F.sum(F.col("ext") * (1 - F.col("disc"))).cast("double").alias("net"), F.sum("qty").alias("volume"))
        return sums.select("date", "ticker", (F.col("traded_value") / F.col("volume")).alias("close"), (F.col("net") / F.col("volume")).alias("adj_close"), "volume", "traded_value", (1e6 * (1 + number("ticker") % 7) + F.col("volume")).alias("market_cap"), (F.col("volume") / (1000 + number("ticker") % 40)).alias("turnover"))

    @cached_property
    def dense(self) -> DataFrame:
        days = self.calendar.select("date", "session_idx", "month")
        return densify(self.price, days, "date", "ticker")

    @cached_property
    def index(self) -> DataFrame:
        return self.price.groupBy("date").agg(F.sum(F.col("traded_value").cast(MONEY)).cast("double").alias("traded_value")).join(F.broadcast(self.calendar.select("date", "session_idx")), "date")

    @cached_property
    def chip(self) -> DataFrame:
        of = lambda f: F.sum(F.when(F.col("flag") == f, F.col("qty")))
        return self.line.groupBy("date", "ticker").agg(of("A").alias("qfii"), of("N").alias("fund"), of("R").alias("dlrp"))

    @cached_property
    def master(self) -> DataFrame:
        t = number("ticker")
        rows = self.price.groupBy("ticker").agg(F.min("date").alias("list_date"))
        return rows.select("ticker", F.concat(F.lit("stock "), "ticker").alias("stock_name"), F.when(t % 3 == 0, "TSE").when(t % 3 == 1, "OTC").alias("market"), "list_date", F.when(t % 13 == 0, F.lit("2000-01-03").cast("date")).alias("delist_date"), F.when(t % 4 == 0, "financial").when(t % 4 == 1, "shipping").when(t % 4 == 2, "steel").otherwise("foods").alias("main_industry"))

    @cached_property
    def state(self) -> DataFrame:
        there, even = F.col("close").isNotNull(), F.col("session_idx") % 2 == 0
        return self.dense.select("date", "session_idx", "ticker", "close", "adj_close", "traded_value", F.when(there, "TRADING").when(even, "HALTED").otherwise("MISSING").alias("market_state"), F.when(there, "OBSERVED").when(even, "ZERO_AUTHORIZED").otherwise("MISSING").alias("amount_state"), there.alias("tradable"))

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), (1101 + F.col("o_custkey") % 40).cast("string").alias("ticker"), F.col("o_totalprice").cast(MONEY).alias("price"), F.col("o_orderpriority").alias("etf_id"))

    @cached_property
    def sales(self) -> DataFrame:
        rows = self.orders.groupBy("ticker", F.trunc("d", "month").alias("period")).agg(F.sum("price").cast("double").alias("r18"))
        both = rows.withColumn("revision", F.explode(F.when(F.month("period") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        return both.select("ticker", "period", F.date_add(F.add_months("period", 1), F.col("revision") * 10).alias("available"), "revision", F.concat_ws("-", "ticker", "revision").alias("row_id"), (F.col("r18") * F.col("revision")).alias("r18"))

    @cached_property
    def financial(self) -> DataFrame:
        rows = self.orders.groupBy("ticker", F.trunc("d", "quarter").alias("period_end")).agg((F.count("*") - 3.0).alias("r")).withColumn("row_no", F.explode(F.array(F.lit(0), F.lit(1))))
        return rows.select("ticker", "period_end", F.add_months("period_end", 4).alias("available"), F.when(number("ticker") % 5 != 0, F.add_months("period_end", 5)).alias("revision_date"), "row_no", F.when((F.col("row_no") == 1) & (number("ticker") % 7 == 0), F.col("r") + 1).otherwise(F.col("r")).alias("r103"))

    @cached_property
    def curve(self) -> DataFrame:
        days = self.orders.groupBy(F.col("d").alias("date"), "etf_id").agg(F.sum("price").cast("double").alias("etf_amount"), F.avg((F.col("o_orderkey") % 100).cast("double")).alias("m"))
        return days.select("date", "etf_id", "etf_amount", (100 + F.col("m")).alias("nav"), F.row_number().over(Window.partitionBy("etf_id").orderBy("date")).cast("long").alias("i"))

    @cached_property
    def bar(self) -> DataFrame:
        return self.curve.groupBy("etf_id", F.expr("(i - 1) div 10").alias("bar")).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.min_by("nav", "i").alias("open"), F.max("nav").alias("high"), F.min("nav").alias("low"), F.max_by("nav", "i").alias("close"), F.sum(F.col("etf_amount").cast(MONEY)).cast("double").alias("amount"), F.count("*").alias("days"))

    @cached_property
    def holding(self) -> DataFrame:
        etfs = self.orders.select("etf_id").distinct()
        rows = self.dense.select("date", "ticker").join(F.broadcast(etfs)).where((number("ticker") + F.length("etf_id") + F.year("date") * 12 + F.month("date")) % 5 == 0)
        return rows.select("date", "etf_id", "ticker", (1.0 / F.count("*").over(Window.partitionBy("date", "etf_id"))).alias("w"))

    @cached_property
    def event(self) -> DataFrame:
        return self.table("events").select("event_id", "ts", "user_id", "event_type", "value")
