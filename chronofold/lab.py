"""Whole runs over governed tables: portfolios from signals to amounts, and bars from calibration to labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators import bars, labels, pit, structure
from chronofold.operators import portfolio as P
from chronofold.operators.features import bar_features
from chronofold.operators.relational import ContractError, densify, latest_per_key
from chronofold.operators.signals import full, trailing


@dataclass(frozen=True)
class Market:
    """The inputs of a portfolio run.

    calendar: date. prices: date, ticker, close, adj_close, volume, traded_value, market_cap, turnover. chip: date, ticker, qfii, fund, dlrp.
    master: ticker, list_date, delist_date, main_industry. state: date, ticker, market_state, amount_state, tradable, traded_value.
    sales: ticker, period, available, row_id, r18. financial: ticker, period_end, available, revision_date, row_no, r103. index: date, traded_value.
    """

    calendar: DataFrame
    prices: DataFrame
    chip: DataFrame
    master: DataFrame
    state: DataFrame
    sales: DataFrame
    financial: DataFrame
    index: DataFrame


@dataclass(frozen=True)
class PortfolioResult:
    audit: DataFrame
    targets: DataFrame
    ledger: DataFrame
    amounts: DataFrame
    tables: tuple[str, ...] = field(default=("audit", "targets", "ledger", "amounts"))

    def nav(self) -> DataFrame:
        return self.ledger.where("kind = 'daily'").select("etf_id", "date", "nav", "assets", "cash")

    def returns(self) -> DataFrame:
        w = Window.partitionBy("etf_id").orderBy("date")
        return self.nav().select("etf_id", "date", (F.col("nav") / F.lag("nav").over(w) - 1).alias("ret"))

    def holdings(self) -> DataFrame:
        w = Window.partitionBy("etf_id", "date")
        held = self.ledger.where("kind = 'holding'").withColumn("value", F.col("shares") * F.col("price"))
        return held.select("etf_id", "date", "ticker", "shares", "price", (F.col("value") / F.sum("value").over(w)).alias("weight"))

    def write(self, path: str) -> None:
        """One Parquet table per part; an existing one is an error."""
        for name in self.tables:
            getattr(self, name).write.mode("errorifexists").parquet(f"{path}/{name}")


def sessions(calendar: DataFrame) -> DataFrame:
    """date with session_idx, month, and k of n in the month."""
    month = F.trunc("date", "month")
    m = Window.partitionBy(month)
    return calendar.select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("session_idx"), month.alias("month"), F.row_number().over(m.orderBy("date")).alias("k"), F.count("*").over(m).cast("int").alias("n"))


def signal_table(m: Market) -> DataFrame:
    """Every signal of the rules for every session and ticker, from one sort by ticker."""
    w20, w60, far, order = trailing("ticker", "date", 20), trailing("ticker", "date", 60), trailing("ticker", "date", 60, 20), Window.partitionBy("ticker").orderBy("date")
    year = F.sqrt(F.lit(252.0))
    rows = densify(m.prices, m.calendar.select("date"), "date", "ticker").join(m.chip, ["date", "ticker"], "left")
    rows = rows.withColumn("flow", F.col("qfii") + F.col("fund") + F.col("dlrp")).withColumn("ret", F.try_divide("adj_close", F.lag("adj_close").over(order)) - 1)
    rows = rows.withColumn("down", F.when(F.col("ret").isNotNull(), F.pow(F.least("ret", F.lit(0.0)), 2)))
    s, d, base, loose = full(F.stddev_samp, "ret", w60, 60), full(F.avg, "down", w60, 60), full(F.avg, "volume", far, 60), full(F.stddev_samp, "ret", w60, 20)
    a, b = F.lag("adj_close", 21).over(order), F.lag("adj_close", 252).over(order)
    return rows.select(
        "date", "ticker", "close", "market_cap", full(F.avg, "traded_value", w20, 20).alias("adv20"), full(F.sum, "traded_value", w20, 20).alias("sum20"), F.count("traded_value").over(w20).alias("n20"), full(F.avg, "turnover", w20, 20).alias("turnover_20d"),
        F.when(base > 0, full(F.avg, "volume", w20, 20) / base).alias("volume_ratio"), full(F.sum, "flow", w20, 20).alias("chip_20d"), F.when((a > 0) & (b > 0), a / b - 1).alias("momentum_12_1"), F.when(loose > 0, loose * year).alias("vol_60d"),
        F.when(s > 0, F.avg("ret").over(w60) / s * year).alias("sharpe_60d"), F.when(d > 0, F.avg("ret").over(w60) / F.sqrt(d) * year).alias("sortino_60d"),
    )


def candidate_table(m: Market) -> DataFrame:
    """Signals at the last session of each month, with what the exclusion rules look at."""
    days = sessions(m.calendar)
    ends = days.groupBy("month").agg(F.max("date").alias("formation_date")).select("formation_date")
    key = ["formation_date", "ticker"]
    rows = signal_table(m).withColumnRenamed("date", "formation_date").join(F.broadcast(ends), "formation_date")
    index = m.index.select(F.col("date").alias("formation_date"), full(F.sum, "traded_value", Window.orderBy("date").rowsBetween(-19, 0), 20).alias("index_sum20"))
    rows = rows.join(pit.pick_sales(m.sales, ends).select(*key, "r18"), key, "left").join(pit.pick_fundamentals(m.financial, ends).select(*key, "r103"), key, "left")
    rows = rows.join(F.broadcast(index), "formation_date", "left").join(m.state.select(F.col("date").alias("formation_date"), "ticker", "market_state"), key, "left")
    return rows.join(F.broadcast(m.master.select("ticker", "list_date", "delist_date", "main_industry", F.lit(True).alias("in_master"))), "ticker", "left").withColumn("known", F.coalesce("in_master", F.lit(False))).drop("in_master")


def check_coverage(m: Market) -> None:
    """Every price row needs a state row; the first that has none is an error."""
    lost = m.prices.join(m.state, ["date", "ticker"], "left_anti").select("date", "ticker").limit(1).collect()
    if lost:
        raise ContractError(f"no state for {lost[0].asDict()}")


def run_all(m: Market, capital: int = 100_000_000, rules: Sequence[P.Rule] = P.RULES) -> PortfolioResult:
    """Selection, simulation and traded amounts of all rules. Targets of a formation apply from the next month's first session on."""
    check_coverage(m)
    days = sessions(m.calendar)
    audit = P.candidate_audit(candidate_table(m), tuple(rules))
    targets = audit.where("selected").select("etf_id", "formation_date", F.add_months(F.trunc("formation_date", "month"), 1).alias("month"), "ticker", "rank", "weight")
    first = days.where("k = 1").select("month", "date")
    weights = targets.join(F.broadcast(first), "month").select("etf_id", "date", "ticker", "weight")
    prices = m.prices.select("date", "ticker", F.col("close").alias("c"), F.col("adj_close").alias("a"))
    rows = m.state.select("date", "ticker", "tradable").join(prices, ["date", "ticker"], "left").join(F.broadcast(days.select("date", "month", "k", "n")), "date").join(F.broadcast(m.master.select("ticker", "delist_date")), "ticker", "left")
    rows = rows.withColumn("delisted", F.coalesce(F.col("date") >= F.col("delist_date"), F.lit(False)))
    zero = F.lit(0.0)
    # A portfolio's kernel gets the rows of what it ever targets, and each day at least once.
    wanted = rows.drop("month", "k", "n").join(targets.select("etf_id", "ticker").distinct(), "ticker")
    each_day = days.select("date", "month", "k", "n").join(F.broadcast(targets.select("etf_id").distinct()))
    grid = each_day.join(wanted, ["etf_id", "date"], "left").join(weights, ["etf_id", "date", "ticker"], "left")
    ledger = P.run_portfolios(grid.select("etf_id", "date", "month", "k", "n", "ticker", F.coalesce("c", zero).alias("close"), F.coalesce("a", zero).alias("adj_close"), "tradable", "delisted", "weight"), capital)
    w = Window.partitionBy("etf_id", "date")
    held = ledger.where("kind = 'holding'").withColumn("value", F.col("shares") * F.col("price")).select("date", "etf_id", "ticker", (F.col("value") / F.sum("value").over(w)).alias("w"))
    prior = days.select("date", F.lag("date").over(Window.orderBy("date")).alias("prior"))
    return PortfolioResult(audit, targets, ledger, P.traded_amount(held, m.state, prior))


@dataclass(frozen=True)
class BarResult:
    calibration: DataFrame
    bars: DataFrame
    features: DataFrame
    labels: DataFrame
    tails: DataFrame


def build_all(curve: DataFrame, train_end: str | None = None, horizon: int = 60, width: float = 2.0) -> BarResult:
    """Bars, features and labels of curves (etf_id, date, nav, etf_amount).

    With train_end only days up to it calibrate the quantile. The chosen ratio is one number; without a suitable quantile the run fails.
    """
    seen = curve if train_end is None else curve.where(F.col("date") <= F.lit(train_end).cast("date"))
    calibration = bars.calibrate(seen)
    chosen = calibration.where("chosen").select("ratio").collect()
    if not chosen:
        raise ContractError("no quantile gives all ids enough bars")
    days = bars.assign_bars(curve, chosen[0].ratio)
    table = bars.bar_table(days)
    features = bar_features(table)
    sigma = structure.ewm_volatility(table.select("etf_id", "bar", "end_date", "close", "log_return"), "etf_id", "bar", "log_return")
    found = labels.triple_barrier(sigma, curve.select("etf_id", "date", "nav"), width, horizon)
    return BarResult(calibration, table, features, found, bars.open_tails(days))


def for_trading(result: BarResult, as_of: str) -> DataFrame:
    """The latest closed bar of each id by a date, with its features."""
    done = result.features.where(F.col("end_date") <= F.lit(as_of).cast("date"))
    return latest_per_key(done, ["etf_id"], [F.desc("bar")])
