"""Rule-based monthly portfolios: selection, weights, costs, simulation and traded amounts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_FLOOR, ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relational import cascade

#: Fees, and the liquidity thresholds (preferred, floor) of the rules.
COMMISSION, SELL_TAX, LEAST_FEE = Decimal("0.001425"), Decimal("0.003"), Decimal(1)
LEAST, MOST = 5, 10


@dataclass(frozen=True)
class Rule:
    etf_id: str
    signal: str
    ascending: bool = False
    by_market_cap: bool = False
    preferred: float = 0.002
    floor: float = 0.001
    adaptive: bool = True
    include: str | None = None
    exclude: str | None = None


#: The fixed portfolio rules.
RULES = (
    Rule("market_cap", "market_cap", by_market_cap=True),
    Rule("monthly_sales", "r18"),
    Rule("chip", "chip_20d"),
    Rule("roe", "r103", exclude="financial"),
    Rule("momentum", "momentum_12_1"),
    Rule("low_volatility", "vol_60d", ascending=True),
    Rule("financial", "adv20", preferred=0.001, adaptive=False, include="financial"),
    Rule("shipping", "adv20", preferred=0.0005, floor=0.0005, adaptive=False, include="shipping"),
    Rule("volume_ratio", "volume_ratio"),
    Rule("traded_amount", "adv20"),
    Rule("turnover", "turnover_20d"),
    Rule("sharpe_60d", "sharpe_60d"),
    Rule("sortino_60d", "sortino_60d"),
)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    rows = [(r.etf_id, r.signal, r.ascending, r.by_market_cap, r.preferred, r.floor, r.adaptive, r.include, r.exclude) for r in rules]
    return spark.createDataFrame(rows, "etf_id string, signal string, ascending boolean, by_market_cap boolean, preferred double, floor double, adaptive boolean, include string, exclude string")


def candidate_audit(candidates: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every candidate under every rule, with the first reason that excludes it, or its rank, selection and weight.

    A security without a list_date counts as missing from the master; one without an industry is in no included and in no excluded industry.
    candidates: formation_date, ticker, list_date, delist_date, main_industry, close, market_state, sum20, n20,
    index_sum20, adv20, market_cap and the signal columns. The rules are a small table, so all portfolios rank in one plan.
    """
    spark = candidates.sparkSession
    names = sorted({r.signal for r in rules})
    signal = F.coalesce(*[F.when(F.col("rule.signal") == n, F.col(n)) for n in names])
    rows = candidates.join(F.broadcast(rule_table(spark, rules).select(F.struct("*").alias("rule")))).withColumn("value", signal)
    ratio = F.try_divide("sum20", "index_sum20")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    base = cascade(
        ("not_common", ~F.col("ticker").rlike("^[1-9][0-9]{3}$")),
        ("missing_master", F.col("list_date").isNull()),
        ("not_listed", F.col("list_date") > F.col("formation_date")),
        ("delisted", F.col("delist_date") <= F.col("formation_date")),
        ("invalid_close", ~(finite("close") & (F.col("close") > 0))),
        ("halted", F.col("market_state") == "HALTED"),
        ("missing_state", F.coalesce(F.col("market_state") == "MISSING", F.lit(True))),
        ("industry_not_included", F.col("rule.include").isNotNull() & ~F.coalesce(F.col("main_industry") == F.col("rule.include"), F.lit(False))),
        ("industry_excluded", F.coalesce(F.col("main_industry") == F.col("rule.exclude"), F.lit(False))),
        ("no_signal", ~finite("value")),
        ("incomplete_window", F.coalesce(F.col("n20") != 20, F.lit(True))),
        ("invalid_ratio", ratio.isNull() | (ratio < 0)),
    )
    group = Window.partitionBy("formation_date", "rule.etf_id")
    rows = rows.withColumns({"reason": base, "ratio": ratio})
    good = F.col("reason").isNull()
    passing = F.count_if(good & (F.col("ratio") >= F.col("rule.preferred"))).over(group)
    threshold = F.when(F.col("rule.adaptive") & (passing < LEAST), F.col("rule.floor")).otherwise(F.col("rule.preferred"))
    rows = rows.withColumn("threshold", threshold).withColumn("reason", F.when(good & (F.col("ratio") < F.col("threshold")), "illiquid").otherwise(F.col("reason")))
    key = F.when(F.col("rule.ascending"), F.col("value")).otherwise(-F.col("value"))
    order = [F.col("reason").isNotNull(), F.asc_nulls_last(key), F.desc_nulls_last("adv20"), F.desc_nulls_last("market_cap"), F.col("ticker")]
    rows = rows.withColumn("rank", F.when(F.col("reason").isNull(), F.row_number().over(group.orderBy(*order))))
    chosen = F.coalesce(F.col("rank") <= MOST, F.lit(False))
    rows = rows.withColumn("selected", chosen)
    size = F.count_if("selected").over(group)
    cap = F.sum(F.when(F.col("selected"), F.col("market_cap"))).over(group)
    weight = F.when(F.col("selected"), F.when(F.col("rule.by_market_cap"), F.col("market_cap") / cap).otherwise(1.0 / size))
    return rows.select("formation_date", F.col("rule.etf_id").alias("etf_id"), "ticker", "value", "ratio", "threshold", "reason", "rank", "selected", weight.alias("weight"))


def fee(notional: Column, sell: Column) -> Column:
    """Commission of at least 1, rounded half up to whole units, plus the tax of sales; 0 for no trade."""
    amount = notional.cast("decimal(28,6)")
    charge = F.greatest(F.round(amount * F.lit(COMMISSION).cast("decimal(8,6)"), 0), F.lit(LEAST_FEE).cast("decimal(1,0)"))
    tax = F.when(sell, F.round(amount * F.lit(SELL_TAX).cast("decimal(4,3)"), 0)).otherwise(0)
    return F.when(amount <= 0, 0).otherwise(charge + tax).cast("long")


def scheduled(start: Column, target: Column, k: Column, n: Column) -> Column:
    """Shares to hold in session k of n: start plus the rounded (half away from zero) part of the way to target."""
    way = (target - start).cast("decimal(28,0)") * k
    return (start + F.round(way / n, 0)).cast("long")


def completion(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per `by`, how much of the way from start to target (share columns, null for none) actual has gone: 0 to 1, and 1 where there is no way to go."""
    gap = lambda a, b: F.sum(F.abs(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0))))
    sums = rows.groupBy(*by).agg(gap("target", "start").alias("__way"), gap("target", "actual").alias("__left"))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.try_divide("__left", "__way")))
    return sums.select(*by, F.when(F.col("__way") == 0, 1.0).otherwise(part).alias("completion"))


def half_up(x: Decimal) -> Decimal:
    return x.quantize(Decimal(1), rounding=ROUND_HALF_UP)


def charge(notional: Decimal, sell: bool) -> Decimal:
    if notional <= 0:
        return Decimal(0)
    return max(LEAST_FEE, half_up(notional * COMMISSION)) + (half_up(notional * SELL_TAX) if sell else 0)


def way(start: int, target: int, k: int, n: int) -> int:
    d = target - start
    step = half_up(abs(Decimal(d)) * k / n)
    return start + int(step if d >= 0 else -step)


def allocate_buys(wanted: dict[str, int], prices: dict[str, Decimal], cash: Decimal, held: dict[str, int] | None = None, targets: dict[str, int] | None = None) -> dict[str, int]:
    """Whole shares to buy within cash, all of them if it suffices.

    Else each order gets the floor of the same share, cash by value without fees; from the last ticker on, shares go until fees fit too; then
    they are added one by one where the position, held plus bought, is the smallest part of its target (ties by ticker) and the cash suffices.
    """
    held, targets = held or {}, targets or wanted
    cost = lambda t, n: prices[t] * n + charge(prices[t] * n, False)
    if sum((cost(t, n) for t, n in wanted.items() if n), Decimal(0)) <= cash:
        return dict(wanted)
    value = sum((prices[t] * n for t, n in wanted.items()), Decimal(0))
    share = max(Decimal(0), min(Decimal(1), cash / value)) if value > 0 else Decimal(0)
    out = {t: int((n * share).to_integral_value(rounding=ROUND_FLOOR)) for t, n in wanted.items()}
    spent = sum((cost(t, n) for t, n in out.items() if n), Decimal(0))
    while spent > cash:
        t = next((t for t in sorted(out, reverse=True) if out[t]), None)
        if t is None:
            return out
        # As many of its shares as fit, by halving; the cost rises with the number.
        others, few, many = spent - cost(t, out[t]), 0, out[t] - 1
        while few < many:
            n = (few + many + 1) // 2
            few, many = (n, many) if others + cost(t, n) <= cash else (few, n - 1)
        out[t], spent = few, others + (cost(t, few) if few else 0)
    while True:
        for t in sorted((t for t in wanted if out[t] < wanted[t]), key=lambda t: ((held.get(t, 0) + out[t]) / max(1, targets.get(t, 0)), t)):
            more = cost(t, out[t] + 1) - (cost(t, out[t]) if out[t] else 0)
            if spent + more <= cash:
                out[t] += 1
                spent += more
                break
        else:
            return out


LEDGER = "etf_id string, date date, kind string, ticker string, shares long, price double, fee double, cash double, assets double, nav double"


def simulate(days: pd.DataFrame, capital: Decimal) -> Iterator[tuple]:
    """One portfolio's ledger; days has a row per date and ticker, sorted: date, month, k, n, ticker, close, adj_close, tradable,
    delisted, weight (the target on the month's first session, else null). A row without a ticker only says that there is such a day.

    Per day: a synthetic corporate action by the change of adj_close against close, fractions to cash; forced sale of what is delisted at its last
    price; on a month's first session with targets the schedule is set anew from the assets; then the step of the schedule: sales first, where the state
    allows it, and purchases with the cash there is; a portfolio never sells its last share unless it buys.
    """
    cash, shares, last, start, target = capital, {}, {}, {}, {}
    begun = False
    for date, day in days.groupby("date", sort=True):
        every = list(day.itertuples())
        rows = {r.ticker: r for r in every if isinstance(r.ticker, str)}
        price: dict[str, Decimal] = {}
        for t, r in rows.items():
            if r.close > 0 and r.adj_close > 0:
                price[t] = Decimal(repr(float(r.close)))
                ratio = Decimal(repr(float(r.adj_close))) / price[t]
                if t in last and shares.get(t):
                    factor = ratio / last[t][1]
                    if abs(factor - 1) > Decimal("1e-9"):
                        whole = (shares[t] * factor).to_integral_value(rounding=ROUND_FLOOR)
                        cash += (shares[t] * factor - whole) * price[t]
                        shares[t] = int(whole)
                        if t in target:
                            start[t], target[t] = round(start[t] * float(factor)), round(target[t] * float(factor))
                last[t] = (price[t], ratio)
        value = lambda: cash + sum((last[t][0] * n for t, n in shares.items() if n), Decimal(0))
        trades: list[tuple] = []

        def trade(t: str, n: int, at: Decimal, kind: str) -> None:
            nonlocal cash
            cost = charge(at * abs(n), n < 0)
            cash -= at * n + cost
            shares[t] = shares.get(t, 0) + n
            trades.append((kind, t, n, at, cost))

        for t in sorted(t for t, n in shares.items() if n and t in rows and rows[t].delisted):
            trade(t, -shares[t], last[t][0], "delisting")
        for t in [t for t in target if t in rows and rows[t].delisted]:
            del target[t], start[t]
        new = {t: r.weight for t, r in rows.items() if r.weight == r.weight and r.weight is not None}
        if new:
            assets = value()
            start = {t: shares.get(t, 0) for t in {*shares, *new} if shares.get(t, 0) or t in new}
            target = {t: int((assets * Decimal(repr(float(new.get(t, 0.0)))) / last[t][0]).to_integral_value(rounding=ROUND_FLOOR)) if t in last else 0 for t in start}
        first = every[0]
        desired = {t: way(start[t], target[t], int(first.k), int(first.n)) - shares.get(t, 0) for t in target}
        legal = {t for t in desired if t in rows and rows[t].tradable and t in price}
        sells = {t: -d for t, d in desired.items() if d < 0 and t in legal}
        buys = {t: d for t, d in desired.items() if d > 0 and t in legal}
        if sells and not buys and sum(sells.values()) >= sum(shares.values()):
            keep = min(sells)
            sells[keep] -= 1
        for t in sorted(sells):
            if sells[t]:
                trade(t, -min(sells[t], shares.get(t, 0)), price[t], "sell")
        if buys:
            for t, n in sorted(allocate_buys(buys, price, cash, shares, target).items()):
                if n:
                    trade(t, n, price[t], "buy")
        for kind, t, n, at, cost in trades:
            yield (date, kind, t, n, float(at), float(cost), None, None, None)
        begun = begun or any(shares.values())
        if begun:
            assets = value()
            for t in sorted(t for t, n in shares.items() if n):
                yield (date, "holding", t, shares[t], float(last[t][0]), None, None, None, None)
            yield (date, "daily", None, sum(shares.values()), None, None, float(cash), float(assets), float(100 * assets / capital))


def run_portfolios(market: DataFrame, capital: int = 100_000_000) -> DataFrame:
    """Ledger rows of every portfolio (kind: buy, sell, delisting, holding, daily); each portfolio is a sequential kernel of its own."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["date", "ticker"])
        out = [(rows["etf_id"].iloc[0], *x) for x in simulate(rows, Decimal(capital))]
        return pd.DataFrame(out, columns=[c.split()[0] for c in LEDGER.split(", ")])

    return market.groupBy("etf_id").applyInPandas(one, LEDGER)


def traded_amount(holdings: DataFrame, state: DataFrame, days: DataFrame) -> DataFrame:
    """Per etf and day: today's traded values weighed with the weights of the session before.

    holdings: date, etf_id, ticker, w. Only observed amounts count; missing_count says how many do not. days: date, prior.
    """
    held = days.join(holdings.withColumnRenamed("date", "prior"), "prior")
    rows = held.join(state, ["date", "ticker"], "left")
    seen = F.coalesce(F.col("amount_state") == "OBSERVED", F.lit(False))
    return rows.groupBy("date", "etf_id").agg(F.sum(F.when(seen, F.col("w") * F.col("traded_value"))).alias("etf_amount"), F.count_if(~seen).alias("missing_count"))


@dataclass(frozen=True)
class Order:
    ticker: str
    shares: int
    price: float
    fee: float


def allocation_plan(weights: dict[str, float], prices: dict[str, float], cash: float, held: dict[str, int] | None = None) -> tuple[list[Order], float]:
    """One-off orders from what is held to the target weights, sales first, and the cash left. A book of one portfolio, not a table.

    Targets are floored shares of all assets; what purchases and fees cannot get from the cash is left out from the last ticker on.
    """
    held = {t: n for t, n in (held or {}).items() if n}
    lost = sorted(t for t in {*weights, *held} if not prices.get(t, 0) > 0)
    if lost:
        raise ValueError(f"no price for {lost}")
    if any(w < 0 for w in weights.values()) or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights are at least 0 and at most 1 together")
    price = {t: Decimal(repr(float(p))) for t, p in prices.items()}
    left = Decimal(repr(float(cash)))
    assets = left + sum((price[t] * n for t, n in held.items()), Decimal(0))
    goal = {t: int((assets * Decimal(repr(float(w))) / price[t]).to_integral_value(rounding=ROUND_FLOOR)) for t, w in weights.items()}
    orders: list[Order] = []
    for t in sorted(held):
        n = held[t] - goal.get(t, 0)
        if n > 0:
            fee_ = charge(price[t] * n, True)
            left += price[t] * n - fee_
            orders.append(Order(t, -n, float(price[t]), float(fee_)))
    wanted = {t: n - held.get(t, 0) for t, n in goal.items() if n > held.get(t, 0)}
    for t, n in sorted(allocate_buys(wanted, price, left, held, goal).items()) if wanted else []:
        if n:
            fee_ = charge(price[t] * n, False)
            left -= price[t] * n + fee_
            orders.append(Order(t, n, float(price[t]), float(fee_)))
    return orders, float(left)


def synthetic_action(close: Column, adj_close: Column, prev_close: Column, prev_adj: Column, shares: Column) -> Column:
    """A struct of whole shares and the fraction's cash after a change of adj_close against close between two sessions."""
    factor = (adj_close / close) / (prev_adj / prev_close)
    exact = shares * factor
    whole = F.floor(exact + 1e-9)
    return F.struct(whole.alias("shares"), (F.greatest(F.lit(0.0), exact - whole) * close).alias("cash"))
