"""Daily market state, security panels and universes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import latest_per_key


def classify(price: Column, suspended: Column, attribute: Column, amount: Column) -> Column:
    """A struct of reason, state, amount_state and tradable from what a session shows of a security.

    price, attribute: whether such a row is there; amount: the traded value; suspended: the flag.
    """
    bad = amount.isNull() | F.isnan(amount) | (amount < 0)

    def of(reason: str, state: str, amounts: str, tradable: bool | None) -> Column:
        return F.struct(F.lit(reason).alias("reason"), F.lit(state).alias("market_state"), F.lit(amounts).alias("amount_state"), F.lit(tradable).cast("boolean").alias("tradable"))

    return (
        F.when(price & bad, of("invalid_amount", "MISSING", "MISSING", None))
        .when(price & suspended, of("price_suspended", "HALTED", "OBSERVED", False))
        .when(price, of("price", "TRADING", "OBSERVED", True))
        .when(suspended, of("suspended", "HALTED", "ZERO_AUTHORIZED", False))
        .when(attribute, of("attribute_only", "MISSING", "MISSING", None))
        .otherwise(of("no_rows", "HALTED", "ZERO_AUTHORIZED", False))
    )


def venue(market: Column) -> Column:
    m = F.upper(F.trim(market))
    return F.when(m == "TSE", "TWSE").when(m == "OTC", "TPEX").otherwise(F.when(m == "", None).otherwise(m))


def listing_market(tse: Column, otc: Column) -> Column:
    """The later of two listing dates names the market; neither: EMERGING; equal ones are an error."""
    return F.when(tse.isNull() & otc.isNull(), "EMERGING").when(tse == otc, F.raise_error(F.lit("equal listing dates"))).when(otc.isNull() | (tse > otc), "TSE").otherwise("OTC")


def active_sessions(calendar: DataFrame, master: DataFrame) -> DataFrame:
    """date, ticker of every session from listing to the day before delisting; the calendar is broadcast."""
    inside = (F.col("list_date") <= F.col("date")) & (F.col("delist_date").isNull() | (F.col("date") < F.col("delist_date")))
    return master.select("ticker", "list_date", "delist_date").join(F.broadcast(calendar.select("date")), inside).select("date", "ticker")


def daily_state(calendar: DataFrame, master: DataFrame, prices: DataFrame, attributes: DataFrame) -> DataFrame:
    """A row for every active session or price row, classified. attributes: date, ticker, suspended.

    tradable is null where the state is MISSING; amount is the traded value where it is observed, 0 where none is authorized, else null.
    """
    keys = active_sessions(calendar, master).unionByName(prices.select("date", "ticker")).distinct()
    seen = prices.select("date", "ticker", "close", "traded_value", F.lit(True).alias("priced"))
    noted = attributes.select("date", "ticker", "suspended", F.lit(True).alias("noted"))
    rows = keys.join(seen, ["date", "ticker"], "left").join(noted, ["date", "ticker"], "left")
    no = F.lit(False)
    state = classify(F.coalesce("priced", no), F.coalesce("suspended", no), F.coalesce("noted", no), F.col("traded_value"))
    amount = F.when(F.col("s.amount_state") == "OBSERVED", F.col("traded_value")).when(F.col("s.amount_state") == "ZERO_AUTHORIZED", 0.0)
    return rows.select("date", "ticker", "close", "traded_value", state.alias("s")).select("date", "ticker", "close", "traded_value", "s.*", amount.alias("amount"))


def identity_conflicts(prices: DataFrame, master: DataFrame) -> DataFrame:
    """Price rows the lifecycle doesn't explain: unknown securities, emerging ones (no market), and rows outside their listed days."""
    rows = prices.select("date", "ticker").join(master.select("ticker", "market", "list_date", "delist_date", F.lit(True).alias("known")), "ticker", "left")
    outside = (F.col("date") < F.col("list_date")) | (F.col("date") >= F.col("delist_date"))
    reason = F.when(F.col("known").isNull(), "unidentified").when(F.col("market").isNull(), "emerging").when(outside, "outside_lifecycle")
    return rows.select("date", "ticker", reason.alias("reason")).where("reason is not null")


def instrument(kind: Column) -> Column:
    """EQUITY for what is called a common stock, else OTHER."""
    return F.when(F.contains(F.upper(F.trim(kind)), F.lit("COMMON STOCK")), "EQUITY").otherwise("OTHER")


def capability_audit(index: DataFrame) -> DataFrame:
    """What the index source supports: observations by column, and features declared unavailable for want of their inputs."""
    have = set(index.columns)
    needs = {"realized_volatility": {"close"}, "traded_value": {"traded_value"}, "order_flow_toxicity": {"buy_volume", "sell_volume"}, "price_impact": {"signed_volume"}, "true_range": {"high", "low", "close"}, "implied_volatility": {"implied_volatility"}}
    rows = [(name, bool(cols <= have), ",".join(sorted(cols - have))) for name, cols in needs.items()]
    return index.sparkSession.createDataFrame(rows, "feature string, available boolean, missing string")


def security_panel(prices: DataFrame, master: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per price row: adv20 over up to 20 own rows, whether listed and tradable, and the next session as effective_date.

    Where the calendar has a market column, it is the next session of the security's own market, null if that market has no calendar or no
    session that day; a security without a market, and any under a calendar without one, goes by the sessions of all.
    """
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-19, 0)
    rows = prices.withColumn("adv20", F.avg(F.coalesce("traded_value", F.lit(0.0))).over(w)).join(master, "ticker", "left")
    every = calendar.select("date").distinct().select("date", F.lead("date").over(Window.orderBy("date")).alias("__any"))
    rows = rows.join(F.broadcast(every), "date", "left")
    if "market" in calendar.columns:
        own = calendar.select("date", F.trim("market").alias("__market")).distinct().withColumn("__own", F.lead("date").over(Window.partitionBy("__market").orderBy("date")))
        market = F.when(F.trim("market") != "", F.trim("market"))
        rows = rows.withColumn("__market", market).join(F.broadcast(own), ["date", "__market"], "left")
        rows = rows.withColumn("effective_date", F.when(F.col("__market").isNull(), F.col("__any")).otherwise(F.col("__own"))).drop("__market", "__own", "__any")
    else:
        rows = rows.withColumnRenamed("__any", "effective_date")
    listed = (F.col("list_date") <= F.col("date")) & (F.col("delist_date").isNull() | (F.col("date") < F.col("delist_date")))
    return rows.withColumns({"listed": F.coalesce(listed, F.lit(False)), "tradable": F.coalesce(listed & (F.col("volume") > 0), F.lit(False))})


@dataclass(frozen=True)
class UniverseSpec:
    name: str
    rank_by: str | None
    size: int | None
    filters: tuple[tuple[str, str, object], ...] = ()


def _holds(column: str, op: str, value: object) -> Column:
    c = F.col(column)
    tests = {"eq": lambda: c.eqNullSafe(F.lit(value)), "gte": lambda: F.coalesce(c >= F.lit(value), F.lit(False)), "not_null": lambda: c.isNotNull()}
    if op not in tests:
        raise ValueError(f"unknown filter {op!r}")
    return tests[op]()


def universe(panel: DataFrame, spec: UniverseSpec, date: str = "effective_date") -> DataFrame:
    """Members by date with their rank: filters, then the largest by rank_by (nulls first on falling order), then ticker falling."""
    rows = panel.where(F.col(date).isNotNull())
    for column, op, value in spec.filters:
        rows = rows.where(_holds(column, op, value))
    rows = latest_per_key(rows, [date, "ticker"], [F.desc("date")])
    order = [F.desc_nulls_first(spec.rank_by), F.desc_nulls_first("ticker")] if spec.rank_by else [F.asc_nulls_last("ticker")]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(date).orderBy(*order)))
    kept = ranked if spec.size is None else ranked.where(F.col("rank") <= spec.size)
    return kept.select(F.col(date).alias("date"), F.lit(spec.name).alias("universe"), "ticker", "rank")


def universes(panel: DataFrame, specs: Sequence[UniverseSpec]) -> DataFrame:
    out = universe(panel, specs[0])
    for spec in specs[1:]:
        out = out.unionByName(universe(panel, spec))
    return out
