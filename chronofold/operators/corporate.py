"""Corporate actions and adjusted prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import asof_join, latest_per_key

#: Fixed: a stock dividend is quoted per ten shares.
STOCK_BASE = 10.0


def dividend_events(wide: DataFrame) -> DataFrame:
    """One row per ex date from rows with q1_date..q4_date, q1_cash..q4_cash, stock_date, stock_value; the last row of a key wins, in a row its last quarter."""
    cash = [F.struct(F.lit(k).alias("quarter"), F.col(f"q{k}_date").alias("ex_date"), F.lit("cash").alias("kind"), F.col(f"q{k}_cash").alias("cash"), F.lit(0.0).alias("ratio")) for k in range(1, 5)]
    stock = F.struct(F.lit(0).alias("quarter"), F.col("stock_date").alias("ex_date"), F.lit("stock").alias("kind"), F.lit(0.0).alias("cash"), (F.col("stock_value") / STOCK_BASE).alias("ratio"))
    rows = wide.select("ticker", "row_no", F.explode(F.array(*cash, stock)).alias("e")).select("ticker", "row_no", "e.*").where("ex_date is not null and (cash > 0 or ratio > 0)")
    return latest_per_key(rows, ["ticker", "ex_date", "kind"], [F.desc("row_no"), F.desc("quarter")]).drop("row_no", "quarter")


def capital_actions(wide: DataFrame) -> DataFrame:
    """Reductions (a percentage of shares goes), splits (new shares for old) and price adjustments (last close to reference price)."""
    cases = F.array(
        F.when(F.col("reduce_pct") > 0, F.struct(F.lit("reduction").alias("kind"), (1 - F.col("reduce_pct") / 100.0).alias("factor"))),
        F.when((F.col("split_new") > 0) & (F.col("split_old") > 0), F.struct(F.lit("split").alias("kind"), (F.col("split_new") / F.col("split_old")).alias("factor"))),
        F.when((F.col("last_close") > 0) & (F.col("reference") > 0), F.struct(F.lit("price").alias("kind"), (F.col("last_close") / F.col("reference")).alias("factor"))),
    )
    return wide.select("ticker", "date", F.explode(F.filter(cases, lambda c: c.isNotNull())).alias("a")).select("ticker", "date", "a.*")


def corporate_actions(dividends: DataFrame, capital: DataFrame) -> DataFrame:
    return dividends.select("ticker", F.col("ex_date").alias("date"), "kind", "cash", (1 + F.col("ratio")).alias("factor")).unionByName(capital.select("ticker", "date", "kind", F.lit(0.0).alias("cash"), "factor"))


def adjustment_factors(prices: DataFrame, actions: DataFrame) -> DataFrame:
    """date, ticker, close, factor (cumulative), adj_close.

    An action moves to the first traded row at or after its date; those of one row combine. Its step is the product of the
    stock factors times prev_close / (prev_close - cash); cash of prev_close or more, or without one, is no step.
    """
    traded = prices.where("volume is null or volume > 0").select("ticker", F.col("date").alias("row_date"))
    moved = asof_join(actions, traded, "date", "row_date", ["row_date"], by=["ticker"], forward=True).where("row_date is not null")
    daily = moved.groupBy("ticker", F.col("row_date").alias("date")).agg(F.sum("cash").alias("cash"), F.sum(F.ln("factor")).alias("log_factor"))
    order = Window.partitionBy("ticker").orderBy("date")
    before = F.last("close", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = prices.select("date", "ticker", "close", "volume").join(daily, ["ticker", "date"], "left").withColumn("prev", before)
    cash: Column = F.when((F.col("cash") > 0) & (F.col("prev") > F.col("cash")), F.ln(F.col("prev") / (F.col("prev") - F.col("cash")))).otherwise(0.0)
    step = F.coalesce(F.col("log_factor"), F.lit(0.0)) + F.coalesce(cash, F.lit(0.0))
    factor = F.exp(F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("date", "ticker", "close", factor.alias("factor"), (F.col("close") * factor).alias("adj_close"))


def restart_dates(changed_rows: DataFrame, changed_actions: DataFrame) -> DataFrame:
    """Per ticker the first date from which adjusted prices have to be made again."""
    return changed_rows.select("ticker", "date").unionByName(changed_actions.select("ticker", "date")).groupBy("ticker").agg(F.min("date").alias("start"))


def resume_factors(prices: DataFrame, actions: DataFrame, seeds: DataFrame) -> DataFrame:
    """adjustment_factors for new rows of tickers that have a past: seeds (ticker, factor, close of the row before) or null for a new series.

    With a date (of the row before) in seeds, actions after it and before the first new row move to that row, as in a whole run. A ticker without a seed row is an error, so a lost past is never taken for a new series.
    """
    from .relational import ContractError

    lost = prices.join(seeds, "ticker", "left_anti").select("ticker").limit(1).collect()
    if lost:
        raise ContractError(f"no seed for {lost[0].ticker}")
    first = prices.groupBy("ticker").agg(F.min("date").alias("__first"))
    eve = F.col("date") if "date" in seeds.columns else F.date_sub("__first", 1)
    past = seeds.where("factor is not null").join(first, "ticker").select(F.coalesce(eve, F.date_sub("__first", 1)).alias("date"), "ticker", "close")
    before = past.withColumn("volume", F.lit(None).cast("double"))
    since = first.join(past.select("ticker", F.col("date").alias("__eve")), "ticker", "left").select("ticker", F.coalesce(F.date_add("__eve", 1), "__first").alias("__since"))
    rows = adjustment_factors(prices.select("date", "ticker", "close", F.col("volume").cast("double").alias("volume")).unionByName(before), actions.join(since, "ticker").where("date >= __since").drop("__since"))
    out = rows.join(first, "ticker").where("date >= __first").join(seeds.select("ticker", F.coalesce("factor", F.lit(1.0)).alias("__seed")), "ticker")
    return out.select("date", "ticker", "close", (F.col("factor") * F.col("__seed")).alias("factor"), (F.col("adj_close") * F.col("__seed")).alias("adj_close"))


def price_violations(rows: DataFrame, relative: float = 1e-10, absolute: float = 1e-8) -> DataFrame:
    """Counts over date, ticker, open, high, low, close, factor, adj_close: missing pairs, wrong products, order of prices, bad factors."""
    wanted = F.col("close") * F.col("factor")
    off = F.abs(F.col("adj_close") - wanted) > F.greatest(F.lit(absolute), relative * F.abs(wanted))
    ordered = (F.col("low") <= F.least("open", "close")) & (F.greatest("open", "close") <= F.col("high"))
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(F.col("close").isNull() != F.col("adj_close").isNull()).alias("null_mismatch"), F.count_if(off).alias("product_off"),
        F.count_if(~ordered).alias("disordered"), F.count_if(~(F.col("factor") > 0)).alias("bad_factor"), F.count_if(F.col("close") <= 0).alias("bad_close"),
    )
