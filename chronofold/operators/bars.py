"""Information-driven (dollar) bars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK, LEAST_OBSERVED = 60, 20
QUANTILES = tuple(k / 100 for k in range(1, 100))
LEAST_BARS, MOST_DAYS = 120, 60


def baseline(amount: str, key: str, order: str) -> Column:
    """Median of the positive finite amounts among the 60 rows before, if at least 20 are there."""
    c = F.col(amount)
    x = F.when((c > 0) & ~F.isnan(c) & (c < float("inf")), c)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-LOOKBACK, -1)
    return F.when(F.count(x).over(w) >= LEAST_OBSERVED, F.percentile(x, 0.5).over(w))


def close_bars(amounts: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The bar of each day, -1 before the first and in the open tail.

    A bar opens on a day with a threshold, keeps that day's, and closes on the first day whose sum reaches it; what is above doesn't carry over.
    """
    out = np.full(len(amounts), -1, np.int64)
    bar, total, start, limit = 0, 0.0, -1, 0.0
    for i, (a, t) in enumerate(zip(amounts, thresholds)):
        if start < 0:
            if not t > 0:
                continue
            start, total, limit = i, 0.0, t
        total += a if a == a else 0.0
        if total >= limit:
            out[start : i + 1] = bar
            bar, start = bar + 1, -1
    return out


def assign_bars(days: DataFrame, quantile: float, key: str = "etf_id", day: str = "date", amount: str = "etf_amount") -> DataFrame:
    """days with baseline, threshold and bar (null in the open tail).

    Each key's series is one array, walked in one fold inside the JVM; state is the open bar.
    """
    rows = days.withColumn("baseline", baseline(amount, key, day)).withColumn("threshold", F.col("baseline") * quantile)
    item = F.struct(F.col(day).alias("d"), F.col(amount).alias("a"), F.col("threshold").alias("t"))
    series = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("s"))
    fold = """aggregate(s, named_struct('bar', 0L, 'open', false, 'sum', 0D, 'lim', 0D, 'start', 0, 'i', 0, 'cuts', cast(array() as array<struct<a:int,b:int,bar:bigint>>)),
      (z, x) -> if(not z.open and not coalesce(x.t > 0, false), named_struct('bar', z.bar, 'open', false, 'sum', 0D, 'lim', 0D, 'start', 0, 'i', z.i + 1, 'cuts', z.cuts),
        if(if(z.open, z.sum, 0D) + coalesce(x.a, 0D) >= if(z.open, z.lim, x.t),
          named_struct('bar', z.bar + 1, 'open', false, 'sum', 0D, 'lim', 0D, 'start', 0, 'i', z.i + 1, 'cuts', concat(z.cuts, array(named_struct('a', if(z.open, z.start, z.i), 'b', z.i, 'bar', z.bar)))),
          named_struct('bar', z.bar, 'open', true, 'sum', if(z.open, z.sum, 0D) + coalesce(x.a, 0D), 'lim', if(z.open, z.lim, x.t), 'start', if(z.open, z.start, z.i), 'i', z.i + 1, 'cuts', z.cuts))), z -> z.cuts)"""
    closed = series.select(key, "s", F.explode(F.expr(fold)).alias("c"))
    members = closed.select(key, F.col("c.bar").alias("bar"), F.explode(F.expr("slice(s, c.a + 1, c.b - c.a + 1)")).alias("x")).select(key, F.col("x.d").alias(day), "bar")
    return rows.join(members, [key, day], "left")


def bar_table(days: DataFrame, key: str = "etf_id", day: str = "date", price: str = "nav", amount: str = "etf_amount") -> DataFrame:
    """Open, high, low, close, amount, days and log return of each closed bar; days as from assign_bars."""
    at = F.struct(day, price)
    rows = days.where("bar is not null").groupBy(key, "bar").agg(F.min(day).alias("start_date"), F.max(day).alias("end_date"), F.min(at)[price].alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(at)[price].alias("close"), F.sum(amount).alias("amount"), F.count("*").alias("days"), F.min_by("threshold", day).alias("threshold"))
    return rows.withColumn("log_return", F.ln("close") - F.ln(F.lag("close").over(Window.partitionBy(key).orderBy("bar"))))


def calibrate(days: DataFrame, quantiles: tuple[float, ...] = QUANTILES, least_bars: int = LEAST_BARS, most_days: int = MOST_DAYS, key: str = "etf_id", day: str = "date", amount: str = "etf_amount") -> DataFrame:
    """Every quantile of amount / baseline with what it makes of each key: q, ratio, bars and longest bar, ok, and chosen for the
    largest quantile that suits all keys. A task simulates one key with every quantile."""
    rows = days.withColumn("baseline", baseline(amount, key, day))
    ratios = rows.where("baseline > 0").agg(F.percentile(F.col(amount) / F.col("baseline"), list(quantiles)).alias("r"))
    grid = ratios.select(F.explode(F.arrays_zip(F.lit(list(quantiles)).alias("q"), F.col("r").alias("ratio"))).alias("g")).select("g.q", "g.ratio")
    levels = [(r.q, r.ratio) for r in grid.collect()]

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(day)
        a, base, d = own[amount].to_numpy(float), own["baseline"].to_numpy(float), pd.to_datetime(own[day]).to_numpy()
        out = []
        for q, ratio in levels:
            bar = close_bars(a, base * ratio)
            closed = bar >= 0
            spans = pd.DataFrame({"b": bar[closed], "d": d[closed]}).groupby("b")["d"].agg(["min", "max"])
            longest = int(((spans["max"] - spans["min"]).dt.days + 1).max()) if len(spans) else 0
            out.append((own[key].iloc[0], q, ratio, len(spans), longest))
        return pd.DataFrame(out, columns=[key, "q", "ratio", "bars", "longest"])

    found = rows.select(key, day, amount, "baseline").groupBy(key).applyInPandas(one, f"{key} string, q double, ratio double, bars long, longest long")
    good = found.groupBy("q", "ratio").agg(F.min("bars").alias("bars"), F.max("longest").alias("longest"))
    good = good.withColumn("ok", (F.col("bars") >= least_bars) & (F.col("longest") <= most_days))
    return good.withColumn("chosen", F.coalesce(F.col("q") == F.max(F.when(F.col("ok"), F.col("q"))).over(Window.partitionBy(F.lit(0))), F.lit(False)))


def stitch(history: DataFrame, live: DataFrame, key: str = "etf_id") -> DataFrame:
    """Live bars after history's, numbered on, with returns across the seam."""
    last = history.groupBy(key).agg(F.max("bar").alias("__last"))
    moved = live.join(last, key, "left").withColumn("bar", F.col("bar") + F.coalesce(F.col("__last") + 1, F.lit(0))).drop("__last")
    rows = history.unionByName(moved, allowMissingColumns=True)
    return rows.withColumn("log_return", F.ln("close") - F.ln(F.lag("close").over(Window.partitionBy(key).orderBy("bar"))))


def open_tails(days: DataFrame, key: str = "etf_id", day: str = "date", amount: str = "etf_amount") -> DataFrame:
    """The open bar of each key: first day, its threshold, the sum so far; what a later run goes on from."""
    closed = days.groupBy(key).agg(F.max(F.when(F.col("bar").isNotNull(), F.col(day))).alias("__last"))
    rest = days.join(closed, key).where((F.col("__last").isNull() | (F.col(day) > F.col("__last"))))
    opened = rest.groupBy(key).agg(F.min(F.when(F.col("threshold") > 0, F.col(day))).alias("open_date")).where("open_date is not null")
    return rest.join(opened, key).where(F.col(day) >= F.col("open_date")).groupBy(key, "open_date").agg(F.min_by("threshold", day).alias("threshold"), F.sum(amount).alias("amount"), F.count("*").alias("days"))


def resume(amounts: np.ndarray, thresholds: np.ndarray, total: float = 0.0, limit: float = 0.0, is_open: bool = False) -> Iterator[tuple[int, float, float, bool]]:
    """Per day (1 if a bar closes, sum, limit, open) from a checkpoint on."""
    for a, t in zip(amounts, thresholds):
        if not is_open:
            if not t > 0:
                yield 0, 0.0, 0.0, False
                continue
            is_open, total, limit = True, 0.0, t
        total += a if a == a else 0.0
        if total >= limit:
            is_open, total, limit = False, 0.0, 0.0
            yield 1, 0.0, 0.0, False
        else:
            yield 0, total, limit, True
