"""Trailing features of bars, of the market index and of holdings.

Every function of rows adds its columns to the rows it gets, in place of columns of the same names, and keeps each row, repeated ones too.
`along` is (key, order): windows count rows of a key in that order, so with repeated (key, order) the order among equals is undefined.
Windows without their number of non-null observations give null; empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.statistics import kurtosis_unbiased, skewness_unbiased

from .relational import asof_join
from .signals import full, trailing

Along = tuple[str, str]
BAR: Along = ("etf_id", "bar")
YEAR = 252.0


def difference(rows: DataFrame, value: str, name: str, along: Along = BAR) -> DataFrame:
    """The change of a value against the row before."""
    key, order = along
    return rows.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order)))


def moving_mean(rows: DataFrame, value: str, along: Along = BAR, n: int = 20) -> DataFrame:
    """mean, distance from it, and z: the distance in sample deviations, null where these are 0."""
    w = trailing(*along, n)
    mean, deviation = full(F.avg, value, w, n), full(F.stddev_samp, value, w, n)
    far = F.col(value) - mean
    return rows.withColumns({"mean": mean, "distance": far, "z": F.when(deviation > 0, far / deviation)})


def deviations(rows: DataFrame, level: str, change: str, along: Along = BAR, windows: tuple[int, ...] = (14, 60)) -> DataFrame:
    """level<n> and change<n>: sample deviations of a level and of its changes over n rows."""
    spans = {n: trailing(*along, n) for n in windows}
    names = {f"{kind}{n}": full(F.stddev_samp, c, w, n) for n, w in spans.items() for kind, c in (("level", level), ("change", change))}
    return rows.withColumns(names)


def shape(rows: DataFrame, value: str, along: Along = BAR, n: int = 60, least: int = 30) -> DataFrame:
    """skew and kurt, unbiased, over n rows with at least `least` values."""
    w = trailing(*along, n)
    enough = F.count(value).over(w) >= least
    return rows.withColumns({"skew": F.when(enough, skewness_unbiased(value, w)), "kurt": F.when(enough, kurtosis_unbiased(value, w))})


def downside(rows: DataFrame, change: str, along: Along = BAR, n: int = 60, least: int = 30) -> DataFrame:
    """vol, and downside: the root of the mean square of negative changes, where others count as 0."""
    w = trailing(*along, n)
    c = F.col(change)
    square = F.when(c.isNotNull(), F.pow(F.least(c, F.lit(0.0)), 2))
    enough = F.count(change).over(w) >= least
    return rows.withColumns({"vol": F.when(enough, F.stddev_samp(change).over(w)), "downside": F.when(enough, F.sqrt(F.avg(square).over(w)))})


def efficiency(rows: DataFrame, level: str, change: str, along: Along = BAR, n: int = 20) -> DataFrame:
    """efficiency: the way made over n rows against the path walked, null for a path of 0."""
    key, order = along
    w = trailing(key, order, n)
    path = F.when(F.count(change).over(w) >= n, F.sum(F.abs(change)).over(w))
    made = F.abs(F.col(level) - F.lag(level, n).over(Window.partitionBy(key).orderBy(order)))
    return rows.withColumn("efficiency", F.when(path > 0, made / path))


def drawdown(rows: DataFrame, level: str, along: Along = BAR, n: int = 60) -> DataFrame:
    """drawdown: a log level against its highest of the last n rows, or of as many as there are."""
    return rows.withColumn("drawdown", F.col(level) - F.max(level).over(trailing(*along, n)))


def bar_shape(bars: DataFrame, along: Along = BAR, n: int = 20) -> DataFrame:
    """range, log_amount, surprise (days against the median of the n bars before) and amount_ratio (against their mean)."""
    w = trailing(*along, n, 1)
    days = F.when(F.count("days").over(w) == n, F.col("days") / F.percentile("days", 0.5).over(w))
    amount = F.when(F.count("amount").over(w) == n, F.col("amount") / F.avg("amount").over(w))
    return bars.withColumns({"range": (F.col("high") - F.col("low")) / F.col("close"), "log_amount": F.log1p("amount"), "surprise": days, "amount_ratio": amount})


def trend(rows: DataFrame, value: str, along: Along = BAR, n: int = 20) -> DataFrame:
    """slope of a least-squares line through n rows and its t statistic; both null unless the slope's standard error is positive.

    The order column must rise by one a row, as bars do.
    """
    order = along[1]
    w = trailing(*along, n)
    sxx, syy, sxy = (f(value, order).over(w) for f in (F.regr_sxx, F.regr_syy, F.regr_sxy))
    rest = F.greatest(syy - sxy * sxy / sxx, F.lit(0.0))
    error = F.sqrt(rest / (n - 2) / sxx)
    known = (F.count(value).over(w) == n) & (error > 0)
    slope = sxy / sxx
    return rows.withColumns({"slope": F.when(known, slope), "t": F.when(known, slope / error)})


def amihud(rows: DataFrame, change: str, amount: str, along: Along = BAR, n: int = 20) -> DataFrame:
    """amihud: absolute change against amount, null for an amount of 0; amihud_mean over n rows; slope and t of its trend."""
    traded = F.when(F.col(amount) != 0, F.col(amount))
    level = rows.withColumn("amihud", F.abs(F.col(change)) / traded)
    return trend(level.withColumn("amihud_mean", full(F.avg, "amihud", trailing(*along, n), n)), "amihud", along, n)


def roll_spread(rows: DataFrame, change: str, along: Along = BAR, n: int = 20) -> DataFrame:
    """spread from the covariance of a change with the one before; spread_reason where there is none: 'short', 'non_negative_covariance'."""
    key, order = along
    w = trailing(key, order, n)
    lagged = rows.withColumn("_before", F.lag(change).over(Window.partitionBy(key).orderBy(order)))
    both = F.when(F.col("_before").isNotNull(), F.col(change))
    count, covariance = F.count(both).over(w), F.covar_samp(both, F.col("_before")).over(w)
    spread = F.when((count == n) & (covariance < 0), 2 * F.sqrt(-covariance))
    reason = F.when(count < n, "short").when(covariance >= 0, "non_negative_covariance")
    return lagged.withColumns({"spread": spread, "spread_reason": reason}).drop("_before")


def bar_features(bars: DataFrame, along: Along = BAR) -> DataFrame:
    """All features of closed bars (high, low, close, amount, days): one shuffle and one sort by `along`, as every window shares them."""
    rows = difference(bars.withColumn("y", F.ln("close")), "y", "d", along)
    steps = (
        lambda x: moving_mean(x, "y", along),
        lambda x: deviations(x, "y", "d", along),
        lambda x: shape(x, "d", along),
        lambda x: downside(x, "d", along),
        lambda x: efficiency(x, "y", "d", along),
        lambda x: drawdown(x, "y", along),
        lambda x: bar_shape(x, along),
        lambda x: amihud(x, "d", "amount", along),
        lambda x: roll_spread(x, "d", along),
    )
    return reduce(lambda x, f: f(x), steps, rows)


def lagged_baseline(rows: DataFrame, value: str, along: Along, n: int = 60, least: int = 20) -> DataFrame:
    """baseline: median of the n rows before the row, of which at least `least` are positive and finite; others count as missing."""
    c = F.col(value).cast("double")
    w = trailing(*along, n, 1)
    sound = rows.withColumn("_sound", F.when((c > 0) & (c < float("inf")) & ~F.isnan(c), c))
    return sound.withColumn("baseline", F.when(F.count("_sound").over(w) >= least, F.percentile("_sound", 0.5).over(w))).drop("_sound")


def index_total(index: DataFrame, calendar: DataFrame, formations: DataFrame, n: int = 20) -> DataFrame:
    """formation_date, total: the index's traded value over the n sessions to each formation.

    The job fails for a formation that is no session or has fewer than n sessions, for a missing, negative or infinite amount among them and for
    a sum of 0. index: date, traded_value, one row a date. One row a session, so the window needs no key.
    """
    w = Window.orderBy("date").rowsBetween(-(n - 1), 0)
    c = F.col("traded_value").cast("double")
    days = calendar.select("date").join(index.select("date", F.when((c >= 0) & (c < float("inf")), c).alias("v")), "date", "left")
    sums = days.select(F.col("date").alias("formation_date"), full(F.sum, "v", w, n).alias("total"))
    rows = formations.select("formation_date").join(sums, "formation_date", "left")
    message = F.concat(F.lit("the index has no complete window at "), F.col("formation_date").cast("string"))
    return rows.select("formation_date", F.when(F.col("total") > 0, F.col("total")).otherwise(F.raise_error(message).cast("double")).alias("total"))


def index_features(index: DataFrame, value: str, windows: tuple[int, ...] = (20, 60)) -> DataFrame:
    """By date: d, the log change; vol<n>, its deviation; drawdown from the highest so far. One row a session."""
    order = Window.orderBy("date")
    rows = index.select("date", F.ln(value).alias("y"))
    rows = rows.withColumn("d", F.col("y") - F.lag("y").over(order))
    vols = {f"vol{n}": full(F.stddev_samp, "d", order.rowsBetween(1 - n, 0), n) for n in windows}
    peak = F.max("y").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns(vols | {"drawdown": F.col("y") - peak}).drop("y")


def realized_volatility(index: DataFrame, value: str, windows: tuple[int, ...] = (20, 60)) -> DataFrame:
    """By date: realized<n>, the yearly deviation of log changes over n sessions."""
    rows = index_features(index, value, windows)
    return rows.select("date", *((F.col(f"vol{n}") * F.sqrt(F.lit(YEAR))).alias(f"realized{n}") for n in windows))


def bar_return_deviation(bars: DataFrame, along: Along = BAR, n: int = 14) -> DataFrame:
    """bar_deviation: the deviation of the last n log returns of bars."""
    rows = difference(bars.withColumn("_y", F.ln("close")), "_y", "_d", along)
    return rows.withColumn("bar_deviation", full(F.stddev_samp, "_d", trailing(*along, n), n)).drop("_y", "_d")


def aligned(rows: DataFrame, on: str, observed: DataFrame, values: list[str], calendar: DataFrame, most: int = 1) -> DataFrame:
    """Observations (date, values) as of each row's session, with their age in sessions; null and 'stale' beyond `most` sessions, 'missing' without any.

    calendar: date, session_idx. A day's session is the last one up to it; before the first there is none, and the age is null. Of observations with
    equal dates the one with the largest values counts.
    """
    days = calendar.select(F.col("date").alias("_day"), F.col("session_idx").cast("long").alias("_at"))
    seen = asof_join(observed.select(F.col("date").alias("_seen"), *values), days, "_seen", "_day", ["_at"]).withColumnRenamed("_at", "_known")
    here = asof_join(rows.drop(*values), days, on, "_day", ["_at"])
    found = asof_join(here, seen, on, "_seen", ["_seen", "_known", *values], tie=values)
    age = F.col("_at") - F.col("_known")
    stale = F.coalesce(age > most, F.lit(False))
    out = found.withColumns({"age": age, "reason": F.when(F.col("_seen").isNull(), "missing").when(stale, "stale")})
    return out.withColumns({c: F.when(~stale, F.col(c)) for c in values}).drop("_at", "_known", "_seen")


def z_score(rows: DataFrame, value: str, along: Along, n: int = 20) -> DataFrame:
    """z of the value against its last n rows, itself included; null where they don't differ."""
    w = trailing(*along, n)
    deviation = full(F.stddev_samp, value, w, n)
    return rows.withColumn("z", F.when(deviation > 0, (F.col(value) - F.avg(value).over(w)) / deviation))


def monthly_changes(holdings: DataFrame) -> DataFrame:
    """etf_id, month, replaced, turnover: the holdings (date, etf_id, ticker, w) at a portfolio's last day of a month against its month before.

    replaced is the share of the earlier names that are gone, turnover half the sum of absolute changes of weights; null in the first month.
    The month before is the last one with holdings, be it adjacent or not. One row per date, id and ticker.
    """
    key = Window.partitionBy("etf_id", "month")
    rows = holdings.select("date", "etf_id", "ticker", "w", F.trunc("date", "month").alias("month"))
    ends = rows.withColumn("_last", F.max("date").over(key)).where(F.col("date") == F.col("_last")).drop("date", "_last")
    months = ends.select("etf_id", "month").distinct()
    before = months.withColumn("prior", F.lag("month").over(Window.partitionBy("etf_id").orderBy("month")))
    old = ends.select("etf_id", F.col("month").alias("prior"), "ticker", F.col("w").alias("old")).join(before.where("prior is not null"), ["etf_id", "prior"])
    both = ends.withColumnRenamed("w", "new").join(old.drop("prior"), ["etf_id", "month", "ticker"], "full")
    zero = F.lit(0.0)
    kept = F.count_if(F.col("new").isNotNull() & F.col("old").isNotNull())
    moved = F.sum(F.abs(F.coalesce("new", zero) - F.coalesce("old", zero)))
    found = both.groupBy("etf_id", "month").agg(F.count("old").alias("n"), kept.alias("kept"), moved.alias("moved"))
    known = F.col("n") > 0
    return found.select("etf_id", "month", F.when(known, 1 - F.col("kept") / F.col("n")).alias("replaced"), F.when(known, F.col("moved") / 2).alias("turnover"))


def performance(curve: DataFrame, key: str = "etf_id") -> DataFrame:
    """By key of a curve (date, nav): max_drawdown, and yearly sharpe and vol of its daily returns."""
    order = Window.partitionBy(key).orderBy("date")
    fall: Column = F.col("nav") / F.max("nav").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    rows = curve.select(key, fall.alias("fall"), (F.col("nav") / F.lag("nav").over(order) - 1).alias("ret"))
    year, deviation = F.sqrt(F.lit(YEAR)), F.stddev_samp("ret")
    return rows.groupBy(key).agg(F.min("fall").alias("max_drawdown"), F.when(deviation > 0, F.avg("ret") / deviation * year).alias("sharpe"), (deviation * year).alias("vol"))
