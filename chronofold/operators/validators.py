"""Checks of whole tables: counts of what breaks a contract, and guards that fail where something does.

Nulls break a check wherever the contract asks for a value; empty tables break none. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import ContractError

#: The pairs of market and amount state that a daily state may have.
STATES = (("TRADING", "OBSERVED"), ("HALTED", "OBSERVED"), ("HALTED", "ZERO_AUTHORIZED"), ("MISSING", "MISSING"))


def _broken(fine: Column) -> Column:
    """The count of rows for which a check is not true, null included."""
    return F.count_if(~F.coalesce(fine, F.lit(False)))


def _long(counts: DataFrame) -> DataFrame:
    return counts.unpivot([], counts.columns, "check", "violations")


def state_violations(state: DataFrame, master: DataFrame, amount: str = "amount") -> DataFrame:
    """check, violations of a daily market state: repeated keys, pairs of states, tradable, amounts, prices, and the listed days of the master.

    tradable follows the market state (null for MISSING); an observed amount is not negative, an authorized zero is 0, a missing one is null.
    """
    market, source, a = F.col("market_state"), F.col("amount_state"), F.col(amount)
    known = [(market == m) & (source == s) for m, s in STATES]
    pair = known[0] | known[1] | known[2] | known[3]
    tradable = F.col("tradable").eqNullSafe(F.when(market == "TRADING", True).when(market == "HALTED", False))
    right = F.when(source == "OBSERVED", a >= 0).when(source == "ZERO_AUTHORIZED", a == 0).when(source == "MISSING", a.isNull())
    listed = (F.col("_from") <= F.col("date")) & (F.col("_until").isNull() | (F.col("date") < F.col("_until")))
    lives = master.select("ticker", F.col("list_date").alias("_from"), F.col("delist_date").alias("_until"))
    rows = state.drop("_from", "_until").join(lives, "ticker", "left")
    return _long(rows.agg(
        (F.count("*") - F.count_distinct(F.struct("date", "ticker"))).alias("repeated_key"),
        _broken(pair).alias("state_pair"),
        _broken(tradable).alias("tradable"),
        _broken(right).alias("amount"),
        _broken((market != "TRADING") | (F.col("close") > 0)).alias("price"),
        _broken(listed).alias("lifecycle"),
    ))


def bar_violations(bars: DataFrame, labels: DataFrame, key: str = "etf_id") -> DataFrame:
    """check, violations of bars (bar, start_date, end_date) and their labels (bar, t0, t1): repeated keys, gaps, overlaps, labels off their bars."""
    w = Window.partitionBy(key).orderBy("bar")
    before = bars.select(key, "bar", "start_date", "end_date", F.lag("bar").over(w).alias("prior"), F.lag("end_date").over(w).alias("until"))
    one = before.agg(
        (F.count("*") - F.count_distinct(F.struct(key, "bar"))).alias("repeated_bar"),
        F.count_if(F.col("bar") != F.col("prior") + 1).alias("gap"),
        F.count_if(F.col("start_date") <= F.col("until")).alias("overlap"),
        _broken(F.col("start_date") <= F.col("end_date")).alias("bar_order"),
    )
    ends = bars.groupBy(key, "bar").agg(F.max("end_date").alias("ended"))
    named = labels.groupBy(key, "bar").agg(F.count("*").alias("n"), F.min("t0").alias("t0"), F.min("t1").alias("t1"))
    both = named.join(ends, [key, "bar"], "full_outer")
    labelled = F.col("n").isNotNull()
    two = both.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_label"),
        F.count_if(labelled & F.col("ended").isNull()).alias("label_without_bar"),
        F.count_if(~labelled).alias("bar_without_label"),
        F.count_if(labelled & (F.col("t0") != F.col("ended"))).alias("label_start"),
        F.count_if(F.col("t1") < F.col("t0")).alias("label_order"),
    )
    return _long(one).unionByName(_long(two))


def require_none(violations: DataFrame, allowed: Sequence[str] = ()) -> None:
    """Fail if any check but those allowed has violations. A table of checks has a few rows."""
    found = [f"{r.check}: {r.violations}" for r in violations.where("violations > 0").orderBy("check").collect() if r.check not in allowed]
    if found:
        raise ContractError("; ".join(found))


def readiness(bars: DataFrame, least_bars: int = 120, most_days: int = 60, key: str = "etf_id") -> DataFrame:
    """By id: bars, longest, enough, short_enough, ready (both)."""
    enough, short = F.count("*") >= least_bars, F.max("days") <= most_days
    found = bars.groupBy(key).agg(F.count("*").alias("bars"), F.max("days").alias("longest"), enough.alias("enough"), short.alias("short_enough"))
    return found.withColumn("ready", F.col("enough") & F.coalesce("short_enough", F.lit(False)))


def feature_coverage(rows: DataFrame, fold: str, features: Sequence[str]) -> DataFrame:
    """fold, feature, n, known: the values of each feature in each training fold. One aggregation over all features."""
    counts = rows.groupBy(fold).agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in features))
    return counts.unpivot([fold, "n"], list(features), "feature", "known")


def require_coverage(coverage: DataFrame, fold: str = "fold") -> None:
    """Fail if a feature has no value at all in a fold."""
    empty = coverage.where("known = 0").orderBy(fold, "feature").collect()
    if empty:
        raise ContractError("no values: " + "; ".join(f"{r.feature} in fold {r[fold]}" for r in empty))


def gate_metrics(rows: DataFrame, score: str, truth: Column, key: str = "etf_id", threshold: float = 0.5, least: int = 100) -> DataFrame:
    """By id: n, share called, accuracy, precision and recall of score >= threshold against truth, and status.

    Rows without score or truth don't count. status: 'few' below `least` rows, 'one_sided' without a positive or a negative, else 'ok'.
    """
    known = rows.select(key, F.col(score) >= threshold, truth).toDF(key, "called", "positive").where("called is not null and positive is not null")
    hit = F.count_if(F.col("called") & F.col("positive"))
    called, positive, n = F.count_if("called"), F.count_if("positive"), F.count("*")
    status = F.when(n < least, "few").when((positive == 0) | (positive == n), "one_sided").otherwise("ok")
    return known.groupBy(key).agg(
        n.alias("n"), (called / n).alias("share"), (F.count_if(F.col("called") == F.col("positive")) / n).alias("accuracy"),
        F.when(called > 0, hit / called).alias("precision"), F.when(positive > 0, hit / positive).alias("recall"), status.alias("status"),
    )
