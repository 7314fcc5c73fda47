"""Statistics that the engine's built-in functions define differently."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _whole(f: Column) -> Column:
    return f


def skewness_unbiased(c: str, over=None) -> Column:
    """Sample skewness with the bias taken out (at least 3 values); over: a window."""
    held = (lambda x: x.over(over)) if over is not None else _whole
    n = held(F.count(c))
    return F.when(n >= 3, held(F.skewness(c)) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def kurtosis_unbiased(c: str, over=None) -> Column:
    """Sample excess kurtosis with the bias taken out (at least 4 values)."""
    held = (lambda x: x.over(over)) if over is not None else _whole
    n = held(F.count(c))
    return F.when(n >= 4, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * held(F.kurtosis(c)) + 6.0))


def classification_metrics(rows: DataFrame, y: str, p: str, w: str, threshold: float = 0.5) -> DataFrame:
    """One row: auc (mid-ranks of tied scores, unweighted), weighted brier, log_loss and f1.

    Ranks come from counts per distinct score, so only those are sorted, not the rows.
    """
    by_score = rows.groupBy(F.col(p).alias("p")).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = by_score.withColumn("mid", below + (F.col("n") + 1) / 2.0)
    area = ranks.agg(F.sum(F.col("mid") * F.col("pos")).alias("r"), F.sum("pos").alias("np"), F.sum("n").alias("n"))
    auc = area.select((F.expr("r - np * (np + 1) / 2.0") / (F.col("np") * (F.col("n") - F.col("np")))).alias("auc"))
    hit, said, yes, weight = F.col(p), F.col(p) >= threshold, F.col(y) == 1, F.col(w)
    chance = F.greatest(F.lit(1e-15), F.when(yes, hit).otherwise(1 - hit))
    sums = rows.agg(
        (F.sum(weight * (hit - F.col(y)) * (hit - F.col(y))) / F.sum(weight)).alias("brier"),
        (-F.sum(weight * F.ln(chance)) / F.sum(weight)).alias("log_loss"),
        (2 * F.sum(F.when(yes & said, weight)) / (F.sum(F.when(yes, weight)) + F.sum(F.when(said, weight)))).alias("f1"),
    )
    return auc.join(F.broadcast(sums))


def normal_cdf(x: float) -> float:
    return NormalDist().cdf(x)


def probabilistic_sharpe(sharpe: float, benchmark: float, n: int, skew: float, kurtosis: float) -> float:
    """Probability that the true Sharpe ratio per period is above the benchmark; kurtosis is 3 for a normal distribution."""
    spread = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    if n < 2 or spread <= 0:
        return math.nan
    return normal_cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(spread))


def expected_best_sharpe(trials: int, variance: float) -> float:
    """Expected largest Sharpe ratio of independent trials without skill."""
    if trials < 2:
        return 0.0
    gamma, z = 0.5772156649015329, NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - gamma) * z(1 - 1 / trials) + gamma * z(1 - 1 / (trials * math.e)))
