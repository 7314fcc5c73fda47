"""Out-of-fold models, state machines, ledgers, allocation and acceptance."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.statistics import expected_best_sharpe, probabilistic_sharpe

from .relational import ContractError

#: Columns that tell the outcome and so may not reach a decision.
OUTCOMES = frozenset({"label", "t1", "exit_date", "exit_price", "outcome", "net_return", "realized_return", "mfe", "mae"})


def forbid_outcomes(df: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """df itself, if none of its columns tells the outcome."""
    bad = sorted(c for c in df.columns if c.lower() in OUTCOMES and c not in allowed)
    if bad:
        raise ContractError(f"outcome columns in a decision table: {bad}")
    return df


def oof_predictions(rows: DataFrame, features: Sequence[str], label: str, weight: str, key: Sequence[str], model: str = "logistic") -> DataFrame:
    """key, fold and p of every validation row of rows (fold, part in train and validation): median imputation, standard scale, model.

    There are few folds; each fit is distributed. A feature without any training value in a fold is an error.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    if model not in ("logistic", "gbt"):
        raise ValueError(f"unknown model {model!r}")
    typed = rows.select(*key, "fold", "part", F.col(label).cast("double").alias("__y"), F.col(weight).cast("double").alias("__w"), *[F.col(c).cast("double").alias(c) for c in features])
    known = typed.where("part = 'train'").groupBy("fold").agg(*[F.count(c).alias(c) for c in features]).collect()
    empty = [(r.fold, c) for r in known for c in features if not r[c]]
    if empty:
        raise ContractError(f"features without training values: {empty}")
    out = None
    filled = [f"__f{k}" for k in range(len(features))]
    for fold in sorted(r.fold for r in known):
        own = typed.where(F.col("fold") == fold)
        last = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", regParam=0.01) if model == "logistic" else GBTClassifier(featuresCol="__x", labelCol="__y", weightCol="__w", maxIter=20, maxDepth=3, stepSize=0.05, seed=0)
        steps = [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__v"), StandardScaler(inputCol="__v", outputCol="__x", withMean=True), last]
        fitted = Pipeline(stages=steps).fit(own.where("part = 'train'"))
        scored = fitted.transform(own.where("part = 'validation'")).select(*key, "fold", vector_to_array("probability")[1].alias("p"))
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        return typed.select(*key, "fold", F.lit(None).cast("double").alias("p")).limit(0)
    return out


def best_threshold(rows: DataFrame, p: str, gain: str, weight: str, grid: Sequence[float] = (0.5, 0.55, 0.6, 0.65, 0.7), least_share: float = 0.1) -> DataFrame:
    """The threshold with the best weighted gain among those that keep at least 10 % of the weight, in one pass."""
    levels = F.explode(F.lit(list(grid))).alias("threshold")
    total = rows.agg(F.sum(weight).alias("total"))
    kept = rows.select(p, gain, weight, levels).where(F.col(p) >= F.col("threshold"))
    sums = kept.groupBy("threshold").agg((F.sum(F.col(gain) * F.col(weight)) / F.sum(weight)).alias("gain"), F.sum(weight).alias("kept"))
    return sums.join(F.broadcast(total)).where(F.col("kept") >= least_share * F.col("total")).orderBy(F.desc("gain"), "threshold").limit(1).select("threshold", "gain", (F.col("kept") / F.col("total")).alias("share"))


def cusum_states(rows: DataFrame, key: str, order: str, p: str, enter: float = 0.20, leave: float = -0.10) -> DataFrame:
    """rows' key and order with score (after), state (after) and transition.

    Flat, only evidence for (p - 0.5, summed, never below 0) counts; long, only evidence against (never above 0). Reaching a limit changes the
    state and clears the score. One array per key, one fold in the JVM.
    """
    if not (enter > 0 > leave):
        raise ValueError("enter has to be positive and leave negative")
    series = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(p).cast("double").alias("p")))).alias("s"))
    fold = f"""aggregate(s, named_struct('score', 0D, 'long', false, 'out', cast(array() as array<struct<o:bigint,score:double,state:string,transition:string>>)),
      (z, x) -> element_at(transform(array(if(z.long, least(0D, z.score + x.p - 0.5D), greatest(0D, z.score + x.p - 0.5D))), v ->
        element_at(transform(array(if(z.long, v <= {leave}D + 1e-12D, v >= {enter}D - 1e-12D)), c ->
          named_struct('score', if(c, 0D, v), 'long', if(c, not z.long, z.long), 'out', concat(z.out, array(named_struct('o', cast(x.o as bigint), 'score', if(c, 0D, v), 'state', if(if(c, not z.long, z.long), 'long', 'flat'), 'transition', if(c, if(z.long, 'long_to_flat', 'flat_to_long'), cast(null as string))))))), 1)), 1), z -> z.out)"""
    return series.select(key, F.explode(F.expr(fold)).alias("x")).select(key, F.col("x.o").alias(order), "x.score", "x.state", "x.transition")


def transition_ledger(rows: DataFrame, key: str = "etf_id", capital: float = 1_000_000.0, buy_rate: float = 0.001425, sell_rate: float = 0.003, least_fee: float = 1.0) -> DataFrame:
    """Trades of a key's transitions at their execution prices: whole shares, fees within the cash there is, all shares out.

    rows: key, date, transition, price (of the next legal open; null: none came, no trade). Cash goes from trade to trade, so each key is a kernel.
    """

    def one(own: pd.DataFrame) -> pd.DataFrame:
        cash, shares, out = capital, 0, []
        for r in own.sort_values("date").itertuples():
            if not r.price > 0:
                continue
            if r.transition == "flat_to_long" and not shares:
                n = int(cash // r.price)
                while n > 0 and n * r.price + max(n * r.price * buy_rate, least_fee) > cash + 1e-10:
                    n -= 1
                if n:
                    fee = max(n * r.price * buy_rate, least_fee)
                    cash, shares = cash - n * r.price - fee, n
                    out.append((getattr(r, key), r.date, "buy", n, r.price, fee, cash))
            elif r.transition == "long_to_flat" and shares:
                fee = max(shares * r.price * sell_rate, least_fee)
                cash += shares * r.price - fee
                out.append((getattr(r, key), r.date, "sell", shares, r.price, fee, cash))
                shares = 0
        return pd.DataFrame(out, columns=[key, "date", "side", "shares", "price", "fee", "cash"])

    return rows.select(key, "date", "transition", "price").groupBy(key).applyInPandas(one, f"{key} string, date date, side string, shares long, price double, fee double, cash double")


def leaf_order(distance: np.ndarray) -> list[int]:
    """Leaves of a single-linkage tree, left to right; clusters are joined by distance, and of a join the older cluster is left."""
    clusters: list[tuple[int, list[int]]] = [(k, [k]) for k in range(len(distance))]
    serial = len(distance)
    while len(clusters) > 1:
        best = min((distance[np.ix_(a[1], b[1])].min(), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        _, i, j = best
        a, b = sorted((clusters[i], clusters[j]))
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [(serial, a[1] + b[1])]
        serial += 1
    return clusters[0][1]


def hierarchical_weights(cov: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: leaves in tree order, halved again and again, each half by the other's variance."""
    std = np.sqrt(np.diag(cov))
    cor = cov / np.outer(std, std)
    order = leaf_order(np.sqrt(np.clip((1 - cor) / 2, 0, 1)))
    weights = np.ones(len(cov))

    def variance(at: list[int]) -> float:
        inverse = 1 / np.diag(cov)[at]
        inverse /= inverse.sum()
        return float(inverse @ cov[np.ix_(at, at)] @ inverse)

    parts = [order]
    while parts:
        part = parts.pop()
        if len(part) > 1:
            left, right = part[: len(part) // 2], part[len(part) // 2 :]
            a, b = variance(left), variance(right)
            weights[left] *= b / (a + b)
            weights[right] *= a / (a + b)
            parts += [left, right]
    return weights / weights.sum()


def allocate(returns: DataFrame, ids: Sequence[str], policy: str, least: int = 20) -> tuple[str, dict[str, float]]:
    """(status, weights by id) from date, etf_id, ret on the dates all ids have. Only the moments of the few ids come to the driver."""
    if policy not in ("equal_capital", "inverse_vol", "hrp"):
        raise ValueError(f"unknown policy {policy!r}")
    ids = sorted(set(ids))
    if len(ids) < 2:
        return "INSUFFICIENT_CROSS_ETF_UNIVERSE", {}
    columns = [f"r{k}" for k in range(len(ids))]
    wide = returns.groupBy("date").pivot("etf_id", ids).agg(F.first("ret")).toDF("date", *columns).dropna()
    pairs = [(i, j) for i in range(len(ids)) for j in range(i, len(ids))]
    row = wide.agg(F.count("*").alias("n"), *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if row.n < least:
        return "INSUFFICIENT_COMMON_HISTORY", {}
    cov = np.zeros((len(ids), len(ids)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    if not (np.diag(cov) > 0).all():
        return "INVALID_PAST_VOLATILITY", {}
    if policy == "equal_capital":
        w = np.full(len(ids), 1 / len(ids))
    elif policy == "inverse_vol":
        w = 1 / np.sqrt(np.diag(cov))
        w /= w.sum()
    else:
        w = hierarchical_weights(cov)
    return "READY", dict(zip(ids, map(float, w)))


@dataclass(frozen=True)
class SharpeEvidence:
    n: int
    sharpe: float
    annual: float
    skew: float
    kurtosis: float
    psr: float
    dsr: float | None


def sharpe_evidence(returns: DataFrame, column: str, trials: int | None = None, trial_variance: float | None = None, year: int = 252) -> SharpeEvidence:
    """Moments in one aggregation; the probability that the Sharpe ratio is above 0, and above the best of `trials` without skill.

    trial_variance: of the trials' annualized Sharpe ratios.
    """
    r = returns.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), F.avg(column).alias("m"), F.stddev_samp(column).alias("s"), F.skewness(column).alias("g"), F.kurtosis(column).alias("k")).first()
    if not r.s:
        raise ContractError("returns without variation")
    sharpe = r.m / r.s
    n = r.n
    skew = r.g * math.sqrt(n * (n - 1)) / (n - 2)
    kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * r.k + 6) + 3
    psr = probabilistic_sharpe(sharpe, 0.0, n, skew, kurtosis)
    dsr = None if not trials or trials < 2 or not trial_variance else probabilistic_sharpe(sharpe, expected_best_sharpe(trials, trial_variance) / math.sqrt(year), n, skew, kurtosis)
    return SharpeEvidence(n, sharpe, sharpe * math.sqrt(year), skew, kurtosis, psr, dsr)


#: The fixed gate of acceptance.
LEAST_DSR = 0.95
POLICIES = frozenset({"equal_capital", "inverse_vol", "hrp"})


def acceptance(sealed: bool, tiers_passed: Sequence[bool], ledger_ready: bool, policies: Sequence[str], dsr: float | None) -> dict:
    """Status and what is missing for it."""
    if dsr is not None and not 0 <= dsr <= 1:
        raise ValueError("a probability is outside 0 to 1")
    checks = {"sealed_test": sealed, **{f"tier{k}_passed": ok for k, ok in enumerate(tiers_passed, 2)}, "reconciled_ledger": ledger_ready, "all_policies": POLICIES <= set(policies), "dsr": dsr is not None, "dsr_at_least_0_95": dsr is not None and dsr >= LEAST_DSR}
    missing = [k for k, ok in checks.items() if not ok]
    return {"status": "NOT_READY" if missing else "PAPER_TRADE_ELIGIBLE", "missing": missing}


def meta_frame(candidates: DataFrame, targets: DataFrame, clock_a: str, clock_b: str, key: Sequence[str]) -> DataFrame:
    """Candidates with their targets, one to one, known from the later of both clocks on."""
    from .relational import checked_join

    rows = checked_join(candidates, targets, key, "inner1", "1:1")
    later: Column = F.greatest(clock_a, clock_b)
    return rows.withColumn("known_at", later)
