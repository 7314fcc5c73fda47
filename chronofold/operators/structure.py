"""Fractional differencing and structural-break statistics."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: response surface of the augmented Dickey-Fuller test with a constant, one variable (MacKinnon 1994 and 2010).
P_SMALL, P_LARGE, P_SPLIT, P_LOW, P_HIGH = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -1.61, -18.83, 2.74
CRITICAL_5 = (-2.86154, -2.8903, -4.234, -40.040)


def ffd_weights(d: float, tolerance: float = 1e-5, most: int = 10_000) -> np.ndarray:
    """Weights of fractional differencing from lag 0 on, until one is below the tolerance."""
    w = [1.0]
    while len(w) < most:
        x = -w[-1] * (d - len(w) + 1) / len(w)
        if abs(x) < tolerance:
            break
        w.append(x)
    return np.array(w)


def fractional_difference(rows: DataFrame, key: str, order: str, value: str, d: float, tolerance: float = 1e-5) -> DataFrame:
    """rows with ffd: the weighted sum over the fixed window, null where the window is not full. One array per key, folded in the JVM."""
    w = ffd_weights(d, tolerance)
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("x")))).alias("s"))
    weights = F.lit(list(map(float, w[::-1])))
    n = len(w)
    at = F.explode(F.sequence(F.lit(1), F.size("s"))).alias("i")
    window = F.slice("s", F.col("i") - n + 1, n)
    total = F.aggregate(F.zip_with(window, weights, lambda x, y: x["x"] * y), F.lit(0.0), lambda a, x: a + x)
    spread = held.select(key, "s", at).select(key, F.element_at("s", F.col("i"))["o"].alias(order), F.when(F.col("i") >= n, total).alias("ffd"))
    return rows.join(spread, [key, order])


def adf(y: np.ndarray, lags: int = 1) -> tuple[float, float, float]:
    """(t statistic, p value, 5 % critical value) of the augmented Dickey-Fuller test with a constant."""
    dy = np.diff(y)
    n = len(dy) - lags
    if n <= lags + 2:
        return math.nan, math.nan, math.nan
    x = np.column_stack([y[lags:-1], *[dy[lags - k : len(dy) - k] for k in range(1, lags + 1)], np.ones(n)])
    b, _, rank, _ = np.linalg.lstsq(x, dy[lags:], rcond=None)
    e = dy[lags:] - x @ b
    if rank < x.shape[1]:
        return math.nan, math.nan, math.nan
    t = b[0] / math.sqrt(e @ e / (n - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])
    if t > P_HIGH:
        p = 1.0
    elif t < P_LOW:
        p = 0.0
    else:
        p = NormalDist().cdf(sum(c * t**k for k, c in enumerate(P_SMALL if t <= P_SPLIT else P_LARGE)))
    return float(t), float(p), sum(c / n**k for k, c in enumerate(CRITICAL_5))


def search_d(y: np.ndarray, alpha: float = 0.05, least: int = 120, tolerance: float = 1e-5) -> list[tuple]:
    """Every order tried: (d, n, statistic, p, passed, chosen). Steps of 0.05 to 1, then whole orders to 5; refined by 0.01 below the first that passes."""
    tried: dict[float, tuple] = {}

    def test(d: float) -> bool:
        w = ffd_weights(d, tolerance)
        x = np.convolve(y, w, "valid") if len(y) >= len(w) else np.zeros(0)
        t, p, limit = adf(x) if len(x) >= least else (math.nan, math.nan, math.nan)
        tried[d] = (d, len(x), t, p, bool(p < alpha and t < limit))
        return tried[d][4]

    found = next((d for d in [*(round(k * 0.05, 2) for k in range(21)), 2.0, 3.0, 4.0, 5.0] if test(d)), None)
    if found is not None and 0 < found <= 1:
        found = next(d for d in [*(round(found - 0.05 + k * 0.01, 2) for k in range(1, 5)), found] if tried.get(d, (0,) * 5)[4] or test(d))
    return [(*r, r[0] == found) for r in sorted(tried.values())]


def choose_d(rows: DataFrame, key: str, order: str, value: str, least: int = 120, tolerance: float = 1e-5) -> DataFrame:
    """The search of search_d for each key's series."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        y = own.sort_values(order)[value].to_numpy(float)
        return pd.DataFrame([(own[key].iloc[0], *r) for r in search_d(y, least=least, tolerance=tolerance)], columns=[key, "d", "n", "statistic", "p_value", "passed", "chosen"])

    return rows.select(key, order, value).groupBy(key).applyInPandas(one, f"{key} string, d double, n long, statistic double, p_value double, passed boolean, chosen boolean")


def start_statistics(y: np.ndarray, end: int, least: int = 60, lags: int = 1) -> np.ndarray:
    """t statistics of the Dickey-Fuller regressions that end at `end` (inclusive) and begin at every earlier place with `least` rows.

    Sums over the rows are built from the end backwards, so all beginnings share them and their systems are solved together.
    """
    dy = np.diff(y[: end + 1])
    n = len(dy) - lags
    if n < least:
        return np.zeros(0)
    # Differences from the last level: the statistic does not change, the sums keep their digits.
    x = np.column_stack([y[lags:end] - y[end], *[dy[lags - k : len(dy) - k] for k in range(1, lags + 1)], np.ones(n)])[::-1]
    z = dy[lags:][::-1]
    xx = np.cumsum(x[:, :, None] * x[:, None, :], axis=0)[least - 1 :]
    xz = np.cumsum(x * z[:, None], axis=0)[least - 1 :]
    zz = np.cumsum(z * z)[least - 1 :]
    count = np.arange(least, n + 1)
    k = x.shape[1]
    out = np.full(len(count), np.nan)
    good = np.linalg.cond(xx) < 1e14
    inverse = np.linalg.inv(xx[good])
    b = np.einsum("nij,nj->ni", inverse, xz[good])
    s2 = (zz[good] - np.einsum("ni,ni->n", b, xz[good])) / (count[good] - k)
    with np.errstate(invalid="ignore", divide="ignore"):
        out[good] = b[:, 0] / np.sqrt(s2 * inverse[:, 0, 0])
    return out


def structural_row(y: np.ndarray, end: int, least: int = 60, lags: int = 1, q: float = 0.95, v: float = 0.025) -> tuple:
    """(sadf, qadf, cadf, q spread, c spread) of the statistics of all beginnings: their largest, their q quantile, the mean of those above it."""
    t = start_statistics(y, end, least, lags)
    t = t[np.isfinite(t)]
    if not len(t):
        return (None,) * 5
    low, mid, high = np.quantile(t, [q - v, q, min(1.0, q + v)])
    above = t[t >= mid]
    return float(t.max()), float(mid), float(above.mean()), float(high - low), float(above.std())


def structural_breaks(rows: DataFrame, key: str, order: str, value: str, least: int = 60, blocks: int = 8) -> DataFrame:
    """SADF, QADF and CADF at every row with a long enough past. A key's ends are dealt to `blocks` tasks; each gets the key's series."""

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order)
        y, at = own[value].to_numpy(float), own[order].to_numpy()
        out = [(own[key].iloc[0], at[end], *structural_row(y, end, least)) for end in range(int(own["block"].iloc[0]), len(y), blocks)]
        return pd.DataFrame(out, columns=[key, order, "sadf", "qadf", "cadf", "q_spread", "c_spread"])

    kind = dict(rows.dtypes)[order]
    spread = rows.select(key, order, value).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.groupBy(key, "block").applyInPandas(one, f"{key} string, {order} {kind}, sadf double, qadf double, cadf double, q_spread double, c_spread double")


def ewm_std(x: np.ndarray, span: int, least: int) -> np.ndarray:
    """Exponentially weighted deviation with the bias taken out (adjust=False), null before `least` values."""
    return pd.Series(x).ewm(span=span, adjust=False, min_periods=least).std().to_numpy()


def ewm_volatility(rows: DataFrame, key: str, order: str, value: str, span: int = 60, least: int = 20) -> DataFrame:
    """rows with sigma, ewm_std of value by key."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order)
        return own.assign(sigma=ewm_std(own[value].to_numpy(float), span, least))

    return rows.groupBy(key).applyInPandas(one, f"{fields}, sigma double")


def ewm_z(rows: DataFrame, key: str, order: str, value: str, span: int = 20) -> DataFrame:
    """rows with z: value against the exponentially weighted mean and deviation of the values before it."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(order)
        past = own[value].shift(1).ewm(span=span, adjust=False, min_periods=span)
        s = past.std()
        return own.assign(z=(own[value] - past.mean()) / s.where(s > 0))

    return rows.groupBy(key).applyInPandas(one, f"{fields}, z double")
