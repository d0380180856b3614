"""Equilibrium rates: aligned series, the rate that a curve implies in the long run, the composite of several models by dated regimes, and bands."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series
from . import joins

# Weights of the models and Taylor coefficients by regime.
REGIME_WEIGHTS = {
    "carry": {"state_space": 0.35, "market_implied": 0.30, "fiscal": 0.15, "parity": 0.10, "regime": 0.10},
    "riskoff": {"state_space": 0.20, "market_implied": 0.25, "fiscal": 0.10, "parity": 0.35, "regime": 0.10},
    "stress": {"state_space": 0.10, "market_implied": 0.15, "fiscal": 0.40, "parity": 0.25, "regime": 0.10},
}
TAYLOR = {"carry": (1.0, 0.3), "riskoff": (0.8, 0.2), "stress": (1.5, 0.1)}


def aligned(frames: dict[str, DataFrame], key: str, at: str, value: str, least: int = 24, empty: float | None = None) -> DataFrame:
    """(key, at, a column for each name) at the times that all non-empty frames (key, at, value) of a key share; a key with fewer than ``least`` of them, or two of such frames, has none.

    One shuffle for any number of frames: they are stacked and turned, not joined one after the other. A frame
    without a row of the key counts as ``empty`` everywhere. Nulls are values like others: forward fill is the caller's choice.
    """
    stacked = reduce(DataFrame.unionByName, (f.select(key, at, F.lit(n).alias("_name"), F.col(value).cast("double").alias("_v")) for n, f in frames.items()))
    rows = stacked.groupBy(key, at).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_v"))).alias("_m"))  # one entry for each frame
    of_key = Window.partitionBy(key)
    have = F.array_distinct(F.flatten(F.collect_set(F.map_keys("_m")).over(of_key)))
    rows = rows.withColumn("_have", F.size(have)).where((F.col("_have") >= 2) & (F.size("_m") == F.col("_have")))
    rows = rows.withColumn("_n", F.count("*").over(of_key)).where(F.col("_n") >= least)
    # a key that is not in the map is an empty frame; a null in it stays
    pick = lambda n: F.when(F.array_contains(F.map_keys("_m"), n), F.col("_m")[n]).otherwise(F.lit(empty).cast("double"))
    return rows.select(key, at, *(pick(n).alias(n) for n in frames))


def _var_mean(factors: np.ndarray) -> np.ndarray:
    """The long-run mean of a VAR(1) with a constant fitted by least squares; the constant alone where there is none."""
    x = np.column_stack([np.ones(len(factors) - 1), factors[:-1]])
    b = np.linalg.lstsq(x, factors[1:], rcond=None)[0]
    try:
        return np.linalg.solve(np.eye(factors.shape[1]) - b[1:].T, b[0])
    except np.linalg.LinAlgError:
        return b[0]


def tenor_weights(n: int) -> np.ndarray:
    """Weights of the tenors from the shortest on: most on the first three."""
    w = np.array([0.5, 0.3, 0.2][:n] if n <= 3 else [0.4, 0.3, 0.2, *[0.1 / (n - 3)] * (n - 3)])
    return w / w.sum()


def long_run_rates(yields: np.ndarray, factors: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Of a window of complete rows: each tenor's long-run level under its leading factors, and what the last row has beyond them."""
    mean = yields.mean(axis=0)
    u, s, v = np.linalg.svd(yields - mean, full_matrices=False)
    k = min(factors, yields.shape[1])
    f = u[:, :k] * s[:k]
    return mean + v[:k].T @ _var_mean(f), yields[-1] - mean - v[:k].T @ f[-1]


def curve_rate(df: DataFrame, key: str, at: str, tenors: list[str], premium: str | None = None, window: int = 60, first: int = 48, factors: int = 3, low: float = 6.0, high: float = 18.0) -> DataFrame:
    """``df`` with curve_rate and curve_premium: at each row with ``first`` and ``window`` complete rows before it, from those and itself alone, the weighted long-run level of the tenors, and what the ``premium`` tenor has beyond its factors.

    Tenors are carried forward first. One key is one group, as long as its history; a row only sees its window.
    """
    w = Window.partitionBy(key).orderBy(at)
    filled = df.withColumns({f"_f_{t}": series.hold(series.known(F.col(t).cast("double")), w) for t in tenors})
    kinds = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "curve_rate double", "curve_premium double"]
    weights, columns = tenor_weights(len(tenors)), df.columns

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(at, kind="stable").reset_index(drop=True)
        x = part[[f"_f_{t}" for t in tenors]].to_numpy(float)
        fine = np.flatnonzero(np.isfinite(x).all(axis=1))
        rate, left = np.full(len(part), np.nan), np.full(len(part), np.nan)
        for n in range(max(first, window), len(fine)):
            level, beyond = long_run_rates(x[fine[n - window : n + 1]], factors)
            rate[fine[n]] = np.clip(level @ weights, low, high)
            if premium is not None:
                left[fine[n]] = beyond[tenors.index(premium)]
        out = part[columns].copy()
        out["curve_rate"], out["curve_premium"] = (pd.Series(v).where(np.isfinite(v), None).astype(float) for v in (rate, left))
        return out

    return filled.groupBy(key).applyInPandas(run, ", ".join(kinds))


def bands(level: Column | str, variance: Column | str, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Standard deviation, lower and upper bound of a filtered level, from its variance (at least 0)."""
    v = series.column(variance)
    std = F.sqrt(F.when(v.isNotNull(), F.greatest(v, F.lit(0.0))))
    return std, series.column(level) - z * std, series.column(level) + z * std


def shares(carry: Column, riskoff: Column, stress: Column) -> dict[str, Column]:
    """Regime probabilities that add up to one; without any, carry is certain."""
    p = {"carry": carry, "riskoff": riskoff, "stress": stress}
    p = {k: F.coalesce(v, F.lit(0.0)) for k, v in p.items()}
    total = sum(p.values(), F.lit(0.0))
    return {k: F.when(total > 0, v / total).otherwise(1.0 if k == "carry" else 0.0) for k, v in p.items()}


def composite_rate(models: DataFrame, history: DataFrame, key: str, at: str, names: list[str], low: float = 2.0, high: float = 10.0) -> DataFrame:
    """``models`` (key, at, a column for each model) with p_carry, p_riskoff, p_stress as last known at each row, the weights w_name and the composite.

    ``history`` has (key, at, carry, riskoff, stress); each row's weights come from the regime of its own date, never from a
    later one. Models are carried forward; one that is not known yet counts as 0, as the weights of all stand.
    """
    dated = joins.asof_join(models, history, key, at, ["carry", "riskoff", "stress"])
    w = Window.partitionBy(key).orderBy(at)
    p = shares(*(F.col(c) for c in ("carry", "riskoff", "stress")))
    dated = dated.withColumns({**{f"p_{k}": v for k, v in p.items()}, **{n: series.hold(n, w) for n in names}}).drop("carry", "riskoff", "stress")
    raw = {n: sum((F.col(f"p_{k}") * REGIME_WEIGHTS[k].get(n, 0.0) for k in p), F.lit(0.0)) for n in names}
    total = sum(raw.values(), F.lit(0.0))
    dated = dated.withColumns({f"w_{n}": F.when(total > 0, v / total).otherwise(0.0) for n, v in raw.items()})
    mix = sum((F.col(f"w_{n}") * F.coalesce(n, F.lit(0.0)) for n in names), F.lit(0.0))
    return dated.withColumn("composite", F.least(F.greatest(mix, F.lit(low)), F.lit(high)))


def output_gap(activity: Column | str, w, rows: int = 60, least: int = 24, most: float = 5.0) -> Column:
    """Activity over its trailing mean in percent, within ``most``; 0 before ``least`` rows."""
    a = series.column(activity)
    gap = (a / series.rolling(F.avg, a, w, rows, least) - 1) * 100
    return F.coalesce(F.least(F.greatest(gap, F.lit(-most)), F.lit(most)), F.lit(0.0))


def policy_rate(composite: DataFrame, inflation: Column, expected: Column | None, goal: Column, gap: Column, w) -> DataFrame:
    """``composite`` with policy_rate: a Taylor rule whose coefficients are those of each row's regime probabilities.

    Expected inflation is carried forward and else the present one; without any (None) the mean of the last six rows' inflation.
    """
    a, b = (sum((F.col(f"p_{k}") * c[n] for k, c in TAYLOR.items()), F.lit(0.0)) for n in (0, 1))
    ahead = F.coalesce(series.hold(expected, w), inflation) if expected is not None else series.rolling(F.avg, inflation, w, 6, 3)
    return composite.withColumn("policy_rate", F.col("composite") + ahead + a * (inflation - goal) + b * gap)
