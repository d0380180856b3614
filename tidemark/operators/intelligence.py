"""Online intelligence: intervals, sizing, meta-labels, weights and selection, all strictly causal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series


def conformal_width(error: Column, w, alpha: float = 0.1, least: int = 24) -> Column:
    """The half-width that covers 1 - alpha of the absolute errors before the current row: the quantile of level ceil((m + 1)(1 - alpha)) / m, higher."""
    past = F.array_sort(F.collect_list(F.abs(error)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    m = F.size(past)
    level = F.least(F.lit(1.0), F.ceil((m + 1) * (1 - alpha) - 1e-12) / m)
    return F.when(m >= least, F.get(past, F.least(F.ceil(level * (m - 1) - 1e-9), m - 1).cast("int")))


def interval_confidence(width: Column | str, w, least: int = 24) -> Column:
    """The expanding median width over the current one, at most 1."""
    v = series.column(width)
    ratio = series.rolling(series.quantile(0.5), v, w, None, least) / F.when(v > 0, v)
    return F.when(ratio.isNotNull(), F.least(ratio, F.lit(1.0)))


def confidence_scaled(position: Column, confidence: Column, w, low: float = 0.25, high: float = 1.0) -> Column:
    """The position scaled between ``low`` and ``high`` by the confidence's expanding rank."""
    return position * (low + (high - low) * series.expanding_rank(confidence, w))


def inverse_vol(position: Column, vol: Column, target: float = 0.1, most: float = 2.0) -> Column:
    """The position at a target annual volatility, its leverage capped; null without volatility."""
    return position * F.least(target / (F.when(vol > 0, vol) * 12**0.5), F.lit(most))


def meta_label(position: Column, forward: Column) -> Column:
    """1 where the position has the sign of its outcome, 0 where not, null where either is undefined or flat."""
    return F.when((position != 0) & forward.isNotNull(), (F.signum(position) == F.signum(forward)).cast("int"))


def normalized(raw: Column, by: list[str], floor: float = 0.0) -> Column:
    """Positive parts over their sum among the rows of equal ``by``; equal shares where nothing is positive. Null is absent."""
    w = Window.partitionBy(*by)
    part = F.when(raw.isNotNull(), F.greatest(raw, F.lit(floor)))
    total, n = F.sum(part).over(w), F.count(part).over(w)
    return F.when(part.isNotNull(), F.when(total > 0, part / total).otherwise(1 / n))


def inverse_variance_weights(df: DataFrame, asset: str, at: str, value: str, rows: int = 12, least: int = 12) -> DataFrame:
    """``df`` with weight: one over the variance of the ``rows`` returns before, normalised at each time."""
    w = Window.partitionBy(asset).orderBy(at)
    frame = w.rowsBetween(-rows, -1)
    var = F.when(F.count(value).over(frame) >= least, F.var_samp(value).over(frame))
    return df.withColumn("_raw", F.when(F.col(value).isNotNull(), 1 / F.when(var > 0, var))).withColumn("weight", normalized(F.col("_raw"), [at])).drop("_raw")


def ewma_performance_weights(df: DataFrame, asset: str, at: str, value: str, halflife: float = 12.0, least: int = 12, floor: float = 0.0) -> DataFrame:
    """``df`` with weight: the exponentially weighted Sharpe ratio of the time before, positive parts normalised at each time."""
    e = series.ewm(df, asset, at, value, halflife=halflife, least=least)
    sharpe = F.lag(F.col("ewm_mean") / F.when(F.col("ewm_std") > 0, F.col("ewm_std"))).over(Window.partitionBy(asset).orderBy(at))
    return e.withColumn("_raw", F.when(F.col(value).isNotNull(), sharpe)).withColumn("weight", normalized(F.col("_raw"), [at], floor)).drop("_raw", "ewm_mean", "ewm_std")


def selected(df: DataFrame, at: str, name: str, score: str, top: int | None = None, threshold: float | None = None) -> DataFrame:
    """``df`` with selected: the ``top`` scores of each time (ties by name), those at ``threshold`` or above, or those above zero."""
    if top is not None:
        rank = F.row_number().over(Window.partitionBy(at).orderBy(F.col(score).desc_nulls_last(), name))
        return df.withColumn("selected", F.col(score).isNotNull() & (rank <= top))
    return df.withColumn("selected", F.coalesce(F.col(score) >= threshold if threshold is not None else F.col(score) > 0, F.lit(False)))


def combined_signal(df: DataFrame, at: str, z: str, sign: str) -> DataFrame:
    """(at, signal): the mean of sign times z over the selected features; null where none is."""
    return df.groupBy(at).agg(F.avg(F.when(F.col("selected"), F.col(sign) * F.col(z))).alias("signal"))


def logistic(x: np.ndarray, y: np.ndarray, at: np.ndarray, l2: float = 1.0, steps: int = 50) -> np.ndarray:
    """Probabilities at ``at`` of an L2 logistic regression on train-standardised features by Newton steps."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    a = np.column_stack([np.ones(len(x)), (x - mean) / sd])
    penalty = l2 * np.eye(a.shape[1])
    penalty[0, 0] = 0
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(b)), a.T @ (y - p) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    z = np.column_stack([np.ones(len(at)), (at - mean) / sd])
    return 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))


def meta_probability(df: DataFrame, key: str, at: str, features: list[str], label: str, least: int = 36, l2: float = 1.0) -> DataFrame:
    """``df`` with proba: at each row, a logistic regression refitted on the rows before whose label is known. Series run in parallel."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "proba double"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(at, kind="stable").reset_index(drop=True)
        x, y = rows[features].to_numpy(float), rows[label].to_numpy(float)
        whole = np.isfinite(x).all(axis=1)
        out = np.full(len(rows), np.nan)
        for t in range(len(rows)):
            own = np.flatnonzero(whole[:t] & np.isfinite(y[:t]))
            if whole[t] and len(own) >= least and 0 < y[own].mean() < 1:
                out[t] = logistic(x[own], y[own], x[t : t + 1], l2)[0]
        rows["proba"] = pd.Series(out).where(np.isfinite(out), None).astype(float)
        return rows

    return df.groupBy(key).applyInPandas(run, schema)


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float, l1_ratio: float, steps: int = 200) -> np.ndarray:
    """Coefficients of an elastic net on standardised columns by coordinate descent."""
    n, p = x.shape
    b, rest = np.zeros(p), y - y.mean()
    scale = (x * x).sum(axis=0) / n
    for _ in range(steps):
        before = b.copy()
        for j in range(p):
            if scale[j] == 0:
                continue
            rho = x[:, j] @ rest / n + scale[j] * b[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / (scale[j] + alpha * (1 - l1_ratio))
            rest -= x[:, j] * (new - b[j])
            b[j] = new
        if np.abs(b - before).max() < 1e-8:
            break
    return b


def rolling_importance(df: DataFrame, key: str, at: str, features: list[str], target: str, rows: int = 60, least: int = 36, alpha: float = 0.1, l1_ratio: float = 0.5, bootstraps: int = 0, seed: int = 0) -> DataFrame:
    """(key, at, feature, importance): absolute coefficients fitted on the complete rows among the ``rows`` before; with ``bootstraps``, the share of resamples that select the feature."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(at, kind="stable").reset_index(drop=True)
        x, y = part[features].to_numpy(float), part[target].to_numpy(float)
        fine = np.isfinite(x).all(axis=1) & np.isfinite(y)
        out = []
        for t in range(len(part)):
            own = np.flatnonzero(fine[max(0, t - rows) : t]) + max(0, t - rows)
            if len(own) < least:
                continue
            sx = x[own].std(axis=0)
            z = (x[own] - x[own].mean(axis=0)) / np.where(sx == 0, 1, sx)
            sy = y[own].std() or 1.0
            v = (y[own] - y[own].mean()) / sy
            if bootstraps:
                draw = np.random.default_rng(seed * 1_000_003 + t)
                picks = [draw.integers(0, len(own), len(own)) for _ in range(bootstraps)]
                score = np.mean([np.abs(elastic_net(z[i], v[i], alpha, 1.0)) > 1e-9 for i in picks], axis=0)
            else:
                score = np.abs(elastic_net(z, v, alpha, l1_ratio))
            out += [(part[key][t], part[at][t], f, float(s)) for f, s in zip(features, score)]
        return pd.DataFrame(out, columns=[key, at, "feature", "importance"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{at}` {kinds[at]}, feature string, importance double")
