"""Equilibrium rates, regimes, nowcasts and alpha models over long panels.

What is a formula over windows is a column expression. A recursion or a refit
on every prefix is a grouped map: one series (or panel) is one group, groups
run in parallel, and a group's length is the history of one series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series


def _grouped(df: DataFrame, key: str, at: str, made: dict[str, str], run) -> DataFrame:
    """``df`` with columns ``made``, computed by ``run`` from each key's rows in order of ``at``."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{n} {t}" for n, t in made.items())])

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(at, kind="stable").reset_index(drop=True)
        out = run(rows)
        for n in made:
            rows[n] = out[n]
        return rows

    return df.groupBy(key).applyInPandas(step, schema)


def shrunken_regression(x: np.ndarray, y: np.ndarray, prior: np.ndarray, weight: float) -> np.ndarray:
    """Coefficients drawn to a prior: (X'X + wI)^-1 (X'y + w prior)."""
    return np.linalg.solve(x.T @ x + weight * np.eye(x.shape[1]), x.T @ y + weight * prior)


def rolling_regression(df: DataFrame, key: str, at: str, features: list[str], target: str, rows: int = 60, least: int = 24, prior: list[float] | None = None, weight: float = 0.0, name: str = "fitted") -> DataFrame:
    """``df`` with the fitted value and residual at each row of a regression on the ``rows`` rows strictly before it.

    With a prior the regression has no constant and shrinks by ``weight`` for each row.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part[features].to_numpy(float), part[target].to_numpy(float)
        a = x if prior is not None else np.column_stack([np.ones(len(x)), x])
        fine = np.isfinite(a).all(axis=1) & np.isfinite(y)
        fit = np.full(len(part), np.nan)
        for t in range(len(part)):
            own = np.flatnonzero(fine[max(0, t - rows) : t]) + max(0, t - rows)
            if len(own) < least or not np.isfinite(a[t]).all():
                continue
            b = shrunken_regression(a[own], y[own], np.array(prior), weight * len(own)) if prior is not None else np.linalg.lstsq(a[own], y[own], rcond=None)[0]
            fit[t] = a[t] @ b
        return pd.DataFrame({name: fit, f"{name}_residual": y - fit})

    return _grouped(df, key, at, {name: "double", f"{name}_residual": "double"}, run)


def parity_rate(real: Column, cds_bps: Column, embi_bps: Column, vix: Column, debt: Column, tot: Column, w, rows: int = 60, least: int = 24) -> Column:
    """Foreign real rate plus country risk, risk appetite, debt and terms-of-trade premia, between 2 and 12."""
    clip = lambda c, a, b: F.least(F.greatest(c, F.lit(a)), F.lit(b))
    country = F.greatest(cds_bps / 100, embi_bps / 100 * 0.5 * 0.7)
    middle = series.rolling(series.quantile(0.5), vix, w, rows, least)
    appetite = F.coalesce(clip((vix - middle) / middle * 0.5, -1.0, 2.0), F.lit(0.0))
    fiscal = F.coalesce(clip((debt - 60) * 0.03, 0.0, 3.0), F.lit(0.0))
    trade = F.coalesce(clip(series.zscore(tot, w, rows, least, 0.5) * -0.3, -1.0, 1.0), F.lit(0.0))
    return clip(real + country + appetite + fiscal + trade, 2.0, 12.0)


def regime_blend(models: dict[str, Column], probabilities: dict[str, Column], weights: dict[str, dict[str, float]], low: float = 2.0, high: float = 10.0) -> Column:
    """The models blended at each row by the regime weights under that row's probabilities; without any the first regime counts."""
    first = next(iter(probabilities))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in probabilities.values()), F.lit(0.0))
    p = {k: F.when(total > 0, F.coalesce(v, F.lit(0.0)) / total).otherwise(1.0 if k == first else 0.0) for k, v in probabilities.items()}
    w = {m: sum((p[k] * weights[k].get(m, 0.0) for k in p), F.lit(0.0)) for m in models}
    mass = sum(w.values(), F.lit(0.0))
    value = sum((F.coalesce(v, F.lit(0.0)) * w[m] for m, v in models.items()), F.lit(0.0)) / F.when(mass > 0, mass)
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def taylor_rate(rstar: Column, expected: Column, inflation: Column, goal: Column, gap: Column, alpha: float = 1.5, beta: float = 0.5) -> Column:
    return rstar + expected + alpha * (inflation - goal) + beta * gap


def policy_regime(rstar: Column) -> Column:
    """-1 under 3, +1 over 6, straight in between."""
    return F.when(rstar < 3, -1.0).when(rstar > 6, 1.0).otherwise((rstar - 4.5) / 1.5)


def local_level(df: DataFrame, key: str, at: str, value: str, q: float = 0.05, r: float = 1.0, low: float = -np.inf, high: float = np.inf, z: float = 1.96) -> DataFrame:
    """``df`` with the Kalman-filtered level, clipped at every step, and its interval; a missing value only widens it."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        level, p, out = np.nan, 10.0 * r, []
        for y in part[value].to_numpy(float):
            p += q
            if np.isfinite(y):
                gain = p / (p + r)
                level = y if np.isnan(level) else level + gain * (y - level)
                p *= 1 - gain
            level = float(np.clip(level, low, high)) if np.isfinite(level) else level
            out.append((level, level - z * p**0.5, level + z * p**0.5))
        return pd.DataFrame(out, columns=["level", "level_low", "level_high"])

    return _grouped(df, key, at, {"level": "double", "level_low": "double", "level_high": "double"}, run)


def gaussian_log_density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    cov = cov + 1e-9 * np.eye(len(mean))
    d = x - mean
    _, det = np.linalg.slogdet(cov)
    return -0.5 * (len(mean) * np.log(2 * np.pi) + det + np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T))


def log_forward(emission: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Filtered state probabilities, given only observations so far."""
    out, now = np.empty_like(emission), np.log(start + 1e-300)
    for t, e in enumerate(emission):
        if t:
            now = np.logaddexp.reduce(now[:, None] + np.log(move + 1e-300), axis=0)
        now = now + e
        now -= np.logaddexp.reduce(now)
        out[t] = now
    return np.exp(out)


def fit_hmm(x: np.ndarray, states: int, steps: int = 50, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, transitions, means, covariances) by expectation maximisation from a fixed start; states ordered by their first mean."""
    n, d = x.shape
    order = np.argsort(x[:, 0], kind="stable")
    mean = np.array([x[part].mean(axis=0) for part in np.array_split(order, states)])
    cov = np.array([np.cov(x.T).reshape(d, d) + 1e-3 * np.eye(d)] * states)
    start, move = np.full(states, 1 / states), np.full((states, states), 0.1 / max(states - 1, 1)) + (0.9 - 0.1 / max(states - 1, 1)) * np.eye(states)
    for _ in range(steps):
        e = np.column_stack([gaussian_log_density(x, mean[k], cov[k]) for k in range(states)])
        a, b, lm = np.empty((n, states)), np.zeros((n, states)), np.log(move + 1e-300)
        a[0] = np.log(start + 1e-300) + e[0]
        for t in range(1, n):
            a[t] = np.logaddexp.reduce(a[t - 1][:, None] + lm, axis=0) + e[t]
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp.reduce(lm + e[t + 1] + b[t + 1], axis=1)
        g = a + b
        g = np.exp(g - np.logaddexp.reduce(g, axis=1)[:, None])
        x2 = a[:-1, :, None] + lm + (e[1:] + b[1:])[:, None, :]
        x2 = np.exp(x2 - np.logaddexp.reduce(x2.reshape(n - 1, -1), axis=1)[:, None, None])
        start, move = g[0], x2.sum(axis=0) / np.maximum(g[:-1].sum(axis=0), 1e-12)[:, None]
        w = g.sum(axis=0)
        mean = g.T @ x / np.maximum(w, 1e-12)[:, None]
        cov = np.array([(g[:, k, None] * (x - mean[k])).T @ (x - mean[k]) / max(w[k], 1e-12) + 1e-4 * np.eye(d) for k in range(states)])
    rank = np.argsort(mean[:, 0], kind="stable")
    return start[rank], move[rank][:, rank], mean[rank], cov[rank]


def dynamic_factor(wide: DataFrame, key: str, at: str, columns: list[str], reference: str, least: int = 24) -> DataFrame:
    """``wide`` with factor: at each row the first principal component of the standardised panel so far, signed by the reference column, the last row projected from what it has."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part[columns].to_numpy(float)
        out = np.full(len(part), np.nan)
        ref = columns.index(reference)
        for t in range(len(part)):
            past = x[: t + 1]
            whole = past[np.isfinite(past).all(axis=1)]
            now = np.isfinite(past[-1])
            if len(whole) < least or not now.any():
                continue
            mean, sd = np.nanmean(past, axis=0), np.nanstd(past, axis=0)
            sd = np.where(sd > 0, sd, 1)
            z = (whole - mean) / sd
            c = np.nan_to_num(np.corrcoef(z.T))
            load = np.linalg.eigh(c)[1][:, -1] if len(columns) > 1 else np.ones(1)
            load = load * (np.sign(load[ref]) or 1)
            last = (past[-1] - mean) / sd
            out[t] = last[now] @ load[now] / (load[now] @ load[now]) if load[now] @ load[now] > 1e-12 else last[now].mean()
        return pd.DataFrame({"factor": out})

    return _grouped(wide, key, at, {"factor": "double"}, run)


def effective_number(correlations: DataFrame) -> DataFrame:
    """(eff_n): (sum of eigenvalues)^2 / sum of squares, from the entries: trace^2 over the squared norm."""
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    g = correlations.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("corr"))).alias("t"), F.sum(twice * F.col("corr") * F.col("corr")).alias("s"))
    return g.select((F.col("t") * F.col("t") / F.col("s")).alias("eff_n"))


def walk_forward(df: DataFrame, key: str, at: str, features: list[str], target: str, window: int = 36, least: int = 24, alpha: float = 10.0) -> DataFrame:
    """``df`` with prediction: at each row a ridge on standardised features, refitted on the ``window`` complete rows before it."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, y = part[features].to_numpy(float), part[target].to_numpy(float)
        fine, out = np.isfinite(x).all(axis=1), np.full(len(part), np.nan)
        for t in range(len(part)):
            own = np.flatnonzero(fine[:t] & np.isfinite(y[:t]))[-window:]
            if len(own) < least or not fine[t]:
                continue
            m, s = x[own].mean(axis=0), x[own].std(axis=0)
            s[s == 0] = 1
            z = (x[own] - m) / s
            b = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y[own] - y[own].mean()))
            out[t] = y[own].mean() + (x[t] - m) / s @ b
        return pd.DataFrame({"prediction": out})

    return _grouped(df, key, at, {"prediction": "double"}, run)


def drawdown_scale(drawdown: Column, at5: float = 0.5, at10: float = 0.0, least: float = 0.1) -> Column:
    """1 without drawdown, ``at5`` at -5 %, ``at10`` from -10 % on, straight in between, never under ``least``."""
    d = drawdown
    scale = F.when(d <= -0.10, at10).when(d <= -0.05, at5 + (at10 - at5) * (d + 0.05) / -0.05).when(d <= 0, 1 + (at5 - 1) * d / -0.05).otherwise(1.0)
    return F.greatest(scale, F.lit(least))


def vol_scale(vol: Column, target: float = 0.1) -> Column:
    return F.when(vol > 0, F.least(F.lit(1.0), target / vol)).otherwise(1.0)


# What a double stress leaves of each instrument.
DOUBLE_STRESS = {"front": 0.7, "belly": 0.5, "long": 0.5, "hard": 0.4, "ntnb": 0.4}


def overlays(weights: DataFrame, target: float = 0.1) -> DataFrame:
    """(.., instrument, weight, drawdown, vol, p_riskoff, p_stress) with the weight after all overlays."""
    cut = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for item in DOUBLE_STRESS.items() for x in item)), F.col("instrument")), F.lit(1.0))
    stressed = (F.col("p_riskoff") > 0.7) & (F.col("p_stress") > 0.7)
    return weights.withColumn("scaled", F.col("weight") * drawdown_scale(F.col("drawdown")) * vol_scale(F.col("vol"), target) * F.when(stressed, cut).otherwise(1.0))


def black_litterman(cov: np.ndarray, market: np.ndarray, p: np.ndarray, q: np.ndarray, tau: float = 0.05, aversion: float = 2.5) -> tuple[np.ndarray, np.ndarray]:
    """Posterior means and covariance from equilibrium returns and views P mu = Q with errors of the views' own variance."""
    pi = aversion * cov @ market
    if not len(q):
        return pi, cov * (1 + tau)
    omega = np.diag(np.maximum(np.diag(p @ (tau * cov) @ p.T), 1e-12))
    gain = tau * cov @ p.T @ np.linalg.inv(p @ (tau * cov) @ p.T + omega)
    return pi + gain @ (q - p @ pi), cov + tau * cov - gain @ p @ (tau * cov)


def long_only(raw: np.ndarray) -> np.ndarray:
    w = np.maximum(raw, 0)
    return w / w.sum() if w.sum() > 1e-12 else np.full(len(raw), 1 / len(raw))


def rolling_book(wide: DataFrame, key: str, at: str, assets: list[str], window: int = 36, least: int = 24, method: str = "min_variance", strength: float = 0.5) -> DataFrame:
    """``wide`` with book_return: weights from the trailing window's covariance at each row earn the next row's returns. Methods: equal, min_variance, black_litterman (views with the sign of the mean)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part[assets].to_numpy(float)
        out = np.full(len(part), np.nan)
        for t in range(len(part) - 1):
            past = x[max(0, t + 1 - window) : t + 1]
            past = past[np.isfinite(past).all(axis=1)]
            if len(past) < least:
                continue
            cov, k = np.cov(past.T).reshape(len(assets), -1), len(assets)
            if method == "equal":
                w = np.full(k, 1 / k)
            elif method == "min_variance":
                w = long_only(np.linalg.pinv(cov) @ np.ones(k))
            else:
                views = np.sign(past.mean(axis=0)) * strength * np.sqrt(np.diag(cov))
                mu, post = black_litterman(cov, np.full(k, 1 / k), np.eye(k), views)
                w = long_only(np.linalg.pinv(post) @ mu / 2.5)
            out[t + 1] = float(np.nansum(w * x[t + 1]))
        return pd.DataFrame({"book_return": out})

    return _grouped(wide, key, at, {"book_return": "double"}, run)
