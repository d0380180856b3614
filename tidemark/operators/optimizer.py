"""Mean-variance books under bounds, a volatility cap and costs of every change, one group for each book."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SWEEPS, TOLERANCE = 5000, 1e-12


def budget_scale(ic: Column | str, by: str, least: int = 3) -> Column:
    """Shares of the positive information coefficients of a book, times its instruments; one half where none is positive, one where fewer than ``least`` are known."""
    value = F.col(ic) if isinstance(ic, str) else ic
    w = Window.partitionBy(by)
    positive = F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0))
    total = F.sum(positive).over(w)
    return F.when(F.count(value).over(w) < least, 1.0).when(total > 0, positive / total * F.count(F.lit(1)).over(w)).otherwise(0.5)


def blended(probabilities: dict[str, Column], values: dict[str, Column], least: float | None = None) -> Column:
    """Values by regime under the regime's probabilities (0.33 each where one is missing), ``least`` at least."""
    mix = sum((F.coalesce(p, F.lit(0.33)) * values[k] for k, p in probabilities.items()), F.lit(0.0))
    return mix if least is None else F.greatest(mix, F.lit(least))


def _descend(mu: np.ndarray, cov: np.ndarray, gamma: float, previous: np.ndarray, cost: np.ndarray, limit: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The book of greatest mu'p - gamma p'Vp / 2 - cost'|p - previous| within the limits, one weight after the other to its best until none moves."""
    p = start.copy()
    for _ in range(SWEEPS):
        moved = 0.0
        for i in range(len(p)):
            slope = mu[i] - gamma * (cov[i] @ p + cov[i, i] * (previous[i] - p[i]))  # where this weight does not change
            gain = np.sign(slope) * max(abs(slope) - cost[i], 0.0)
            curve = gamma * cov[i, i]
            best = previous[i] + gain / curve if curve > 0 else np.sign(gain) * np.inf if gain else previous[i]
            best = min(max(best, -limit[i]), limit[i])
            moved, p[i] = max(moved, abs(best - p[i])), best
        if moved < TOLERANCE:
            break
    return p


def best_book(mu: np.ndarray, cov: np.ndarray, previous: np.ndarray, cost: np.ndarray, limit: np.ndarray, gamma: float, vol: float) -> tuple[np.ndarray, float]:
    """The book, and the price of its volatility cap: 0 where the cap does not bind.

    A binding cap is a greater aversion to risk, found by bisection; the book under each is unique as far as it matters.
    """
    start = np.clip(previous, -limit, limit)
    p = _descend(mu, cov, gamma, previous, cost, limit, start)
    risk = lambda q: float(np.sqrt(max(q @ cov @ q, 0.0)))
    if risk(p) <= vol * (1 + 1e-12):
        return p, 0.0
    low, high = 0.0, max(gamma, 1e-6)
    while risk(p := _descend(mu, cov, gamma + 2 * high, previous, cost, limit, p)) > vol and high < 1e12:
        low, high = high, 4 * high
    for _ in range(100):
        middle = (low + high) / 2
        p = _descend(mu, cov, gamma + 2 * middle, previous, cost, limit, p)
        low, high = (middle, high) if risk(p) > vol else (low, middle)
        if high - low <= 1e-13 * high:
            break
    return _descend(mu, cov, gamma + 2 * high, previous, cost, limit, p), high


def mean_variance(assets: DataFrame, covariances: DataFrame, book: str, gamma: float = 2.0, vol: float = 0.1 / 12**0.5) -> DataFrame:
    """(book, instrument, weight, price_of_cap) for each row of ``assets`` (book, instrument, mu, previous, cost, limit), under ``covariances`` (book, i, j, cov), of which one triangle is enough.

    ``cost`` is what a change of 1 costs. A pair without a covariance has none; missing mu and previous count as 0. A book is one
    group, instruments squared; books run in parallel.
    """
    kind = assets.schema[book].dataType.simpleString()

    def solve(own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("instrument", kind="stable").reset_index(drop=True)
        if own.empty:
            return pd.DataFrame(columns=[book, "instrument", "weight", "price_of_cap"])
        at = {n: k for k, n in enumerate(own["instrument"])}
        v = np.zeros((len(own), len(own)))
        for i, j, c in zip(pairs["i"], pairs["j"], pairs["cov"]):
            if i in at and j in at and np.isfinite(c):
                v[at[i], at[j]] = v[at[j], at[i]] = c
        mu, previous, cost, limit = (np.nan_to_num(own[c].to_numpy(float)) for c in ("mu", "previous", "cost", "limit"))
        p, price = best_book(mu, v, previous, cost, limit, gamma, vol)
        return pd.DataFrame({book: own[book], "instrument": own["instrument"], "weight": p, "price_of_cap": price})

    a = assets.select(book, "instrument", "mu", "previous", "cost", "limit").groupBy(book)
    c = covariances.select(F.col(book).alias("_book"), "i", "j", "cov").groupBy("_book")  # both may come from one table
    return a.cogroup(c).applyInPandas(solve, f"`{book}` {kind}, instrument string, weight double, price_of_cap double")
