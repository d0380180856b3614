"""Regime probabilities that are never repainted.

A model is fitted anew at every as-of date of a calendar, on the rows up to it
and nothing else: which observables are covered, their means and deviations,
the transitions and the order of the states all come from the past. Each row gets the filtered
probabilities of the first fit whose as-of date reaches it, and keeps them.
Fits are independent, one group for each (key, as-of date), so they run in parallel; adding
later rows changes no earlier result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins
from .models import fit_hmm, gaussian_log_density, log_forward


def covered_columns(x: np.ndarray, least: int) -> list[int]:
    """The columns known ``least`` times or more; if these are under two, the three best known."""
    known = np.isfinite(x).sum(axis=0)
    kept = [k for k in range(x.shape[1]) if known[k] >= least]
    return kept if len(kept) >= 2 else sorted(np.argsort(-known, kind="stable")[:3].tolist())


def filtered(x: np.ndarray, states: int, label: int, least: int = 60) -> np.ndarray:
    """Filtered probabilities of the rows of ``x``, states in ascending order of the fitted mean of column ``label``; NaN for incomplete rows, and for all where fewer than ``least`` are complete."""
    out = np.full((len(x), states), np.nan)
    if x.shape[1] < 2 or not len(x):
        return out
    kept = covered_columns(x, least)
    part = x[:, kept]
    fine = np.isfinite(part).all(axis=1)
    if fine.sum() < least:
        return out
    part = part[fine]
    part = (part - part.mean(axis=0)) / np.maximum(part.std(axis=0, ddof=1), 0.01)
    first = kept.index(label) if label in kept else 0
    part = np.roll(part, -first, axis=1)  # ``fit_hmm`` orders states by the first column
    start, move, mean, cov = fit_hmm(part, states)
    out[fine] = log_forward(np.column_stack([gaussian_log_density(part, mean[k], cov[k]) for k in range(states)]), start, move)
    return out


def calendar(df: DataFrame, key: str, at: str, refits: Column) -> DataFrame:
    """(key, since, asof): the as-of dates of each key, those of its rows where ``refits`` holds, each with the one before.

    ``refits`` must depend on the row alone (a month of the year, say), else later rows could move earlier dates.
    """
    dates = df.where(refits).select(key, F.col(at).alias("asof")).distinct()
    return dates.select(key, F.lag("asof").over(Window.partitionBy(key).orderBy("asof")).alias("since"), "asof")


def point_in_time(df: DataFrame, key: str, at: str, observed: list[str], refits: Column, states: int = 3, label: str | None = None, least: int = 60) -> DataFrame:
    """(key, at, asof, p0..): of each row the filtered probabilities by the first fit that reaches it.

    A fit without enough complete rows gives nothing, and its rows get those of the next one.
    Rows of a key go to each as-of date at or after them: history x fits, one (key, date) in one task.
    """
    made = [f"p{k}" for k in range(states)]
    dates = calendar(df, key, at, refits).select(key, "asof")
    rows = df.select(key, at, *observed).join(dates, key).where(F.col(at) <= F.col("asof"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(at, kind="stable")
        found = filtered(part[observed].to_numpy(float), states, observed.index(label) if label else 0, least)
        fine = np.isfinite(found).all(axis=1)
        return pd.concat([part[[key, at, "asof"]], pd.DataFrame(found, columns=made, index=part.index)], axis=1)[fine]

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"`{key}` {types[key]}", f"`{at}` {types[at]}", f"asof {types[at]}", *(f"{c} double" for c in made)])
    fits = rows.groupBy(key, "asof").applyInPandas(fit, schema)
    first = fits.groupBy(key, at).agg(F.min_by(F.struct("asof", *made), "asof").alias("_r"))
    return first.select(key, at, "_r.*")


def append_regimes(history: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """``history`` with the rows of ``new`` whose (key, at) it lacks: what is written is never repainted."""
    return history.unionByName(joins.insert_absent(history, new.select(*history.columns), [key, at]))


def combined(one: DataFrame | None, two: DataFrame | None, key: str, at: str, first: dict[str, float], second: dict[str, float]) -> DataFrame:
    """Two levels of probabilities side by side, at the times of both; a level that is missing altogether gets its defaults."""
    if one is None and two is None:
        raise ValueError("one of the levels is needed")
    if one is None or two is None:
        have, lacking = (two, first) if one is None else (one, second)
        return have.withColumns({c: F.lit(v) for c, v in lacking.items()})
    return one.select(key, at, *first).join(two.select(key, at, *second), [key, at])


def probabilities_at(dates: DataFrame, history: DataFrame, key: str, at: str, defaults: dict[str, float], history_at: str | None = None) -> DataFrame:
    """``dates`` with the last probabilities of ``history`` at or before each of them; before the first, and for columns that it lacks, the defaults."""
    have = [c for c in defaults if c in history.columns]
    joined = joins.asof_join(dates, history.withColumn("_some", F.lit(True)), key, at, [*have, "_some"], history_at)
    return joined.select(*dates.columns, *((F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v)).alias(c) for c, v in defaults.items()))
