"""Recursive filters over streams: what a series' past comes to is kept as a value state, so each row is used once.

A filter is a step from (state, observation) to (state, outputs). ``stream`` runs
it with ``transformWithState``: a key's state is a few numbers and the
last sequence number used, rows at or before it (repeated or late ones) give nothing, and a query that is started again
from its checkpoint goes on where it stopped. ``batch`` runs the same step over whole
series. Memory of a task: the rows of one key in one micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.models import gaussian_log_density

#: The store that ``transformWithState`` needs.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Filter(NamedTuple):
    """``step(state, observation)`` gives (state, outputs); states and outputs are tuples with the types named."""

    start: tuple
    step: Callable
    state: dict[str, str]
    out: dict[str, str]


def level_filter(q: float = 0.05, r: float = 1.0) -> Filter:
    """A local level and its variance; a missing value only widens the variance."""

    def step(state: tuple, x: np.ndarray) -> tuple[tuple, tuple]:
        level, p = state
        p += q
        if np.isfinite(x[0]):
            gain = p / (p + r)
            level = float(x[0]) if np.isnan(level) else level + gain * (float(x[0]) - level)
            p *= 1 - gain
        return (level, p), (level, p)

    return Filter((float("nan"), 10.0 * r), step, {"level": "double", "p": "double"}, {"level": "double", "variance": "double"})


def variance_filter(omega: float, alpha: float, beta: float, start: float) -> Filter:
    """The GARCH(1, 1) variance of each row given those before it; a missing value counts as its expectation."""

    def step(state: tuple, x: np.ndarray) -> tuple[tuple, tuple]:
        h = state[0]
        e2 = float(x[0]) ** 2 if np.isfinite(x[0]) else h
        return (omega + alpha * e2 + beta * h,), (h,)

    return Filter((start,), step, {"h": "double"}, {"variance": "double"})


def regime_filter(start: np.ndarray, move: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> Filter:
    """Probabilities of the states of a fitted hidden Markov model given the rows so far; an incomplete row only moves them."""
    states = len(start)
    log_start, log_move = np.log(start + 1e-300), np.log(move + 1e-300)

    def step(state: tuple, x: np.ndarray) -> tuple[tuple, tuple]:
        now = np.array(state)
        now = log_start if np.isnan(now).any() else np.logaddexp.reduce(now[:, None] + log_move, axis=0)
        if np.isfinite(x).all():
            now = now + np.array([gaussian_log_density(x[None, :], mean[k], cov[k])[0] for k in range(states)])
        now = now - np.logaddexp.reduce(now)
        return tuple(now.tolist()), tuple(np.exp(now).tolist())

    names = {f"a{k}": "double" for k in range(states)}
    return Filter((float("nan"),) * states, step, names, {f"p{k}": "double" for k in range(states)})


def cooldown_filter(least: int = 6) -> Filter:
    """Whether the largest of a row's probabilities (the first of equal ones) is another than before, and whether that fires: not within ``least`` rows of the last firing."""

    def step(state: tuple, x: np.ndarray) -> tuple[tuple, tuple]:
        steps, fired_at, before = state
        now = int(np.nan_to_num(x, nan=-np.inf).argmax())
        changed = before >= 0 and now != before
        fires = changed and steps + 1 - fired_at >= least
        return (steps + 1, steps + 1 if fires else fired_at, now), (now, changed, fires)

    return Filter((0, -999, -1), step, {"steps": "long", "fired_at": "long", "before": "long"}, {"dominant": "long", "changed": "boolean", "fires": "boolean"})


class _Processor(StatefulProcessor):
    def __init__(self, key: str, seq: str, columns: list[str], filter_: Filter):
        self.key, self.seq, self.columns, self.filter = key, seq, columns, filter_

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", ", ".join(["last long", *(f"{n} {t}" for n, t in self.filter.state.items())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, *state = self.now.get() if self.now.exists() else (None, *self.filter.start)
        state, made = tuple(state), []
        part = pd.concat(list(rows)).sort_values(self.seq, kind="stable")
        for seq, x in zip(part[self.seq].tolist(), part[self.columns].to_numpy(float)):
            if last is not None and seq <= last:
                continue
            state, out = self.filter.step(state, x)
            last = int(seq)
            made.append((key[0], last, *out))
        self.now.update((last, *state))
        yield pd.DataFrame(made, columns=[self.key, self.seq, *self.filter.out])

    def close(self) -> None:
        pass


def _schema(df: DataFrame, key: str, seq: str, filter_: Filter) -> str:
    return ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", f"`{seq}` long", *(f"{n} {t}" for n, t in filter_.out.items())])


def stream(events: DataFrame, key: str, seq: str, columns: list[str], filter_: Filter) -> DataFrame:
    """(key, seq, outputs) for each row of a stream, in the order of ``seq`` (a long) within a key. Start it within ``state_store``."""
    rows = events.select(key, seq, *columns).where(f"`{seq}` is not null")
    return rows.groupBy(key).transformWithStateInPandas(_Processor(key, seq, columns, filter_), _schema(events, key, seq, filter_), "Append", "None")


def batch(events: DataFrame, key: str, seq: str, columns: list[str], filter_: Filter) -> DataFrame:
    """The same over whole series; of rows with one ``seq`` the first is used."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(seq, kind="stable").drop_duplicates(seq)
        state, made = filter_.start, []
        for at, x in zip(part[seq].tolist(), part[columns].to_numpy(float)):
            state, out = filter_.step(state, x)
            made.append((part[key].iloc[0], at, *out))
        return pd.DataFrame(made, columns=[key, seq, *filter_.out])

    return events.select(key, seq, *columns).where(f"`{seq}` is not null").groupBy(key).applyInPandas(run, _schema(events, key, seq, filter_))


@contextmanager
def state_store(spark: SparkSession):
    """Queries started within keep their state in RocksDB, as ``transformWithState`` needs; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
