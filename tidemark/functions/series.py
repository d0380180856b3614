"""Causal window transforms as column expressions.

Every function takes a column and an ordered window (one partition for each
series) and looks only at the current and earlier rows. Windows count rows,
not time; a statistic over fewer than ``least`` known values is null. Null is
the only missing value: convert NaN with ``known`` at the boundary.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window
from pyspark.sql import functions as F

START = Window.unboundedPreceding


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def known(value: Column | str) -> Column:
    """NaN and infinities as null."""
    v = column(value)
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def gated(statistic, value: Column, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(value).over(frame) >= least, statistic(value).over(frame))


def trailing(w: WindowSpec, rows: int | None) -> WindowSpec:
    """The frame of the last ``rows`` rows, or of all rows so far."""
    return w.rowsBetween(START if rows is None else 1 - rows, 0)


def rolling(statistic, value: Column | str, w: WindowSpec, rows: int | None, least: int | None = None) -> Column:
    """``statistic`` (such as ``F.avg``) over the last ``rows`` rows, or all so far."""
    return gated(statistic, column(value), trailing(w, rows), least if least is not None else (rows or 1))


def quantile(fraction: float):
    return lambda v: F.percentile(v, F.lit(fraction))


def zscore(value: Column | str, w: WindowSpec, rows: int | None, least: int | None = None, floor: float = 0.0) -> Column:
    """(value - mean) / max(standard deviation, floor), the deviation with n - 1; null where that is zero."""
    least = max(2, rows // 2) if least is None else least
    mean, std = rolling(F.avg, value, w, rows, least), rolling(F.stddev_samp, value, w, rows, least)
    scale = F.when(std.isNotNull(), F.greatest(std, F.lit(floor)))
    return (column(value) - mean) / F.when(scale > 0, scale)


def winsorize(value: Column | str, w: WindowSpec, lower: float = 0.05, upper: float = 0.95, rows: int | None = None, least: int = 20) -> Column:
    """``value`` clipped to its own past and present quantiles; unclipped before ``least`` values."""
    v = column(value)
    low, high = rolling(quantile(lower), v, w, rows, least), rolling(quantile(upper), v, w, rows, least)
    return F.when(low.isNull() | v.isNull(), v).otherwise(F.least(F.greatest(v, low), high))


def bounded_ffill(value: Column | str, w: WindowSpec, limit: int = 12) -> Column:
    """The last known value at most ``limit`` rows back; a limit of zero or less fills nothing."""
    v = column(value)
    return v if limit <= 0 else F.last(v, True).over(w.rowsBetween(-limit, 0))


def hold(value: Column | str, w: WindowSpec) -> Column:
    """The last known value, however far back."""
    return F.last(column(value), True).over(w.rowsBetween(START, 0))


def difference(value: Column | str, w: WindowSpec, rows: int = 1) -> Column:
    v = column(value)
    return v - F.lag(v, rows).over(w)


def change(value: Column | str, w: WindowSpec, rows: int = 1) -> Column:
    v = column(value)
    before = F.lag(v, rows).over(w)
    return v / F.when(before != 0, before) - 1


def compound(returns: Column | str, w: WindowSpec, rows: int) -> Column:
    """Product of 1 + r over the last ``rows`` rows, less 1; null unless all are known."""
    r = column(returns)
    frame = trailing(w, rows)
    return F.when(F.count(r).over(frame) == rows, F.product(1 + r).over(frame) - 1)


def forward_return(returns: Column | str, w: WindowSpec, horizon: int = 1) -> Column:
    """Product of 1 + r over the next ``horizon`` rows, less 1; null for the last rows. A label, not a feature."""
    r = column(returns)
    frame = w.rowsBetween(1, horizon)
    return F.when(F.count(r).over(frame) == horizon, F.product(1 + r).over(frame) - 1)


def equity(returns: Column | str, w: WindowSpec) -> Column:
    return F.product(1 + F.coalesce(column(returns), F.lit(0.0))).over(trailing(w, None))


def drawdown(curve: Column | str, w: WindowSpec) -> Column:
    """Curve over its highest value so far, less 1; the starting capital is not a peak."""
    c = column(curve)
    return c / F.max(c).over(trailing(w, None)) - 1


def expanding_rank(value: Column | str, w: WindowSpec) -> Column:
    """The share of values so far, the current one included, that are not above the current one."""
    v = column(value)
    past = F.collect_list(v).over(trailing(w, None))
    return F.when(v.isNotNull(), F.size(F.filter(past, lambda x: x <= v)) / F.size(past))


def momentum(returns: Column | str, w: WindowSpec, rows: int = 3) -> Column:
    return rolling(F.sum, returns, w, rows, rows)


def causal_position(signal: Column | str, w: WindowSpec, least: int = 12, clip: float = 2.0) -> Column:
    """Expanding z-score of the signal, clipped and scaled to [-1, 1]."""
    z = zscore(signal, w, None, least)
    return F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)) / clip)


def recursive(df: DataFrame, key: str, at: str, value: str, made: dict[str, str], step) -> DataFrame:
    """``df`` with columns that only a recursion over a whole series gives.

    ``step`` maps the series' values in order of ``at`` to a frame with the
    columns ``made`` (name to type). One series is one group, whose length is
    its history; series run in parallel.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{n} {t}" for n, t in made.items())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(at, kind="stable").reset_index(drop=True)
        return pd.concat([rows, step(rows[value].astype(float)).reset_index(drop=True)[list(made)]], axis=1)

    return df.groupBy(key).applyInPandas(run, schema)


def ewm(df: DataFrame, key: str, at: str, value: str, span: float | None = None, halflife: float | None = None, least: int = 1) -> DataFrame:
    """``df`` with ewm_mean and ewm_std (weights adjusted, deviation unbiased)."""

    def step(v: pd.Series) -> pd.DataFrame:
        e = v.ewm(span=span, halflife=halflife, min_periods=least)
        return pd.DataFrame({"ewm_mean": e.mean(), "ewm_std": e.std()})

    return recursive(df, key, at, value, {"ewm_mean": "double", "ewm_std": "double"}, step)


def back_fill(value: Column | str, w: WindowSpec) -> Column:
    """The next known value, however far ahead: the one fill that looks forward, for the warm-up of a series."""
    return F.first(column(value), True).over(w.rowsBetween(0, Window.unboundedFollowing))


def quantile_at(values: Column, fraction: float) -> Column:
    """The element of a sorted array at floor(fraction x n), the last one at most."""
    at = F.least(F.floor(F.lit(fraction) * F.size(values)), F.size(values) - 1).cast("int")
    return F.get(values, at)


def floor_quantiles(df: DataFrame, key: str, value: str, fractions: list[float]) -> DataFrame:
    """(key, q: an array): the values at floor(fraction x n), the last one at most, of each key.

    From counts of each value, added up in order: no key's values are ever listed in one row.
    """
    counts = df.where(known(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(key).orderBy("_v")
    counts = counts.withColumns({"_upto": F.sum("_c").over(order.rowsBetween(START, 0)), "_n": F.sum("_c").over(Window.partitionBy(key))})
    at = lambda p: F.least(F.floor(F.lit(p) * F.col("_n")), F.col("_n") - 1)
    pick = lambda p: F.max(F.when((F.col("_upto") > at(p)) & (F.col("_upto") - F.col("_c") <= at(p)), F.col("_v")))
    return counts.groupBy(key).agg(F.array(*map(pick, fractions)).alias("q"))


def whole_sample_clip(df: DataFrame, by: str, value: str, lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """``df`` with ``value`` clipped to its quantiles over the whole of each series. Not causal: for selectors that are fitted on one sample."""
    edges = df.groupBy(by).agg(F.percentile(value, F.lit(lower)).alias("_low"), F.percentile(value, F.lit(upper)).alias("_high"))
    clipped = F.greatest(F.least(F.col(value), F.col("_high")), F.col("_low"))
    return df.join(edges, by).withColumn(value, F.when(F.col(value).isNotNull(), clipped)).drop("_low", "_high")


def safe_ratio(a: Column | str, b: Column | str, otherwise: float = 0.0) -> Column:
    """a / b, or ``otherwise`` where that is no number."""
    return F.coalesce(known(F.try_divide(column(a), column(b))), F.lit(otherwise))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, known): how many rows know each column, in one pass."""
    one = df.agg(*(F.count(known(c)).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("known")) for c in columns))).alias("_c")).select("_c.*")


def covered(df: DataFrame, columns: list[str], least: int, most: int | None = None) -> list[str]:
    """The columns known in ``least`` rows or more (all of them if that leaves fewer than two), the ``most`` best known at most."""
    found = {r["name"]: r["known"] for r in coverage(df, columns).collect()}  # a row for each column
    kept = [c for c in columns if found[c] >= least]
    kept = kept if len(kept) >= 2 else list(columns)
    return sorted(kept, key=lambda c: (-found[c], c))[:most]
