"""Calendars: month ends, grids, resampling and publication lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_end(at: Column | str) -> Column:
    return F.last_day(at)


def next_month_end(at: Column | str) -> Column:
    """The first month end after the date; a month end moves on to the next."""
    return F.last_day(F.date_add(at, 1))


def previous_month_end(at: Column | str) -> Column:
    return F.last_day(F.add_months(F.trunc(at, "month"), -1))


def knowledge_time(event_time: Column | str, lag_days: Column | int, publish_time: Column | None = None) -> Column:
    """When an observation can be known: its event plus the publication lag, or its publication if that is later."""
    lag = lag_days if isinstance(lag_days, Column) else F.lit(lag_days)
    by_lag = (F.col(event_time) if isinstance(event_time, str) else event_time).cast("timestamp_ntz") + F.make_dt_interval(lag)
    return by_lag if publish_time is None else F.greatest(by_lag, publish_time.cast("timestamp_ntz"))


def to_monthly(df: DataFrame, key: str, at: str, value: str, method: str = "last", tie: str | None = None) -> DataFrame:
    """(key, month, value): the last, mean or sum of each month's known values; ``tie`` decides between equal times."""
    order = F.struct(at, tie) if tie else F.col(at)
    made = {"last": F.max_by(value, order), "mean": F.avg(value), "sum": F.sum(value)}[method]
    return df.where(F.col(value).isNotNull()).groupBy(key, F.last_day(at).alias("month")).agg(made.alias(value))


def month_grid(df: DataFrame, key: str, month: str = "month") -> DataFrame:
    """A row for every month between each key's first and last, with what ``df`` has for it."""
    span = df.groupBy(key).agg(F.min(month).alias("a"), F.max(month).alias("b"))
    grid = span.select(key, F.explode(F.expr("transform(sequence(trunc(a, 'MM'), trunc(b, 'MM'), interval 1 month), x -> last_day(x))")).alias(month))
    return grid.join(df, [key, month], "left")


def lag_rows(df: DataFrame, key: str, month: str, value: str, rows: int) -> DataFrame:
    """``value`` as it was published ``rows`` months later."""
    return df.withColumn(value, F.lag(value, rows).over(Window.partitionBy(key).orderBy(month)))


def annual_to_monthly(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Month-end rows from each key's first to its last observation, each with the last known anchor (no interpolation, which would look ahead)."""
    held = df.groupBy(key, F.last_day(at).alias("month")).agg(F.max_by(value, at).alias(value))
    w = Window.partitionBy(key).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return month_grid(held, key).withColumn(value, F.last(value, True).over(w))


def annual_to_monthly_linear(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The same grid by linear interpolation between anchors. It looks ahead: for comparison only."""
    w = Window.partitionBy(key).orderBy(at)
    a = df.select(key, F.col(at).cast("date").alias("a"), F.col(value).alias("va"), F.lead(F.col(at).cast("date")).over(w).alias("b"), F.lead(value).over(w).alias("vb"))
    months = F.expr("filter(transform(sequence(trunc(a, 'MM'), trunc(coalesce(b, a), 'MM'), interval 1 month), x -> last_day(x)), x -> x >= a AND (b IS NULL AND x = last_day(a) OR x < b))")
    share = F.datediff("month", "a") / F.datediff("b", "a")
    rows = a.withColumn("month", F.explode(months))
    return rows.select(key, "month", F.when(F.col("b").isNull(), F.col("va")).otherwise(F.col("va") + (F.col("vb") - F.col("va")) * share).alias(value))
