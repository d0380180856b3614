"""Joins over time: as-of, range, purge and idempotent insertion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str | list[str], at: str, values: list[str], right_at: str | None = None, strict: bool = False) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before (``strict``: before) its time.

    One shuffle: both sides are stacked and the last known row is carried
    along each key's timeline; no pairs are made, whatever the sizes.
    """
    keys = [key] if isinstance(key, str) else key
    right_at = right_at or at
    side = F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate(values)))
    a = left.select(*keys, F.col(at).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.struct("*").alias("_row"))
    b = right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), F.lit(1 if strict else 0).alias("_side"), side.alias("_value"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_value", F.last("_value", True).over(w))
    # a null time sorts first and so meets no value
    return both.where("_row is not null").select("_row.*", *(F.col(f"_value.v{i}").alias(c) for i, c in enumerate(values)))


#: Spans that ``range_join`` broadcasts at most.
FEW_SPANS = 1000


def range_join(rows: DataFrame, spans: DataFrame, at: str, start: str = "start", end: str = "end") -> DataFrame:
    """Each row with each span (both ends included) that holds its date: up to ``FEW_SPANS`` spans (dated scenarios) are broadcast, more go by ``range_join_days``."""
    if spans.limit(FEW_SPANS + 1).count() > FEW_SPANS:
        return range_join_days(rows, spans, at, start, end)
    return rows.join(F.broadcast(spans), (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))


def range_join_days(rows: DataFrame, spans: DataFrame, at: str, start: str, end: str, days: int = 32) -> DataFrame:
    """The same by an equality on buckets of ``days`` days: a span is repeated once for each bucket it touches."""
    bucket = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / days)
    a = rows.withColumn("_bucket", bucket(at))
    b = spans.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return a.join(b, "_bucket").where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_bucket")


def purge(train: DataFrame, test: DataFrame, start: str, end: str, fold: str, embargo_days: int = 0) -> DataFrame:
    """Training rows of each fold whose [start, end] does not overlap the fold's test span, nor starts in the embargo after it.

    The test rows shrink to one span for each fold before the join.
    """
    span = test.groupBy(fold).agg(F.min(start).alias("_from"), F.date_add(F.max(end), embargo_days).alias("_to"))
    overlap = (F.col(start) <= F.col("_to")) & (F.col(end) >= F.col("_from"))
    return train.join(span, fold, "left").where(F.col("_from").isNull() | ~overlap).drop("_from", "_to")


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose keys are not there yet; of equal new keys the one that sorts first."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()
    return one.join(existing.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with equal keys."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; an aggregation, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def patch(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All keys of both sides; the left value where it is known, else the right."""
    r = right.select(*keys, F.col(value).alias("_other"))
    return left.select(*keys, value).join(r, keys, "outer").select(*keys, F.coalesce(value, "_other").alias(value))


def previous_month(df: DataFrame, key: str, month: str, value: str) -> DataFrame:
    """``df`` with the value of the calendar month before (not of the row before)."""
    other = df.select(key, F.last_day(F.add_months(F.trunc(month, "MM"), 1)).alias(month), F.col(value).alias(f"previous_{value}"))
    return df.join(other, [key, month], "left")
