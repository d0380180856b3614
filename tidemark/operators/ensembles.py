"""Scores against their own past, weights of models by their record, and the test of a sized arm against a flat one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import series

#: Spread under which a forecast or an outcome counts as constant.
CONSTANT = 1e-8


def demeaned_score(score: Column | str, w: WindowSpec, rows: int = 60, least: int = 12, floor: float = 0.5) -> Column:
    """The score's distance from its mean over the last ``rows`` rows in population deviations of ``floor`` or more; the score itself before ``least`` rows."""
    mean, std = (series.rolling(f, score, w, rows, least) for f in (F.avg, F.stddev_pop))
    return F.coalesce((series.column(score) - mean) / F.greatest(std, F.lit(floor)), series.column(score))


def ensemble_weights(history: DataFrame, key: str, model: str, at: str, forecast: str, outcome: str, rows: int = 36, halflife: float = 24.0, least: int = 12) -> DataFrame:
    """(key, model, quality, weight) from rows (key, model, at, forecast, outcome).

    Quality is the correlation of forecast and outcome over the last ``rows``
    complete rows, weighted by age, and at least 0; it is 0 under ``least``
    rows and where either side is constant. Weights are shares of the
    quality, equal where all of it is 0. A model without a complete row keeps its place.
    """
    models = history.select(key, model).distinct()
    recent = Window.partitionBy(key, model).orderBy(F.desc(at))
    known = history.where(F.col(forecast).isNotNull() & F.col(outcome).isNotNull()).withColumn("_age", F.row_number().over(recent) - 1).where(F.col("_age") < rows)
    # deviations from plain means first, so that the weighted moments lose no digits
    whole = Window.partitionBy(key, model)
    p, q, d = F.col("_p"), F.col("_q"), F.col("_d")
    known = known.select(key, model, (F.col(forecast) - F.avg(forecast).over(whole)).alias("_p"), (F.col(outcome) - F.avg(outcome).over(whole)).alias("_q"), F.pow(F.lit(2.0), -F.col("_age") / halflife).alias("_d"))
    mean = lambda x: F.sum(d * x) / F.sum(d)
    moments = known.groupBy(key, model).agg(
        F.count("*").alias("n"),
        F.least(F.stddev_pop(p), F.stddev_pop(q)).alias("least_spread"),
        (mean(p * q) - mean(p) * mean(q)).alias("pq"),
        F.sqrt(F.greatest(mean(p * p) - mean(p) * mean(p), F.lit(0.0))).alias("sp"),
        F.sqrt(F.greatest(mean(q * q) - mean(q) * mean(q), F.lit(0.0))).alias("sq"),
    )
    varied = (F.col("n") >= least) & (F.col("least_spread") > CONSTANT) & (F.col("sp") > CONSTANT) & (F.col("sq") > CONSTANT)
    quality = F.when(varied, F.greatest(F.col("pq") / (F.col("sp") * F.col("sq")), F.lit(0.0))).otherwise(0.0)
    scored = models.join(moments, [key, model], "left").select(key, model, quality.alias("quality"))
    all_of_key = Window.partitionBy(key)
    total = F.sum("quality").over(all_of_key)
    return scored.withColumn("weight", F.when(total > 0, F.col("quality") / total).otherwise(1 / F.count("*").over(all_of_key)))


def criterion_met(flat_dsr: Column, sized_dsr: Column, flat_sharpe: Column, sized_sharpe: Column, margin: float) -> Column:
    """Whether the sized arm beats the flat one in both measures; false where any of the four is missing or not a number."""
    four = [series.known(x) for x in (flat_dsr, sized_dsr, flat_sharpe, sized_sharpe)]
    return F.coalesce((four[1] >= four[0] + margin) & (four[3] > four[2]), F.lit(False))
