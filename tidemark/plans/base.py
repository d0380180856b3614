"""The inputs that the queries share, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import series
from ..session import table

#: Digits that results are rounded to, so that the order of additions cannot show.
DIGITS = 7

MONTHLY_SQL = """SELECT o_orderpriority AS key, last_day(o_orderdate::DATE) AS month,
 sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS total, count(*) AS n FROM orders GROUP BY 1, 2"""
RETURNS_SQL = f"""SELECT key, month, total, n, total / lag(total) OVER (PARTITION BY key ORDER BY month) - 1 AS ret FROM ({MONTHLY_SQL})"""
SIGNALS_SQL = f"""SELECT key, month, ret, lag(ret) OVER w AS signal, ln(n) AS carry, lead(ret) OVER w AS fwd FROM ({RETURNS_SQL})
 WINDOW w AS (PARTITION BY key ORDER BY month)"""


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, month, total, n): order value and count by priority and month."""
    o = table(spark, sf_dir, "orders")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    return o.groupBy(F.col("o_orderpriority").alias("key"), F.last_day("o_orderdate").alias("month")).agg(total, F.count("*").alias("n"))


def timeline():
    return Window.partitionBy("key").orderBy("month")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly(spark, sf_dir).withColumn("ret", series.change("total", timeline()))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = timeline()
    r = returns(spark, sf_dir)
    return r.select("key", "month", "ret", F.lag("ret").over(w).alias("signal"), F.log("n").alias("carry"), F.lead("ret").over(w).alias("fwd"))


def r(value: Column | str, name: str) -> Column:
    """A rounded result column."""
    return F.round(series.column(value), DIGITS).alias(name)


def sql_r(value: str, name: str) -> str:
    return f"round({value}, {DIGITS}) AS {name}"
