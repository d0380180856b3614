"""Queries over many cutoffs of the ledger, conditional correlations by pairs and point-in-time regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series
from ..operators import regimes, vintages
from ..session import table
from .asof import LEDGER_SQL, ledger
from .base import MONTHLY_SQL, monthly, r, sql_r

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def cutoffs(spark):
    """Thirty noons."""
    return spark.sql("SELECT explode(sequence(timestamp_ntz'2024-01-01 12:00:00', timestamp_ntz'2024-01-30 12:00:00', interval 1 day)) AS cutoff")


CUTOFFS_SQL = "SELECT unnest(generate_series(TIMESTAMP '2024-01-01 12:00:00', TIMESTAMP '2024-01-30 12:00:00', INTERVAL 1 DAY)) AS cutoff"
VIEWS_SQL = f"""SELECT cutoff, series_id, event_time, value, knowledge_time, source, _seq FROM (
 SELECT c.cutoff, l.*, row_number() OVER (PARTITION BY c.cutoff, series_id, event_time ORDER BY knowledge_time DESC, _seq DESC) AS rn
 FROM ({LEDGER_SQL}) l JOIN ({CUTOFFS_SQL}) c ON knowledge_time <= cutoff) WHERE rn = 1"""


@query(VIEWS_SQL)
def asof_cutoffs(spark, sf_dir):
    return vintages.views(ledger(spark, sf_dir), cutoffs(spark))


@query(f"""SELECT cutoff, series_id, event_time, {sql_r('value', 'value')}, {sql_r('(value - m) / nullif(greatest(s, 0.5), 0)', 'z')} FROM (
 SELECT *, row_number() OVER (PARTITION BY cutoff, series_id ORDER BY event_time DESC) AS back,
  CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END AS m, CASE WHEN count(value) OVER w >= 5 THEN stddev_samp(value) OVER w END AS s
 FROM ({VIEWS_SQL}) WINDOW w AS (PARTITION BY cutoff, series_id ORDER BY event_time ROWS 9 PRECEDING)) WHERE back = 1""")
def asof_cutoff_zscores(spark, sf_dir):
    made = vintages.readings(ledger(spark, sf_dir), cutoffs(spark), lambda v, w: series.zscore(v, w, 10, 5, 0.5), "z")
    return made.select("cutoff", "series_id", "event_time", r("value", "value"), r("z", "z"))


@query(f"SELECT series_id, event_time, value, source, _seq, knowledge_time AS valid_from, lead(knowledge_time) OVER (PARTITION BY series_id, event_time ORDER BY knowledge_time) AS valid_until FROM (SELECT *, row_number() OVER (PARTITION BY series_id, event_time, knowledge_time ORDER BY _seq DESC) AS rn FROM ({LEDGER_SQL})) WHERE rn = 1")
def version_validity(spark, sf_dir):
    return vintages.validity(ledger(spark, sf_dir)).select("series_id", "event_time", "value", "source", "_seq", "valid_from", "valid_until")


DEFAULTS = {"p_carry": 0.33, "p_stress": 0.33, "p_riskoff": 0.33, "p_domestic_stress": 0.5}


@query(f"""WITH h AS (SELECT key, month, n / 100.0 AS p_carry, month(month) / 24.0 AS p_stress FROM ({MONTHLY_SQL}) WHERE month(month) % 3 = 0 AND n % 5 <> 0)
 SELECT o_orderkey, o_orderpriority AS key, o_orderdate, {', '.join(sql_r(f'coalesce({c}, 0.33)', c) for c in ('p_carry', 'p_stress'))}, 0.33 AS p_riskoff, 0.5 AS p_domestic_stress
 FROM (SELECT o_orderkey, o_orderpriority, o_orderdate::DATE AS o_orderdate FROM orders) o ASOF LEFT JOIN h ON o.o_orderpriority = h.key AND o.o_orderdate >= h.month""")
def regime_lookup(spark, sf_dir):
    history = monthly(spark, sf_dir).where("month(month) % 3 = 0 and n % 5 <> 0").select("key", "month", (F.col("n") / 100.0).alias("p_carry"), (F.month("month") / 24.0).alias("p_stress"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("key"), F.col("o_orderdate").cast("date").alias("o_orderdate"))
    found = regimes.probabilities_at(orders, history, "key", "o_orderdate", DEFAULTS, "month")
    return found.select("o_orderkey", "key", "o_orderdate", *(r(c, c) for c in ("p_carry", "p_stress")), "p_riskoff", "p_domestic_stress")


@query(f"""WITH h AS (SELECT key, month, n FROM ({MONTHLY_SQL}) WHERE month(month) <= 6), new AS (SELECT key, month, n + 1000 AS n FROM ({MONTHLY_SQL}) WHERE month(month) >= 5)
 SELECT * FROM h UNION ALL SELECT * FROM new ANTI JOIN h USING (key, month)""")
def regime_append(spark, sf_dir):
    m = monthly(spark, sf_dir).select("key", "month", "n")
    return regimes.append_regimes(m.where("month(month) <= 6"), m.where("month(month) >= 5").withColumn("n", F.col("n") + 1000), "key", "month")
