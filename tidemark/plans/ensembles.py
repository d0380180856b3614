"""Queries over scores, model weights and tail profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensembles, risk
from .base import RETURNS_SQL, SIGNALS_SQL, r, returns, signals, sql_r, timeline

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(f"""SELECT key, month, {sql_r('CASE WHEN count(x) OVER w >= 12 THEN (x - avg(x) OVER w) / greatest(stddev_pop(x) OVER w, 0.5) ELSE x END', 'score')}
 FROM (SELECT *, 10 * ret AS x FROM ({RETURNS_SQL}) WHERE ret IS NOT NULL) WINDOW w AS (PARTITION BY key ORDER BY month ROWS 59 PRECEDING)""")
def demeaned_score(spark, sf_dir):
    x = returns(spark, sf_dir).where("ret is not null").withColumn("x", 10 * F.col("ret"))
    return x.select("key", "month", r(ensembles.demeaned_score("x", timeline()), "score"))


@query(f"""WITH s AS ({SIGNALS_SQL}), h AS (SELECT key, month, 'momentum' AS model, signal AS p, fwd AS q FROM s UNION ALL SELECT key, month, 'carry', carry, fwd FROM s UNION ALL SELECT key, month, 'reversal', -ret, fwd FROM s UNION ALL SELECT key, month, 'none', NULL, fwd FROM s),
 k AS (SELECT *, pow(0.5, (row_number() OVER (PARTITION BY key, model ORDER BY month DESC) - 1) / 24) AS d, row_number() OVER (PARTITION BY key, model ORDER BY month DESC) AS rn FROM h WHERE p IS NOT NULL AND q IS NOT NULL),
 m AS (SELECT *, sum(d * p) OVER g / sum(d) OVER g AS mp, sum(d * q) OVER g / sum(d) OVER g AS mq FROM k WHERE rn <= 36 WINDOW g AS (PARTITION BY key, model)),
 c AS (SELECT key, model, CASE WHEN count(*) >= 12 AND stddev_pop(p) > 1e-8 AND stddev_pop(q) > 1e-8 THEN greatest(sum(d * (p - mp) * (q - mq)) / sqrt(sum(d * (p - mp) ^ 2) * sum(d * (q - mq) ^ 2)), 0) ELSE 0 END AS quality FROM m GROUP BY 1, 2),
 a AS (SELECT key, model, coalesce(quality, 0) AS quality FROM (SELECT DISTINCT key, model FROM h) LEFT JOIN c USING (key, model))
 SELECT key, model, {sql_r('quality', 'quality')}, {sql_r('CASE WHEN sum(quality) OVER g > 0 THEN quality / sum(quality) OVER g ELSE 1 / count(*) OVER g END', 'weight')} FROM a WINDOW g AS (PARTITION BY key)""")
def ensemble_weights(spark, sf_dir):
    forecasts = F.expr("stack(4, 'momentum', signal, 'carry', carry, 'reversal', -ret, 'none', cast(null as double)) as (model, p)")
    h = signals(spark, sf_dir).select("key", "month", "fwd", forecasts)
    return ensembles.ensemble_weights(h, "key", "model", "month", "p", "fwd").select("key", "model", r("quality", "quality"), r("weight", "weight"))


@query(f"""WITH x AS (SELECT key, ret, row_number() OVER (PARTITION BY key ORDER BY ret) AS rn, count(*) OVER (PARTITION BY key) AS n FROM ({RETURNS_SQL}) WHERE ret IS NOT NULL),
 e AS (SELECT key, a, ret AS q FROM x, (VALUES (0.05), (0.01)) t(a) WHERE rn = floor((n - 1) * a) + 1)
 SELECT key, (100 * (1 - a))::INT AS level, {sql_r('-any_value(q)', 'var')}, {sql_r('-avg(ret)', 'es')} FROM x JOIN e USING (key) WHERE ret <= q GROUP BY 1, a""")
def tail_profile(spark, sf_dir):
    x = returns(spark, sf_dir)
    levels = [risk.tail(x, "key", "ret", a).select("key", F.lit(round(100 * (1 - a))).alias("level"), r("var", "var"), r("es", "es")) for a in (0.05, 0.01)]
    return levels[0].unionByName(levels[1])
