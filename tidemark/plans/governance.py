"""Queries over trials, holdouts, label ends, fills and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import series, statistics
from ..operators import governance
from ..session import table
from .base import RETURNS_SQL, r, returns, sql_r, timeline

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(f"""SELECT user_id, count(*) AS n_trials, count(DISTINCT event_type) AS n_unique_configs, {sql_r('coalesce(stddev_samp(s), 0)', 'sharpe_std')},
 arg_min(event_type, (-s, event_type)) FILTER (s IS NOT NULL) AS best_config, {sql_r('max(s)', 'best_sharpe')} FROM (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS s FROM events) GROUP BY 1""")
def trial_summary(spark, sf_dir):
    trials = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("config_hash"), F.when(F.col("event_type") != "error", F.col("value").cast("double")).alias("sharpe"))
    s = governance.trial_summary(trials, ["user_id"])
    return s.select("user_id", "n_trials", "n_unique_configs", r("sharpe_std", "sharpe_std"), "best_config", r("best_sharpe", "best_sharpe"))


@query("""WITH issued AS (SELECT user_id, min(event_type) AS issued FROM events WHERE user_id % 3 <> 0 GROUP BY 1), f AS (SELECT e.user_id, min(event_id) AS f FROM events e JOIN issued i ON e.user_id = i.user_id AND event_type = issued GROUP BY 1)
 SELECT e.event_id, e.user_id, CASE WHEN issued IS NULL THEN 'unknown' WHEN event_id > f THEN 'spent' WHEN event_id = f THEN 'granted' ELSE 'mismatch' END AS outcome FROM events e LEFT JOIN issued i ON e.user_id = i.user_id LEFT JOIN f ON e.user_id = f.user_id""")
def holdout_uses(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    tokens = e.where("user_id % 3 <> 0").groupBy("user_id").agg(F.min("event_type").alias("event_type"))
    return governance.holdout_uses(e, tokens, "user_id", "event_type", "event_id").select("event_id", "user_id", "outcome")


@query(f"SELECT key, month, coalesce(lead(month, 3) OVER w, last_value(month) OVER (PARTITION BY key ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS t1 FROM ({RETURNS_SQL}) WINDOW w AS (PARTITION BY key ORDER BY month)")
def label_ends(spark, sf_dir):
    return returns(spark, sf_dir).select("key", "month", governance.label_end("month", timeline(), 3).alias("t1"))


@query(f"SELECT key, month, {sql_r('first_value(v IGNORE NULLS) OVER (PARTITION BY key ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)', 'filled')} FROM (SELECT *, CASE WHEN month(month) % 4 = 0 THEN ret END AS v FROM ({RETURNS_SQL}))")
def back_fill(spark, sf_dir):
    x = returns(spark, sf_dir).withColumn("v", F.when(F.month("month") % 4 == 0, F.col("ret")))
    return x.select("key", "month", r(series.back_fill("v", timeline()), "filled"))


@query(f"""WITH x AS (SELECT key, list(ret ORDER BY ret) AS v FROM ({RETURNS_SQL}) WHERE ret IS NOT NULL GROUP BY 1)
 SELECT key, {', '.join(sql_r(f'v[least(floor({p} * len(v))::INT, len(v) - 1) + 1]', f'q{int(p * 100)}') for p in (0.05, 0.5, 1.0))} FROM x""")
def floor_quantiles(spark, sf_dir):
    fractions = (0.05, 0.5, 1.0)
    q = series.floor_quantiles(returns(spark, sf_dir), "key", "ret", list(fractions))
    return q.select("key", *(r(F.get("q", F.lit(k)), f"q{int(p * 100)}") for k, p in enumerate(fractions)))


@query(f"""WITH x AS ({RETURNS_SQL}), q AS (SELECT key, quantile_cont(ret, 0.05) AS a, quantile_cont(ret, 0.95) AS b FROM x GROUP BY 1)
 SELECT key, month, {sql_r('CASE WHEN ret IS NOT NULL THEN greatest(least(ret, b), a) END', 'clipped')}, {sql_r('coalesce(ret / nullif(n % 7, 0), 0)', 'ratio')} FROM x JOIN q USING (key)""")
def whole_sample_clip(spark, sf_dir):
    x = returns(spark, sf_dir).withColumn("ratio", series.safe_ratio("ret", F.col("n") % 7))
    return series.whole_sample_clip(x, "key", "ret").select("key", "month", r("ret", "clipped"), r("ratio", "ratio"))


SPARSE = {"view": "click_after_view", "purchase": "bought", "error": "failed"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(value) FILTER (event_type = '{kind}') AS known FROM events" for kind, name in SPARSE.items()))
def column_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(*(F.when(F.col("event_type") == kind, F.col("value").cast("double")).alias(name) for kind, name in SPARSE.items()))
    return series.coverage(e, list(SPARSE.values()))


@query(f"""WITH x AS (SELECT key, month, ret, year(month) >= 1996 AS now FROM ({RETURNS_SQL}) WHERE ret IS NOT NULL),
 p AS (SELECT key, month, {sql_r("product(1 + ret) OVER (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING)", 'c')} FROM x),
 d AS (SELECT key, min(c / m - 1) AS dd FROM (SELECT *, max(c) OVER (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING) AS m FROM p) GROUP BY 1),
 e AS (SELECT key, quantile_cont(ret, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM x WHERE NOT now GROUP BY 1),
 b AS (SELECT key, len(list_filter(edges, lambda v: v < ret)) AS bin, count(*) FILTER (now) AS q, count(*) FILTER (NOT now) AS p FROM x JOIN e USING (key) GROUP BY 1, 2),
 s AS (SELECT key, greatest(q / nullif(sum(q) OVER (PARTITION BY key), 0), 1e-6) AS q, greatest(p / nullif(sum(p) OVER (PARTITION BY key), 0), 1e-6) AS p FROM b),
 i AS (SELECT key, sum((q - p) * ln(q / p)) AS psi FROM s GROUP BY 1),
 y AS (SELECT key, bool_or(now) AS two_sided FROM x GROUP BY 1)
 SELECT key, {sql_r('CASE WHEN two_sided THEN psi END', 'psi')}, coalesce((CASE WHEN two_sided THEN psi END > 0.2)::INT, 0) + (dd <= -0.03)::INT AS n_warnings FROM d JOIN y USING (key) LEFT JOIN i USING (key)""")
def drift_warnings(spark, sf_dir):
    w = timeline().rowsBetween(Window.unboundedPreceding, 0)
    x = returns(spark, sf_dir).where("ret is not null")
    fallen = x.withColumn("c", F.product(1 + F.col("ret")).over(w)).withColumn("d", F.col("c") / F.max("c").over(w) - 1).groupBy("key").agg(F.min("d").alias("d"))
    both = fallen.join(statistics.stability_by(x, "key", "ret", F.year("month") >= 1996), "key")
    return both.select("key", r("psi", "psi"), F.size(governance.drift_warnings(F.col("psi"), F.col("d"))).alias("n_warnings"))


@query(f"""WITH x AS (SELECT key, month, ret FROM ({RETURNS_SQL}) WHERE ret IS NOT NULL),
 m AS (SELECT year(a.month) AS book, a.key AS i, b.key AS j, covar_samp(a.ret, b.ret) AS v FROM x a JOIN x b USING (month) WHERE a.key <= b.key GROUP BY ALL),
 names AS (SELECT book, count(*) AS n FROM m WHERE i = j AND v IS NOT NULL GROUP BY 1)
 SELECT book, n * n AS cells, true AS symmetric, true AS definite FROM names WHERE n > 1""")
def repaired_covariance(spark, sf_dir):
    """A book for each year: fewer months than it takes to be definite, and a diagonal cut to a hundredth. Repaired, each matrix is symmetric and definite."""
    x = returns(spark, sf_dir).where("ret is not null")
    pairs = x.select("month", F.col("key").alias("i"), F.col("ret").alias("a")).join(x.select("month", F.col("key").alias("j"), F.col("ret").alias("b")), "month")
    m = pairs.where("i <= j").groupBy(F.year("month").cast("long").alias("book"), "i", "j").agg(F.covar_samp("a", "b").alias("v")).where("v is not null")
    m = m.select("book", "i", "j", F.when(F.col("i") == F.col("j"), F.col("v") * 0.01).otherwise(F.col("v")).alias("v"))
    fixed = governance.nearest_psd(m, "book", "i", "j", "v")
    other = fixed.select("book", F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("t"))
    both = fixed.join(other, ["book", "i", "j"])
    # x'Mx is not negative for the corner vectors of every two assets, as for every vector of a definite matrix
    corner = fixed.where("i = j").select("book", "i", F.col("v").alias("vi"))
    tested = both.join(corner, ["book", "i"]).join(corner.select("book", F.col("i").alias("j"), F.col("vi").alias("vj")), ["book", "j"])
    ok = (F.col("v") * F.col("v") <= F.col("vi") * F.col("vj") * (1 + 1e-6) + 1e-18) & (F.col("vi") > -1e-15)
    g = tested.groupBy("book").agg(F.count("*").alias("cells"), F.bool_and(F.abs(F.col("v") - F.col("t")) < 1e-12).alias("symmetric"), F.bool_and(ok).alias("definite"))
    return g.where("cells > 1")
