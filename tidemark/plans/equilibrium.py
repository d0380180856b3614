"""Queries of aligned series, composite and curve-implied rates, bands and mean-variance books."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series
from ..operators import equilibrium, models, optimizer
from ..session import table
from .base import MONTHLY_SQL, RETURNS_SQL, monthly, r, returns, sql_r, timeline
from .trading import WEIGHTS_SQL, weights

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query("""WITH o AS (SELECT o_orderpriority AS key, last_day(o_orderdate::DATE) AS month, o_orderstatus AS s, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS v FROM orders WHERE o_custkey % 7 = 0 GROUP BY 1, 2, 3)
 SELECT a.key, a.month, round(a.v, 2) AS finished, round(b.v, 2) AS open FROM o a JOIN o b ON a.key = b.key AND a.month = b.month WHERE a.s = 'F' AND b.s = 'O' AND a.key IN (SELECT x.key FROM o x JOIN o y ON x.key = y.key AND x.month = y.month WHERE x.s = 'F' AND y.s = 'O' GROUP BY 1 HAVING count(*) >= 2)""")
def aligned_series(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_custkey % 7 = 0").groupBy(F.col("o_orderpriority").alias("key"), F.last_day("o_orderdate").alias("month"), F.col("o_orderstatus").alias("s")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    both = equilibrium.aligned({"finished": o.where("s = 'F'"), "open": o.where("s = 'O'")}, "key", "month", "v", 2)
    return both.select("key", "month", F.round("finished", 2).alias("finished"), F.round("open", 2).alias("open"))


MODELS = {"state_space": "n / 20.0", "market_implied": "n / 12.0", "fiscal": "n / 30.0 + 1", "parity": "CASE WHEN month(month) % 3 = 0 THEN n / 15.0 END", "regime": "4.0 + 0 * n"}
_W = {m: " + ".join(f"{w.get(m, 0.0)} * p_{k}" for k, w in equilibrium.REGIME_WEIGHTS.items()) for m in MODELS}
_TOTAL = " + ".join(f"({w})" for w in _W.values())
COMPOSITE_SQL = f"""WITH m AS (SELECT key, month, n, {', '.join(f'{v} AS {k}' for k, v in MODELS.items())} FROM ({MONTHLY_SQL})),
 f AS (SELECT * REPLACE ({', '.join(f'last_value({k} IGNORE NULLS) OVER (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING) AS {k}' for k in MODELS)}) FROM m),
 h AS (SELECT key, month AS at_month, (n % 5) / 5.0 AS c, (n % 3) / 3.0 AS ro, (n % 2) / 2.0 AS st FROM m WHERE month(month) % 4 = 0),
 j AS (SELECT f.*, coalesce(c, 0) AS c, coalesce(ro, 0) AS ro, coalesce(st, 0) AS st FROM f ASOF LEFT JOIN h ON f.key = h.key AND f.month >= h.at_month),
 p AS (SELECT *, CASE WHEN c + ro + st > 0 THEN c / (c + ro + st) ELSE 1 END AS p_carry, CASE WHEN c + ro + st > 0 THEN ro / (c + ro + st) ELSE 0 END AS p_riskoff, CASE WHEN c + ro + st > 0 THEN st / (c + ro + st) ELSE 0 END AS p_stress FROM j),
 x AS (SELECT *, least(greatest(({' + '.join(f'({w}) * coalesce({m}, 0)' for m, w in _W.items())}) / ({_TOTAL}), 2), 10) AS composite, n / 50.0 AS infl,
  coalesce(least(greatest((n / nullif(CASE WHEN count(*) OVER g >= 24 THEN avg(n) OVER g END, 0) - 1) * 100, -5), 5), 0) AS gap FROM p WINDOW g AS (PARTITION BY key ORDER BY month ROWS 59 PRECEDING))"""


@query(f"""{COMPOSITE_SQL} SELECT key, month, {sql_r('composite', 'composite')}, {sql_r(f"({_W['fiscal']}) / ({_TOTAL})", 'w_fiscal')},
 {sql_r('composite + coalesce(last_value(CASE WHEN month(month) % 2 = 0 THEN n / 40.0 END IGNORE NULLS) OVER (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING), infl) + (1.0 * p_carry + 0.8 * p_riskoff + 1.5 * p_stress) * (infl - 3) + (0.3 * p_carry + 0.2 * p_riskoff + 0.1 * p_stress) * gap', 'policy_rate')} FROM x""")
def composite_rate(spark, sf_dir):
    m = monthly(spark, sf_dir).select("key", "month", "n", *(F.expr(v.replace(".0", ".0D")).cast("double").alias(k) for k, v in MODELS.items()))
    history = m.where("month(month) % 4 = 0").select("key", "month", (F.col("n") % 5 / 5).alias("carry"), (F.col("n") % 3 / 3).alias("riskoff"), (F.col("n") % 2 / 2).alias("stress"))
    c = equilibrium.composite_rate(m, history, "key", "month", list(MODELS))
    w = timeline()
    expected = F.when(F.month("month") % 2 == 0, F.col("n") / 40)
    c = equilibrium.policy_rate(c, F.col("n") / 50, expected, F.lit(3.0), equilibrium.output_gap(F.col("n").cast("double"), w), w)
    return c.select("key", "month", r("composite", "composite"), r("w_fiscal", "w_fiscal"), r("policy_rate", "policy_rate"))


@query(f"""WITH RECURSIVE x AS (SELECT key, month, ret * 100 AS v, row_number() OVER (PARTITION BY key ORDER BY month) AS k FROM ({RETURNS_SQL})),
 f AS (SELECT key, month, k, v AS level, CASE WHEN v IS NULL THEN 10.05 ELSE 10.05 * (1 - 10.05 / 11.05) END AS p FROM x WHERE k = 1
  UNION ALL SELECT x.key, x.month, x.k, CASE WHEN v IS NULL THEN level WHEN level IS NULL THEN v ELSE level + (p + 0.05) / (p + 1.05) * (v - level) END, CASE WHEN v IS NULL THEN p + 0.05 ELSE (p + 0.05) * (1 - (p + 0.05) / (p + 1.05)) END FROM f JOIN x ON x.key = f.key AND x.k = f.k + 1)
 SELECT key, month, {sql_r('level', 'level')}, {sql_r('CASE WHEN level IS NOT NULL THEN sqrt(p) END', 'std')}, {sql_r('level - 1.96 * sqrt(p)', 'low')}, {sql_r('level + 1.96 * sqrt(p)', 'high')} FROM f""")
def credible_bands(spark, sf_dir):
    x = models.local_level(returns(spark, sf_dir).withColumn("v", F.col("ret") * 100), "key", "month", "v")
    variance = series.known(F.pow((F.col("level_high") - F.col("level_low")) / (2 * 1.96), 2.0))
    std, low, high = equilibrium.bands(series.known("level"), variance)
    return x.select("key", "month", r(series.known("level"), "level"), r(std, "std"), r(low, "low"), r(high, "high"))


@query()
def curve_rate(spark, sf_dir):
    """Five tenors of each priority's months: their own count and trailing means of it."""
    w = timeline()
    tenors = {"t3m": 1, "t6m": 3, "t1y": 6, "t5y": 12, "t10y": 24}
    m = monthly(spark, sf_dir).select("key", "month", *((F.avg(F.col("n")).over(w.rowsBetween(1 - k, 0)) / 5).alias(t) for t, k in tenors.items()))
    c = equilibrium.curve_rate(m, "key", "month", list(tenors), "t5y", 36, 36)
    return c.select("key", "month", r("curve_rate", "curve_rate"), r("curve_premium", "curve_premium"))


@query(f"""WITH b AS (SELECT book, instrument, CASE WHEN book % 3 = 0 THEN NULL ELSE weight - 0.02 END AS ic FROM ({WEIGHTS_SQL})),
 s AS (SELECT *, greatest(coalesce(ic, 0), 0) AS p, count(ic) OVER (PARTITION BY book) AS known, count(*) OVER (PARTITION BY book) AS n FROM b)
 SELECT book, instrument, {sql_r('CASE WHEN known < 3 THEN 1 WHEN sum(p) OVER (PARTITION BY book) > 0 THEN p / sum(p) OVER (PARTITION BY book) * n ELSE 0.5 END', 'scale')} FROM s""")
def ic_budgets(spark, sf_dir):
    w = weights(spark, sf_dir).withColumn("ic", F.when(F.col("book") % 3 == 0, None).otherwise(F.col("weight") - 0.02))
    return w.select("book", "instrument", r(optimizer.budget_scale("ic", "book"), "scale"))


@query(f"""WITH w AS ({WEIGHTS_SQL}) SELECT book, count(*) AS instruments, true AS within_limits, true AS within_cap FROM w GROUP BY 1""")
def optimized_books(spark, sf_dir):
    """Books of the segments with made covariances: every weight lies in its limits and every book under its volatility cap."""
    a = weights(spark, sf_dir).select("book", "instrument", (F.col("weight") / 10).alias("mu"), (F.col("weight") / 2).alias("previous"), F.lit(0.0007).alias("cost"), F.when(F.col("instrument") == "long", 0.75).otherwise(1.0).alias("limit"))
    i = a.select("book", F.col("instrument").alias("i"), F.length("instrument").alias("li"))
    j = a.select("book", F.col("instrument").alias("j"), F.length("instrument").alias("lj"))
    cov = i.join(j, "book").where("i <= j").select("book", "i", "j", F.when(F.col("i") == F.col("j"), 0.002 * F.col("li")).otherwise(0.0008).alias("cov"))
    p = optimizer.mean_variance(a, cov, "book")
    both = cov.join(p.select("book", F.col("instrument").alias("i"), F.col("weight").alias("wi")), ["book", "i"]).join(p.select("book", F.col("instrument").alias("j"), F.col("weight").alias("wj")), ["book", "j"])
    risk = both.groupBy("book").agg(F.sum(F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0) * F.col("wi") * F.col("wj") * F.col("cov")).alias("v"))
    g = p.join(a.select("book", "instrument", "limit"), ["book", "instrument"]).groupBy("book").agg(F.count("*").alias("instruments"), F.bool_and(F.abs("weight") <= F.col("limit") + 1e-9).alias("within_limits"))
    return g.join(risk, "book").select("book", "instruments", "within_limits", (F.sqrt("v") <= 0.1 / 12**0.5 * (1 + 1e-6)).alias("within_cap"))
