"""Statistical evaluation and risk measures over the monthly order panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series, statistics
from ..operators import gate, risk
from ..session import table
from .base import RETURNS_SQL, SIGNALS_SQL, r, returns, signals, sql_r, timeline

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


FULL_SQL = f"SELECT * FROM ({SIGNALS_SQL}) WHERE signal IS NOT NULL AND fwd IS NOT NULL AND carry IS NOT NULL"
SKEW = "(avg(power(ret, 3)) - 3 * avg(ret) * avg(ret * ret) + 2 * power(avg(ret), 3)) / power(var_pop(ret), 1.5)"
RANKED = "rank() OVER (PARTITION BY key ORDER BY {0}) + (count(*) OVER (PARTITION BY key, {0}) - 1) / 2.0"


def _known(spark, sf_dir):
    return returns(spark, sf_dir).where("ret is not null")


@query(f"SELECT key, count(ret) AS n, {sql_r('avg(ret)', 'mean')}, {sql_r('stddev_samp(ret)', 'sd')}, {sql_r(SKEW, 'skew')}, {sql_r('kurtosis_pop(ret) + 3', 'kurt')} FROM ({RETURNS_SQL}) GROUP BY key")
def return_moments(spark, sf_dir):
    return statistics.moments(returns(spark, sf_dir), "key", "ret").select("key", "n", *(r(c, c) for c in ("mean", "sd", "skew", "kurt")))


@query()
def sharpe_statistics(spark, sf_dir):
    s = statistics.sharpe_statistics(returns(spark, sf_dir), "key", "ret", trials=10)
    return s.select("key", "n", *(r(c, c) for c in ("sharpe", "sharpe_annual", "psr", "dsr")))


NW = 3
_LAGS = ", ".join(f"lag(e, {k}) OVER w AS e{k}" for k in range(1, NW + 1))
_G = " + ".join(["sum(e * e)", *(f"2 * {1 - k / (NW + 1)} * sum(e * e{k})" for k in range(1, NW + 1))])


@query(f"""SELECT key, count(*) AS n, {NW} AS lags, {sql_r(f'avg(ret) / (sqrt({_G}) / count(*))', 'tstat')} FROM (SELECT *, {_LAGS} FROM (
 SELECT key, month, ret, ret - avg(ret) OVER (PARTITION BY key) AS e FROM ({RETURNS_SQL}) WHERE ret IS NOT NULL) WINDOW w AS (PARTITION BY key ORDER BY month)) GROUP BY key""")
def newey_west(spark, sf_dir):
    return statistics.newey_west(returns(spark, sf_dir), "key", "month", "ret", NW).select("key", "n", "lags", r("tstat", "tstat"))


@query(f"""WITH e AS (SELECT key, ret, ret - avg(ret) OVER (PARTITION BY key) AS e, row_number() OVER (PARTITION BY key ORDER BY month) AS k FROM ({RETURNS_SQL}) WHERE ret IS NOT NULL),
 n AS (SELECT key, count(*) AS n, avg(ret) AS mean, least(36, floor(4 * power(count(*) / 100.0, 2 / 9.0)))::INT AS lags FROM e GROUP BY 1),
 g AS (SELECT a.key, sum(a.e * b.e * CASE WHEN a.k = b.k THEN 1 ELSE 2 * (1 - (a.k - b.k) / (lags + 1.0)) END) AS g FROM e a JOIN n ON n.key = a.key JOIN e b ON b.key = a.key AND b.k <= a.k AND a.k - b.k <= lags GROUP BY 1)
 SELECT key, n, lags, {sql_r('CASE WHEN n > 1 AND g > 0 THEN mean / (sqrt(g) / n) END', 'tstat')} FROM n JOIN g USING (key)""")
def newey_west_auto(spark, sf_dir):
    return statistics.newey_west(returns(spark, sf_dir), "key", "month", "ret").select("key", "n", "lags", r("tstat", "tstat"))


@query(f"SELECT key, count(*) AS n, {sql_r('corr(p, f)', 'ic')} FROM (SELECT key, {RANKED.format('signal')} AS p, {RANKED.format('fwd')} AS f FROM ({SIGNALS_SQL}) WHERE signal IS NOT NULL AND fwd IS NOT NULL) GROUP BY key")
def rank_ic(spark, sf_dir):
    return statistics.information_coefficient(signals(spark, sf_dir), "key", "signal", "fwd").select("key", "n", r("ic", "ic"))


@query(f"SELECT key, count(*) AS n, {sql_r('corr(signal, fwd)', 'ic')} FROM ({FULL_SQL}) GROUP BY key")
def pearson_ic(spark, sf_dir):
    full = signals(spark, sf_dir).dropna(subset=["signal", "fwd", "carry"])
    return statistics.information_coefficient(full, "key", "signal", "fwd", "pearson").select("key", "n", r("ic", "ic"))


RESIDUALS_SQL = f"""SELECT a.key, month, signal - b.ms - b.ss * (carry - b.mc) AS signal, fwd - b.mf - b.sf * (carry - b.mc) AS fwd FROM ({FULL_SQL}) a JOIN (
 SELECT key, avg(signal) AS ms, avg(fwd) AS mf, avg(carry) AS mc, covar_pop(signal, carry) / var_pop(carry) AS ss, covar_pop(fwd, carry) / var_pop(carry) AS sf FROM ({FULL_SQL}) GROUP BY key) b ON a.key = b.key"""


@query(f"SELECT key, count(*) AS n, {sql_r('corr(signal, fwd)', 'ic')} FROM ({RESIDUALS_SQL}) GROUP BY key")
def carry_neutral_ic(spark, sf_dir):
    return statistics.carry_neutral_ic(signals(spark, sf_dir), "key", "signal", "fwd", "carry", "pearson").select("key", "n", r("ic", "ic"))


@query(f"SELECT key, count(*) AS n, {sql_r('corr(c, f)', 'ic')} FROM (SELECT key, {RANKED.format('carry')} AS c, {RANKED.format('fwd')} AS f FROM ({SIGNALS_SQL}) WHERE carry IS NOT NULL AND fwd IS NOT NULL) GROUP BY key")
def carry_only_ic(spark, sf_dir):
    return statistics.information_coefficient(signals(spark, sf_dir), "key", "carry", "fwd").select("key", "n", r("ic", "ic"))


@query(f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY month) > count(*) OVER (PARTITION BY key) // 2 AS late, count(*) OVER (PARTITION BY key) AS n FROM ({SIGNALS_SQL}) WHERE signal IS NOT NULL AND fwd IS NOT NULL AND carry IS NOT NULL),
 f AS (SELECT key, late, avg(signal) AS ms, avg(fwd) AS mf, avg(carry) AS mc, coalesce(covar_pop(signal, carry) / nullif(var_pop(carry), 0), 0) AS bs, coalesce(covar_pop(fwd, carry) / nullif(var_pop(carry), 0), 0) AS bf FROM x WHERE n >= 24 GROUP BY 1, 2),
 z AS (SELECT x.key, x.late, signal - ms - bs * (carry - mc) AS p, fwd - mf - bf * (carry - mc) AS q FROM x JOIN f ON f.key = x.key AND f.late = x.late WHERE n >= 24),
 rk AS (SELECT key, late, rank() OVER (PARTITION BY key, late ORDER BY p) + (count(*) OVER (PARTITION BY key, late, p) - 1) / 2.0 AS p, rank() OVER (PARTITION BY key, late ORDER BY q) + (count(*) OVER (PARTITION BY key, late, q) - 1) / 2.0 AS q FROM z),
 ic AS (SELECT key, late, CASE WHEN count(*) >= 3 THEN corr(p, q) END AS ic FROM rk GROUP BY 1, 2), g AS (SELECT key, max(ic) FILTER (NOT late) AS a, max(ic) FILTER (late) AS b FROM ic GROUP BY 1)
 SELECT k.key, {sql_r('a', 'first')}, {sql_r('b', 'second')}, {sql_r('a - b', 'drop')} FROM (SELECT DISTINCT key FROM ({SIGNALS_SQL})) k LEFT JOIN g ON g.key = k.key""")
def half_sample_ic(spark, sf_dir):
    return statistics.half_sample_ic(signals(spark, sf_dir), "key", "month", "signal", "fwd", "carry").select("key", *(r(c, c) for c in ("first", "second", "drop")))


@query(f"""WITH z AS (SELECT key, signal, fwd FROM ({RESIDUALS_SQL})) SELECT key, count(*) AS n, {sql_r('corr(signal, fwd)', 'ic')} FROM z GROUP BY key""")
def partial_ic(spark, sf_dir):
    return statistics.partial_ic(signals(spark, sf_dir), "key", "signal", "fwd", ["carry"]).select("key", "n", r("ic", "ic"))


@query(f"SELECT key, month, ntile(6) OVER (PARTITION BY key ORDER BY month) - 1 AS fold FROM ({RETURNS_SQL})")
def contiguous_folds(spark, sf_dir):
    return statistics.folds(returns(spark, sf_dir), "key", "month", 6).select("key", "month", "fold")


CHOICES = [(a, b) for a in range(6) for b in range(a + 1, 6)]
CHOICES_SQL = "(VALUES " + ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(CHOICES)) + ") c(choice, a, b)"


@query(f"""WITH g AS (SELECT *, ntile(6) OVER (PARTITION BY key ORDER BY month) - 1 AS g FROM ({SIGNALS_SQL}) WHERE signal IS NOT NULL AND fwd IS NOT NULL),
 x AS (SELECT key, choice, rank() OVER (PARTITION BY key, choice ORDER BY signal) AS p, rank() OVER (PARTITION BY key, choice ORDER BY fwd) AS f FROM g JOIN {CHOICES_SQL} ON g.g IN (c.a, c.b)),
 y AS (SELECT key, choice, corr(p, f) AS ic FROM x GROUP BY 1, 2) SELECT key, {sql_r('avg(ic)', 'mean')}, {sql_r('stddev_pop(ic)', 'std')}, {sql_r('min(ic)', 'least')}, count(*) AS n FROM y GROUP BY key""")
def combinatorial_ic(spark, sf_dir):
    out = statistics.combinatorial_ic(signals(spark, sf_dir), "key", "month", "signal", "fwd")
    return out.select("key", r("mean", "mean"), r("std", "std"), r("least", "least"), "n")


@query()
def backtest_overfitting(spark, sf_dir):
    return statistics.overfitting_probability(_known(spark, sf_dir), "key", "month", "ret", 8)


@query()
def ridge_cpcv(spark, sf_dir):
    return statistics.ridge_cpcv(signals(spark, sf_dir), "month", ["signal", "carry"], "fwd").select("choice", "n", r("ic", "ic"))


@query(f"""SELECT month, {sql_r('sum(d / g * fwd)', 'ret')} FROM (SELECT *, sum(abs(d)) OVER (PARTITION BY month) AS g FROM (SELECT *, carry - avg(carry) OVER (PARTITION BY month) AS d FROM ({SIGNALS_SQL}) WHERE carry IS NOT NULL AND fwd IS NOT NULL)) WHERE g > 0 GROUP BY month""")
def carry_portfolio(spark, sf_dir):
    return statistics.carry_portfolio(signals(spark, sf_dir), "month", "carry", "fwd").where("ret is not null").select("month", r("ret", "ret"))


@query("""WITH e AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM lineitem WHERE l_returnflag = 'N'),
 b AS (SELECT l_returnflag = 'N' AS ref, len(list_filter(edges, lambda x: x < l_extendedprice)) AS bin FROM lineitem, e WHERE l_returnflag IN ('N', 'R')),
 s AS (SELECT ref, bin, count(*) / sum(count(*)) OVER (PARTITION BY ref) AS share FROM b GROUP BY 1, 2)
 SELECT round(sum((q - p) * ln(q / p)), 7) AS psi FROM (SELECT bin, greatest(coalesce(max(share) FILTER (ref), 0), 1e-6) AS p, greatest(coalesce(max(share) FILTER (NOT ref), 0), 1e-6) AS q FROM s GROUP BY bin)""")
def population_stability(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return statistics.population_stability(li.where("l_returnflag = 'N'"), li.where("l_returnflag = 'R'"), "l_extendedprice").select(r("psi", "psi"))


@query(f"""SELECT key, count(*) AS n, {sql_r('avg(ret) * 12', 'ann_return')}, {sql_r('stddev_samp(ret) * sqrt(12)', 'ann_vol')}, {sql_r('min(d)', 'max_drawdown')}, {sql_r('avg((ret > 0)::INT)', 'hit_rate')}, {sql_r('avg(ret) * 12 / (stddev_samp(ret) * sqrt(12))', 'sharpe')} FROM (
 SELECT *, c / max(c) OVER w - 1 AS d FROM (SELECT key, month, ret, product(1 + ret) OVER w AS c FROM ({RETURNS_SQL}) WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING)) GROUP BY key""")
def sleeve_statistics(spark, sf_dir):
    s = statistics.sleeve_statistics(returns(spark, sf_dir), "key", "month", "ret")
    return s.select("key", "n", *(r(c, c) for c in ("ann_return", "ann_vol", "max_drawdown", "hit_rate", "sharpe")))


@query("""WITH x AS (SELECT l_shipmode_key AS key, v, row_number() OVER (PARTITION BY l_shipmode_key ORDER BY v) - 1 AS rn, count(*) OVER (PARTITION BY l_shipmode_key) AS n FROM (SELECT l_returnflag AS l_shipmode_key, l_extendedprice - 40000 AS v FROM lineitem)),
 q AS (SELECT key, n, v AS q FROM x WHERE rn = floor((n - 1) * 0.05)) SELECT x.key, any_value(q.n) AS n, round(-any_value(q), 7) AS var, round(-avg(v), 5) AS es FROM x JOIN q ON x.key = q.key AND x.v <= q.q GROUP BY x.key""")
def historical_tail(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("key"), (F.col("l_extendedprice") - 40000).alias("v"))
    return risk.tail(li, "key", "v").select("key", "n", r("var", "var"), F.round("es", 5).alias("es"))


Z05 = -1.6448536269514729


@query(f"SELECT key, {sql_r(f'-(avg(ret) + stddev_samp(ret) * {Z05})', 'var')}, {sql_r('-avg(ret) + stddev_samp(ret) * (exp(-0.5 * power(' + str(Z05) + ', 2)) / sqrt(2 * pi()) / 0.05)', 'es')} FROM ({RETURNS_SQL}) GROUP BY key")
def parametric_tail(spark, sf_dir):
    m = statistics.moments(returns(spark, sf_dir), "key", "ret")
    return m.select("key", r(risk.parametric_var(F.col("mean"), F.col("sd")), "var"), r(risk.parametric_es(F.col("mean"), F.col("sd")), "es"))


_S, _K = f"({SKEW}) * power(stddev_pop(ret) / stddev_samp(ret), 3)", "(kurtosis_pop(ret) + 3) * power(stddev_pop(ret) / stddev_samp(ret), 4) - 3"


@query(f"SELECT key, {sql_r(f'-(avg(ret) + stddev_samp(ret) * ({Z05} + {(Z05**2 - 1) / 6} * {_S} + {(Z05**3 - 3 * Z05) / 24} * ({_K}) - {(2 * Z05**3 - 5 * Z05) / 36} * power({_S}, 2)))', 'var')} FROM ({RETURNS_SQL}) GROUP BY key")
def cornish_fisher(spark, sf_dir):
    return risk.cornish_fisher_var(returns(spark, sf_dir), "key", "ret").select("key", r("var", "var"))


COV_SQL = f"SELECT a.key AS i, b.key AS j, count(*) AS n, covar_samp(a.ret, b.ret) AS cov, corr(a.ret, b.ret) AS corr FROM ({RETURNS_SQL}) a JOIN ({RETURNS_SQL}) b ON a.month = b.month AND a.key <= b.key WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2"


@query(f"SELECT i, j, n, {sql_r('cov', 'cov')}, {sql_r('corr', 'corr')} FROM ({COV_SQL})")
def covariance_matrix(spark, sf_dir):
    return risk.covariance(returns(spark, sf_dir), "key", "month", "ret").select("i", "j", "n", r("cov", "cov"), r("corr", "corr"))


@query(f"""WITH x AS (SELECT key, month, ret FROM ({RETURNS_SQL}) WHERE ret IS NOT NULL), f AS (SELECT month, power(0.5, (row_number() OVER (ORDER BY month DESC) - 1) / 12.0) AS w FROM (SELECT month FROM x GROUP BY month HAVING count(*) = (SELECT count(DISTINCT key) FROM x))),
 g AS (SELECT month, w / sum(w) OVER () AS w FROM f), m AS (SELECT key, sum(w * ret) AS m FROM x JOIN g USING (month) GROUP BY key), d AS (SELECT key, month, w, ret - m AS e FROM x JOIN g USING (month) JOIN m USING (key))
 SELECT a.key AS i, b.key AS j, {sql_r('sum(a.w * a.e * b.e)', 'cov')} FROM d a JOIN d b ON a.month = b.month AND a.key <= b.key GROUP BY 1, 2""")
def ewma_covariance(spark, sf_dir):
    return risk.ewma_covariance(_known(spark, sf_dir), "key", "month", "ret").select("i", "j", r("cov", "cov"))


def _equal(spark, sf_dir):
    return returns(spark, sf_dir).select(F.col("key").alias("asset")).distinct().withColumn("w", F.lit(0.2))


@query(f"SELECT {sql_r('sum(CASE WHEN i = j THEN 1 ELSE 2 END * 0.04 * cov)', 'variance')}, {sql_r('sqrt(sum(CASE WHEN i = j THEN 1 ELSE 2 END * 0.04 * cov))', 'sigma')} FROM ({COV_SQL})")
def portfolio_variance(spark, sf_dir):
    v = risk.portfolio_variance(_equal(spark, sf_dir), risk.covariance(returns(spark, sf_dir), "key", "month", "ret"))
    return v.select(r("variance", "variance"), r("sigma", "sigma"))


@query(f"""WITH c AS ({COV_SQL}), f AS (SELECT i, j, cov FROM c UNION ALL SELECT j, i, cov FROM c WHERE i <> j), g AS (SELECT i, 0.2 * sum(cov) AS cw FROM f GROUP BY i), t AS (SELECT sqrt(sum(0.2 * cw)) AS s FROM g)
 SELECT i AS asset, {sql_r('1.645 * cw / s', 'marginal')}, {sql_r('0.2 * 1.645 * cw / s', 'component')}, {sql_r('0.2 * cw / (s * s)', 'share')} FROM g, t""")
def component_var(spark, sf_dir):
    c = risk.component_var(_equal(spark, sf_dir), risk.covariance(returns(spark, sf_dir), "key", "month", "ret").select("i", "j", "cov"))
    return c.select("asset", *(r(x, x) for x in ("marginal", "component", "share")))


@query(f"SELECT {sql_r(f'-sqrt(sum(CASE WHEN i = j THEN 1 ELSE 2 END * 0.04 * cov)) * {Z05}', 'var')}, -sqrt(sum(CASE WHEN i = j THEN 1 ELSE 2 END * 0.04 * cov)) * {Z05} > 0.1 AS breach FROM ({COV_SQL})")
def pretrade_gate(spark, sf_dir):
    g = risk.pretrade_gate(_equal(spark, sf_dir), risk.covariance(returns(spark, sf_dir), "key", "month", "ret"), 0.1)
    return g.select(r("var", "var"), "breach")


@query()
def garch_volatility(spark, sf_dir):
    return risk.garch(_known(spark, sf_dir).select("key", "month", "ret"), "key", "month", "ret").select("key", "month", r("garch_vol", "garch_vol"))


#: The GARCH and correlation parameters of the queries that fit none.
ALPHA, BETA, DCC_A, DCC_B = 0.06, 0.9, 0.03, 0.95
DCC_SQL = f"""WITH RECURSIVE x AS (SELECT key, month, ret FROM ({RETURNS_SQL}) WHERE ret IS NOT NULL),
 times AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS s FROM (SELECT month FROM x GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT key) FROM x))),
 e AS (SELECT key, s, ret - avg(ret) OVER (PARTITION BY key) AS e, var_pop(ret) OVER (PARTITION BY key) AS v FROM x JOIN times USING (month)),
 n AS (SELECT max(s) + 1 AS n FROM times),
 h AS (SELECT key, s, e, v, v AS h FROM e WHERE s = 0 UNION ALL SELECT e.key, e.s, e.e, e.v, e.v * (1 - {ALPHA} - {BETA}) + {ALPHA} * h.e * h.e + {BETA} * h.h FROM h JOIN e ON e.key = h.key AND e.s = h.s + 1),
 z AS (SELECT key, s, e / sqrt(h) AS z FROM h),
 ahead AS (SELECT key, sqrt(v * (1 - {ALPHA} - {BETA}) + {ALPHA} * e * e + {BETA} * h) AS sigma FROM h, n WHERE s = n.n - 1),
 p AS (SELECT a.key AS i, b.key AS j, a.s, a.z * b.z AS zz, a.z AS zi, b.z AS zj FROM z a JOIN z b ON a.s = b.s AND a.key <= b.key),
 c AS (SELECT i, j, covar_samp(zi, zj) AS c FROM p GROUP BY 1, 2),
 bar AS (SELECT c.i, c.j, c.c / sqrt(a.c * b.c) AS qbar FROM c JOIN c a ON a.i = c.i AND a.j = c.i JOIN c b ON b.i = c.j AND b.j = c.j),
 q AS (SELECT i, j, 0::BIGINT AS s, qbar, qbar AS q FROM bar UNION ALL SELECT q.i, q.j, q.s + 1, q.qbar, (1 - {DCC_A} - {DCC_B}) * q.qbar + {DCC_A} * p.zz + {DCC_B} * q.q FROM q JOIN p ON p.i = q.i AND p.j = q.j AND p.s = q.s JOIN n ON q.s + 1 < n.n),
 last AS (SELECT q.* FROM q, n WHERE q.s = n.n - 1),
 r AS (SELECT l.i, l.j, l.q / sqrt(a.q * b.q) AS corr FROM last l JOIN last a ON a.i = l.i AND a.j = l.i JOIN last b ON b.i = l.j AND b.j = l.j)"""


@query(f"{DCC_SQL} SELECT i, j, {sql_r('corr', 'corr')} FROM r")
def dcc_correlation(spark, sf_dir):
    return risk.dcc_correlation(_known(spark, sf_dir), "key", "month", "ret", DCC_A, DCC_B, (ALPHA, BETA)).select("i", "j", r("corr", "corr"))


@query(f"{DCC_SQL} SELECT r.i, r.j, {sql_r('a.sigma * corr * b.sigma', 'cov')} FROM r JOIN ahead a ON a.key = r.i JOIN ahead b ON b.key = r.j")
def dcc_garch_covariance(spark, sf_dir):
    return risk.dcc_garch_covariance(_known(spark, sf_dir), "key", "month", "ret", DCC_A, DCC_B, (ALPHA, BETA)).select("i", "j", r("cov", "cov"))


@query(f"SELECT key, year(month) AS year, {sql_r('product(1 + ret) - 1', 'ret')}, {sql_r('avg((ret > 0)::INT)', 'hits')}, arg_max(month, ret) AS best, arg_min(month, ret) AS worst FROM ({RETURNS_SQL}) WHERE ret IS NOT NULL GROUP BY 1, 2")
def calendar_years(spark, sf_dir):
    g = _known(spark, sf_dir).groupBy("key", F.year("month").cast("long").alias("year"))
    return g.agg(r(F.product(1 + F.col("ret")) - 1, "ret"), r(F.avg((F.col("ret") > 0).cast("double")), "hits"), F.max_by("month", "ret").alias("best"), F.min_by("month", "ret").alias("worst"))


@query(f"SELECT key, {sql_r('max(s)', 'high')}, {sql_r('min(s)', 'low')}, {sql_r('avg(s)', 'mean')}, {sql_r('avg((s > 0)::INT)', 'above')} FROM (SELECT key, CASE WHEN count(ret) OVER p >= 12 THEN avg(ret) OVER p / nullif(stddev_pop(ret) OVER p, 0) * sqrt(12) END AS s FROM ({RETURNS_SQL}) WINDOW p AS (PARTITION BY key ORDER BY month ROWS 11 PRECEDING)) WHERE s IS NOT NULL GROUP BY key")
def rolling_sharpe(spark, sf_dir):
    w = timeline()
    sd = series.rolling(F.stddev_pop, "ret", w, 12)
    s = returns(spark, sf_dir).select("key", (series.rolling(F.avg, "ret", w, 12) / F.when(sd != 0, sd) * 12**0.5).alias("s")).where("s is not null")
    return s.groupBy("key").agg(r(F.max("s"), "high"), r(F.min("s"), "low"), r(F.avg("s"), "mean"), r(F.avg((F.col("s") > 0).cast("double")), "above"))


GATE_SQL = f"""WITH f AS (SELECT key, month, signal, fwd, carry FROM ({SIGNALS_SQL}) WHERE signal IS NOT NULL AND fwd IS NOT NULL AND carry IS NOT NULL)"""


@query(f"""{GATE_SQL}, ic AS (SELECT key, count(*) AS n, corr(p, q) AS ic FROM (SELECT key, {RANKED.format('signal')} AS p, {RANKED.format('fwd')} AS q FROM f) GROUP BY 1),
 b AS (SELECT key, avg(signal) AS ms, avg(fwd) AS mf, avg(carry) AS mc, coalesce(covar_pop(signal, carry) / nullif(var_pop(carry), 0), 0) AS bs, coalesce(covar_pop(fwd, carry) / nullif(var_pop(carry), 0), 0) AS bf FROM f GROUP BY 1),
 z AS (SELECT f.key, signal - ms - bs * (carry - mc) AS p, fwd - mf - bf * (carry - mc) AS q FROM f JOIN b USING (key)),
 cn AS (SELECT key, corr(rp, rq) AS ic FROM (SELECT key, {RANKED.format('p')} AS rp, {RANKED.format('q')} AS rq FROM z) GROUP BY 1),
 co AS (SELECT key, corr(p, q) AS ic FROM (SELECT key, {RANKED.format('carry')} AS p, {RANKED.format('fwd')} AS q FROM f) GROUP BY 1)
 SELECT ic.key, n, {sql_r('ic.ic', 'ic')}, {sql_r('cn.ic', 'carry_neutral_ic')}, {sql_r('co.ic', 'carry_only_ic')} FROM ic JOIN cn USING (key) JOIN co USING (key)""")
def instrument_measures(spark, sf_dir):
    m = gate.instrument_measures(signals(spark, sf_dir), "key", "month", "signal", "fwd", "carry")
    return m.select("key", "n", *(r(c, c) for c in ("ic", "carry_neutral_ic", "carry_only_ic")))


@query()
def promotion_report(spark, sf_dir):
    s = signals(spark, sf_dir)
    overlay = s.where("fwd is not null and signal is not null").groupBy("month").agg(F.avg(F.signum("signal") * F.col("fwd")).alias("ret"))
    trials = _known(spark, sf_dir).select(F.col("key").alias("trial"), "month", "ret")
    g = gate.promotion_report(s, overlay, "key", "month", "signal", "fwd", "carry", "ret", 10, candidates=trials)
    return g.select("overlay_n", "instruments", *(r(c, c) for c in ("overlay_sharpe", "overlay_dsr", "carry_sharpe", "carry_neutral_ic", "carry_neutral_ic_t", "worst_fold", "decay", "pbo")), F.array_join("reasons", ", ").alias("reasons"), "passed")


@query()
def rank_signals(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("level", F.avg("ret").over(timeline().rowsBetween(-2, 0)))
    pairs = s.select(F.col("key").alias("instrument"), "month", "fwd", "carry", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("signal")) for c in ("ret", "signal", "level")))).alias("f")).select("instrument", "month", "fwd", "carry", "f.*")
    found = gate.rank_signals(pairs, "month")
    return found.select("instrument", "feature", "n", "rank", "hypotheses", *(r(c, c) for c in ("ic", "carry_neutral_ic", "decay", "fold_mean", "fold_least")), F.array_join("reasons", ", ").alias("reasons"), "passed")
