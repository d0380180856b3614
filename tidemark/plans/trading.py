"""Desk, paper trading, execution and online intelligence queries.

Books of positions are made from the customer table: the market segment and
nation of a customer give a book its weights.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series
from ..operators import autonomy, desk, execution, intelligence, ledger
from ..session import table
from .base import RETURNS_SQL, SIGNALS_SQL, monthly, r, returns, signals, sql_r, timeline

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


SEGMENTS = {"AUTOMOBILE": "fx", "BUILDING": "front", "FURNITURE": "belly", "HOUSEHOLD": "long", "MACHINERY": "hard"}
_CASE = "CASE c_mktsegment " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SEGMENTS.items()) + " END"
WEIGHTS_SQL = f"SELECT c_nationkey AS book, {_CASE} AS instrument, sum(c_acctbal::DECIMAL(18, 2))::DOUBLE / 1000000 AS weight, 0.01::DOUBLE AS expected, 50000000.0::DOUBLE AS aum, 0.1::DOUBLE AS vol_target FROM customer GROUP BY 1, 2"
MARKET_SQL = "SELECT DISTINCT c_nationkey AS book, 5.18::DOUBLE AS spot, 12.5::DOUBLE AS vol30d, (13.0 + c_nationkey % 3)::DOUBLE AS di1y, 13.9::DOUBLE AS di5y, 14.4::DOUBLE AS di10y, 228.0::DOUBLE AS embi FROM customer"


def weights(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    kind = F.element_at(F.create_map(*(F.lit(x) for item in SEGMENTS.items() for x in item)), F.col("c_mktsegment"))
    g = c.groupBy(F.col("c_nationkey").alias("book"), kind.alias("instrument")).agg((F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double") / 1000000).alias("weight"))
    return g.select("*", F.lit(0.01).alias("expected"), F.lit(50000000.0).alias("aum"), F.lit(0.1).alias("vol_target"))


def market(spark, sf_dir):
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("book")).distinct()
    flat = {"spot": 5.18, "vol30d": 12.5, "di5y": 13.9, "di10y": 14.4, "embi": 228.0}
    return b.select("book", *(F.lit(v).alias(n) for n, v in flat.items()), (13.0 + F.col("book") % 3).alias("di1y"))


def positions(spark, sf_dir):
    return desk.size_contracts(desk.risk_budget(weights(spark, sf_dir)), market(spark, sf_dir))


BUDGET_SQL = f"SELECT *, CASE WHEN weight > 0.001 THEN 'long' WHEN weight < -0.001 THEN 'short' ELSE 'flat' END AS direction, abs(weight) * aum * vol_target AS risk_brl, sum(abs(weight)) OVER (PARTITION BY book) AS tw FROM ({WEIGHTS_SQL})"


@query(f"SELECT book, instrument, direction, {sql_r('risk_brl', 'risk_brl')}, {sql_r('abs(weight) / tw * 100', 'risk_pct')}, {sql_r('expected * 12', 'expected_annual')}, {sql_r('weight * expected', 'sharpe_part')} FROM ({BUDGET_SQL})")
def risk_budget(spark, sf_dir):
    b = desk.risk_budget(weights(spark, sf_dir))
    return b.select("book", "instrument", "direction", *(r(c, c) for c in ("risk_brl", "risk_pct", "expected_annual", "sharpe_part")))


SIZED_SQL = f"""SELECT *, floor(exact + 0.5)::BIGINT AS contracts FROM (SELECT b.*, m.* EXCLUDE (book), CASE instrument WHEN 'fx' THEN 10000.0 WHEN 'hard' THEN 50000.0 ELSE 100000.0 END AS size,
 CASE instrument WHEN 'front' THEN 0.95 WHEN 'belly' THEN 4.2 WHEN 'long' THEN 7.5 WHEN 'hard' THEN 4.5 ELSE 0 END AS dur, CASE instrument WHEN 'front' THEN di1y WHEN 'belly' THEN di5y WHEN 'long' THEN di10y END / 100 AS y,
 CASE instrument WHEN 'fx' THEN risk_brl / (vol30d / 100) / spot / 10000 WHEN 'hard' THEN least(risk_brl / (spot * embi) / (50000.0 * 4.5 / 10000), aum * 2 / (50000.0 * spot))
  ELSE risk_brl / (y * dur * 10000) / (100000 / power(1 + y, dur) * dur / 10000) END AS exact FROM ({BUDGET_SQL}) b JOIN ({MARKET_SQL}) m USING (book))"""


@query(f"SELECT book, instrument, {sql_r('exact', 'contracts_exact')}, contracts, {sql_r('contracts * size * CASE WHEN instrument IN (' + repr('fx') + ',' + repr('hard') + ') THEN spot ELSE 1 END * CASE instrument WHEN ' + repr('fx') + ' THEN 0.15 WHEN ' + repr('hard') + ' THEN 0.04 ELSE 0.02 END', 'margin_brl')} FROM ({SIZED_SQL})")
def size_contracts(spark, sf_dir):
    return positions(spark, sf_dir).select("book", "instrument", r("contracts_exact", "contracts_exact"), "contracts", r("margin_brl", "margin_brl"))


#: Positions with all that the desk's reports read.
POSITIONS_SQL = f"""SELECT *, CASE direction WHEN 'long' THEN 1 WHEN 'short' THEN -1 ELSE 0 END AS sgn, CASE WHEN y IS NOT NULL THEN risk_brl / (y * dur * 10000) END AS dv01, CASE instrument WHEN 'hard' THEN risk_brl / (spot * embi) END AS spread_dv01,
 CASE WHEN instrument = 'fx' THEN risk_brl / (vol30d / 100) WHEN instrument = 'hard' THEN exact * size * spot ELSE exact * 100000 / power(1 + y, dur) END AS notional,
 contracts * size * CASE WHEN instrument IN ('fx', 'hard') THEN spot ELSE 1 END * CASE instrument WHEN 'fx' THEN 0.15 WHEN 'hard' THEN 0.04 ELSE 0.02 END AS margin FROM ({SIZED_SQL})"""
_RHO = "(VALUES " + ", ".join(f"('{a}', '{b}', {desk.CORRELATIONS[i][j]})" for i, a in enumerate(desk.NAMES) for j, b in enumerate(desk.NAMES)) + ") c(i, j, rho)"
_VOL = "CASE instrument " + " ".join(f"WHEN '{n}' THEN {0.125 if n == 'fx' else v}" for n, v in desk.VOLATILITIES.items()) + " END"
EXPOSED_SQL = f"SELECT book, instrument, CASE WHEN direction = 'flat' THEN 0 ELSE risk_brl END * {_VOL} / sqrt(252) AS v FROM ({BUDGET_SQL})"


@query(f"SELECT book, {sql_r('s', 'sigma')}, {sql_r('s * 1.645', 'var95')}, {sql_r('s * 2.326', 'var99')}, {sql_r('s * 1.645 * sqrt(21)', 'month95')}, {sql_r('s * 2.326 * sqrt(21)', 'month99')} FROM (SELECT a.book, sqrt(sum(a.v * b.v * rho)) AS s FROM ({EXPOSED_SQL}) a JOIN ({EXPOSED_SQL}) b ON a.book = b.book JOIN {_RHO} ON a.instrument = i AND b.instrument = j GROUP BY a.book)")
def value_at_risk(spark, sf_dir):
    v = desk.value_at_risk(positions(spark, sf_dir), market(spark, sf_dir))
    return v.select("book", *(r(c, c) for c in ("sigma", "var95", "var99", "month95", "month99")))


@query(f"""WITH m AS (SELECT a.book, a.instrument, any_value(a.v) AS v, sum(b.v * rho) AS m FROM ({EXPOSED_SQL}) a JOIN ({EXPOSED_SQL}) b ON a.book = b.book JOIN {_RHO} ON a.instrument = i AND b.instrument = j GROUP BY 1, 2)
 SELECT book, instrument, {sql_r('m / s * 1.645', 'marginal')}, {sql_r('abs(v * m / s * 1.645)', 'contribution')}, {sql_r('abs(v * m) / (s * s) * 100', 'share_pct')} FROM (SELECT *, sqrt(sum(v * m) OVER (PARTITION BY book)) AS s FROM m)""")
def component_value_at_risk(spark, sf_dir):
    c = desk.component_value_at_risk(positions(spark, sf_dir), market(spark, sf_dir))
    return c.select("book", "instrument", *(r(x, x) for x in ("marginal", "contribution", "share_pct")))


_SHOCKS = "(VALUES " + ", ".join(f"('{name}', '{n}', {x})" for name, row in desk.SCENARIOS.items() for n, x in zip(desk.NAMES, row)) + ") s(scenario, instrument, shock)"


@query(f"""SELECT book, scenario, {sql_r('pnl', 'pnl_brl')}, {sql_r('pnl / aum * 100', 'pnl_pct')} FROM (SELECT book, scenario, any_value(aum) AS aum,
 sum(-sgn * shock * CASE instrument WHEN 'fx' THEN notional WHEN 'hard' THEN spread_dv01 * 10000 ELSE dv01 * 10000 END) AS pnl FROM ({POSITIONS_SQL}) p JOIN {_SHOCKS} USING (instrument) GROUP BY 1, 2)""")
def stress_scenarios(spark, sf_dir):
    return desk.stress(positions(spark, sf_dir)).select("book", "scenario", r("pnl_brl", "pnl_brl"), r("pnl_pct", "pnl_pct"))


@query(f"SELECT book, {sql_r('sum(power(risk_brl / t, 2))', 'herfindahl')}, {sql_r('max(risk_brl / t) * 100', 'largest_pct')} FROM (SELECT *, sum(risk_brl) OVER (PARTITION BY book) AS t FROM ({BUDGET_SQL})) GROUP BY book")
def concentration(spark, sf_dir):
    return desk.exposure(positions(spark, sf_dir)).select("book", r("herfindahl", "herfindahl"), r("largest_pct", "largest_pct"))


@query(f"""SELECT book, {sql_r('aum', 'aum')}, {sql_r('gross', 'gross_brl')}, {sql_r('net', 'net_brl')}, {sql_r('delta', 'fx_delta_brl')}, {sql_r('dv', 'dv01_brl')}, {sql_r('sp', 'spread_dv01_usd')}, {sql_r('margin', 'margin_brl')}, {sql_r('largest * 100', 'largest_pct')}, {sql_r('hh', 'herfindahl')}, {sql_r('gross / aum', 'gross_leverage')}, {sql_r('net / aum', 'net_leverage')}, {sql_r('margin / aum * 100', 'margin_pct')} FROM (
 SELECT book, any_value(aum) AS aum, sum(notional) AS gross, sum(notional * sgn) AS net, sum(CASE WHEN instrument = 'fx' THEN CASE WHEN weight > 0 THEN -notional ELSE notional END ELSE 0 END) AS delta, sum(coalesce(dv01, 0) * sgn) AS dv, sum(coalesce(spread_dv01, 0) * sgn) AS sp, sum(margin) AS margin, max(share) AS largest, sum(share * share) AS hh
 FROM (SELECT *, risk_brl / sum(risk_brl) OVER (PARTITION BY book) AS share FROM ({POSITIONS_SQL})) GROUP BY 1)""")
def exposure(spark, sf_dir):
    e = desk.exposure(positions(spark, sf_dir))
    return e.select("book", *(r(c, c) for c in e.columns if c != "book"))


@query(f"""SELECT book, instrument, CASE WHEN d > 0 THEN 'BUY' WHEN d < 0 THEN 'SELL' ELSE 'HOLD' END AS action, d AS delta FROM (
 SELECT book, instrument, CASE WHEN direction = 'short' THEN -contracts ELSE contracts END - CASE WHEN book % 4 = 0 THEN 0 ELSE CASE WHEN direction = 'short' THEN -floor(contracts / 2) ELSE floor(contracts / 2) END END::BIGINT AS d FROM ({SIZED_SQL}))""")
def rebalancing(spark, sf_dir):
    target = positions(spark, sf_dir)
    current = target.where("book % 4 <> 0").withColumn("contracts", F.floor(F.col("contracts") / 2))
    return desk.rebalance(current, target).select("book", "instrument", "action", "delta")


@query(f"""SELECT book, instrument, {sql_r('now', 'current_price')}, {sql_r("CASE instrument WHEN 'fx' THEN notional / spot * (now - spot) * sgn WHEN 'hard' THEN -spread_dv01 * (now - embi) * sgn * 5.3 ELSE -dv01 * (now - y * 100) * 100 * sgn END + 0.0", 'pnl_brl')} FROM (
 SELECT *, CASE instrument WHEN 'fx' THEN 5.3 WHEN 'front' THEN di1y WHEN 'belly' THEN 13.6 WHEN 'long' THEN di10y WHEN 'hard' THEN 240 END AS now FROM ({POSITIONS_SQL}))""")
def mark_to_market(spark, sf_dir):
    later = market(spark, sf_dir).withColumn("spot", F.lit(5.3)).withColumn("embi", F.lit(240.0)).withColumn("di5y", F.lit(13.6))
    m = desk.mark_to_market(positions(spark, sf_dir), later)
    return m.select("book", "instrument", r("current_price", "current_price"), r("pnl_brl", "pnl_brl"))


@query(f"""WITH p AS (SELECT *, CASE instrument WHEN 'fx' THEN 'fx' WHEN 'hard' THEN 'credit' ELSE 'rates' END AS factor, CASE instrument WHEN 'fx' THEN notional WHEN 'hard' THEN spread_dv01 * 50 ELSE dv01 * 100 END AS rk FROM ({POSITIONS_SQL})),
 g AS (SELECT book, factor, sum(abs(notional)) AS e, sum(abs(rk)) AS rk FROM p GROUP BY 1, 2), b AS (SELECT book, any_value(aum) AS aum FROM p GROUP BY 1),
 x AS (SELECT b.book, d.factor, lim, aum, coalesce(e, 0) AS e, coalesce(rk, 0) AS rk FROM b CROSS JOIN (VALUES ('fx', 30.0), ('rates', 100.0), ('credit', 50.0)) d(factor, lim) LEFT JOIN g ON g.book = b.book AND g.factor = d.factor)
 SELECT book, factor, {sql_r('e', 'exposure_brl')}, {sql_r('e / aum * 100', 'exposure_pct')}, {sql_r('rk / sum(rk) OVER (PARTITION BY book) * 100', 'risk_pct')}, {sql_r('e / aum * 100 / lim * 100', 'utilization_pct')}, e / aum * 100 > lim AS breached FROM x""")
def factor_exposure(spark, sf_dir):
    f = desk.factor_exposure(positions(spark, sf_dir))
    return f.select("book", "factor", *(r(c, c) for c in ("exposure_brl", "exposure_pct", "risk_pct", "utilization_pct")), "breached")


@query("""SELECT o_orderkey, 'WDO' || substr('FGHJKMNQUVXZ', month(n)::INT, 1) || lpad((year(n) % 100)::VARCHAR, 2, '0') AS fx_ticker FROM (SELECT o_orderkey, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS n FROM orders)""")
def fx_tickers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", desk.nearest_fx_ticker("WDO", F.col("o_orderdate")).alias("fx_ticker"))


@query("""SELECT o_orderkey, """ + ", ".join(f"'DI1' || substr('FGHJKMNQUVXZ', best.m, 1) || lpad(((year(o_orderdate) + {t} + (best.m < month(o_orderdate) AND best.d > 1)::INT) % 100)::VARCHAR, 2, '0') AS di{t}" for t in (1, 5, 10)) + """
 FROM (SELECT *, list_min([{'d': abs(1 - month(o_orderdate)), 'm': 1}, {'d': abs(4 - month(o_orderdate)), 'm': 4}, {'d': abs(7 - month(o_orderdate)), 'm': 7}, {'d': abs(10 - month(o_orderdate)), 'm': 10}]) AS best FROM orders)""")
def di_tickers(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", *(desk.nearest_di_ticker(t, F.col("o_orderdate")).alias(f"di{t}") for t in (1, 5, 10)))


@query("""SELECT l_orderkey AS order_id, qty, coalesce(filled, 0) AS filled, greatest(qty - coalesce(filled, 0), 0) AS remaining, round(avg_price, 7) AS avg_price, coalesce(n, 0) AS n_fills,
 CASE WHEN coalesce(filled, 0) <= 0 THEN 'WORKING' WHEN qty - filled <= 1e-9 THEN 'FILLED' ELSE 'PARTIAL' END AS state, coalesce(filled, 0) > qty + 1e-9 AS overfilled FROM (
 SELECT l_orderkey, sum(l_quantity) AS qty, sum(l_quantity) FILTER (l_linestatus = 'F') AS filled, sum(l_quantity * l_extendedprice) FILTER (l_linestatus = 'F') / sum(l_quantity) FILTER (l_linestatus = 'F') AS avg_price, count(*) FILTER (l_linestatus = 'F') AS n FROM lineitem GROUP BY 1)""")
def order_fills(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), "l_linestatus")
    orders = li.groupBy("order_id").agg(F.sum("qty").alias("qty"))
    return execution.apply_fills(orders, li.where("l_linestatus = 'F'")).withColumn("avg_price", r("avg_price", "avg_price"))


@query()
def paper_fills(spark, sf_dir):
    w = timeline()
    s = monthly(spark, sf_dir).select("key", "month", (F.col("total") / 1e6).alias("price"), F.col("n").cast("double").alias("liquidity"), (10 * series.causal_position("total", w)).alias("target"))
    f = execution.paper_fills(s, "key", "month", "target", "price", "liquidity", slippage_bps=5, cost_bps=2, participation=0.02)
    return f.select("key", "month", *(r(c, c) for c in ("position", "traded", "fill_price", "commission", "slippage_cost")))


def _decided(spark, sf_dir):
    return ledger.decisions(signals(spark, sf_dir), "key", "month", "signal", 12)


POSITION_SQL = f"""SELECT key, last_day((data_month + 1)::DATE) AS month, least(greatest((signal - mu) / sd, -2), 2) / 2 AS frozen_position, signal, (signal - mu) / sd AS signal_z, data_month FROM (
 SELECT key, month AS data_month, signal, count(signal) OVER p AS n, avg(signal) OVER p AS mu, stddev_samp(signal) OVER p AS sd FROM (SELECT key, month, lag(ret) OVER (PARTITION BY key ORDER BY month) AS signal FROM ({RETURNS_SQL})) WHERE signal IS NOT NULL WINDOW p AS (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING)) WHERE n >= 12 AND sd > 0"""


@query(f"SELECT key, month, {sql_r('frozen_position', 'frozen_position')}, {sql_r('signal_z', 'signal_z')}, data_month FROM ({POSITION_SQL})")
def paper_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).select("key", "month", r("frozen_position", "frozen_position"), r("signal_z", "signal_z"), "data_month")


REALIZED_SQL = f"""SELECT a.key, a.month, a.frozen_position AS held, b.frozen_position AS previous, ret AS realized, a.frozen_position * ret - abs(a.frozen_position - b.frozen_position) * 0.0002 AS sleeve_return
 FROM ({POSITION_SQL}) a JOIN ({POSITION_SQL}) b ON a.key = b.key AND last_day((b.month + 1)::DATE) = a.month JOIN ({RETURNS_SQL}) x ON x.key = a.key AND x.month = a.month WHERE ret IS NOT NULL"""


@query(f"SELECT key, month, {sql_r('held', 'held')}, {sql_r('previous', 'previous')}, {sql_r('realized', 'realized')}, {sql_r('sleeve_return', 'sleeve_return')} FROM ({REALIZED_SQL})")
def paper_realizations(spark, sf_dir):
    x = ledger.realizations(_decided(spark, sf_dir), returns(spark, sf_dir), "key", "2002-01-01").where("stream = 'frozen'")
    return x.select("key", "month", *(r(c, c) for c in ("held", "previous", "realized", "sleeve_return")))


@query(f"""WITH x AS (SELECT *, product(1 + sleeve_return) OVER w AS c FROM ({REALIZED_SQL}) WINDOW w AS (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING)), y AS (SELECT *, c / max(c) OVER (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING) - 1 AS d FROM x)
 SELECT key, count(*) AS n, {sql_r('arg_max(c, month) - 1', 'cumulative')}, {sql_r('arg_max(sleeve_return, month)', 'last')}, {sql_r('min(d)', 'max_drawdown')}, {sql_r('stddev_samp(sleeve_return)', 'vol')} FROM y GROUP BY key""")
def paper_telemetry(spark, sf_dir):
    x = ledger.realizations(_decided(spark, sf_dir), returns(spark, sf_dir), "key", "2002-01-01")
    return ledger.telemetry(x, "key").select("key", "n", *(r(c, c) for c in ("cumulative", "last", "max_drawdown", "vol")))


@query(f"""WITH x AS (SELECT *, product(1 + sleeve_return) OVER (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING) AS c, CASE WHEN count(*) OVER w >= 6 THEN avg(sleeve_return) OVER w / nullif(stddev_samp(sleeve_return) OVER w, 0) END AS s FROM ({REALIZED_SQL}) WINDOW w AS (PARTITION BY key ORDER BY month ROWS 5 PRECEDING)),
 y AS (SELECT *, c / max(c) OVER (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING) - 1 AS d FROM x), g AS (SELECT key, min(d) AS d, arg_max(s, month) AS s FROM y GROUP BY 1)
 SELECT key, {sql_r('d', 'drawdown')}, {sql_r('s', 'rolling_sharpe')}, d <= -0.03 OR coalesce(s < 0, false) AS halted FROM g""")
def paper_breaker(spark, sf_dir):
    x = ledger.realizations(_decided(spark, sf_dir), returns(spark, sf_dir), "key", "2002-01-01")
    return ledger.circuit_breaker(x, "key").select("key", r("drawdown", "drawdown"), r("rolling_sharpe", "rolling_sharpe"), "halted")


@query(f"SELECT month, {sql_r('avg(sleeve_return)', 'ret')} FROM ({REALIZED_SQL}) GROUP BY month HAVING count(*) = (SELECT count(DISTINCT key) FROM ({REALIZED_SQL}))")
def paper_pool(spark, sf_dir):
    x = ledger.realizations(_decided(spark, sf_dir), returns(spark, sf_dir), "key", "2002-01-01")
    return ledger.pooled(x, "key").select("month", r("ret", "ret"))


@query(f"""WITH x AS (SELECT key, sleeve_return AS v, row_number() OVER (PARTITION BY key ORDER BY sleeve_return) - 1 AS k, count(*) OVER (PARTITION BY key) AS n FROM ({REALIZED_SQL})),
 q AS (SELECT key, v FROM x WHERE k = floor((n - 1) * 0.05)), t AS (SELECT x.key, any_value(n) AS n, -any_value(q.v) AS var, -avg(x.v) AS es FROM x JOIN q ON q.key = x.key AND x.v <= q.v GROUP BY 1),
 c AS (SELECT key, n, list_min([{{'v': 3.0::DOUBLE, 'b': 'requested'}}, {{'v': CASE WHEN var > 0 THEN 0.5 / var ELSE 'inf'::DOUBLE END, 'b': 'var'}}, {{'v': CASE WHEN es > 0 THEN 0.6 / es ELSE 'inf'::DOUBLE END, 'b': 'es'}}]) AS best FROM t)
 SELECT key, n, n >= 24 AS active, {sql_r('CASE WHEN n >= 24 THEN best.v ELSE 3 END', 'applied')}, CASE WHEN n >= 24 THEN best.b ELSE 'inactive' END AS binding FROM c""")
def leverage_gate(spark, sf_dir):
    x = ledger.realizations(_decided(spark, sf_dir), returns(spark, sf_dir), "key", "2002-01-01")
    g = ledger.leverage_gate(x, "key", 3.0, 0.5, 0.6)
    return g.select("key", "n", "active", r("applied", "applied"), "binding")


@query(f"""WITH x AS (SELECT key, month, CASE WHEN count(ret) OVER w >= 12 THEN 1 / var_samp(ret) OVER w END AS raw FROM ({RETURNS_SQL}) WINDOW w AS (PARTITION BY key ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
 SELECT key, month, {sql_r('raw / sum(raw) OVER (PARTITION BY month)', 'weight')} FROM x""")
def inverse_variance_weights(spark, sf_dir):
    return intelligence.inverse_variance_weights(returns(spark, sf_dir), "key", "month", "ret").select("key", "month", r("weight", "weight"))


@query()
def performance_weights(spark, sf_dir):
    known = returns(spark, sf_dir).select("key", "month", "ret")
    return intelligence.ewma_performance_weights(known, "key", "month", "ret").select("key", "month", r("weight", "weight"))


@query(f"""WITH e AS (SELECT key, month, abs(ret - signal) AS e FROM ({SIGNALS_SQL})), p AS (SELECT key, month, list_sort(list_filter(list(e) OVER (PARTITION BY key ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda v: v IS NOT NULL)) AS past FROM e),
 w AS (SELECT key, month, CASE WHEN len(past) >= 24 THEN past[least(ceil(least(1.0, ceil((len(past) + 1) * 0.9 - 1e-12) / len(past)) * (len(past) - 1) - 1e-9), len(past) - 1)::INT + 1] END AS width FROM p),
 c AS (SELECT *, CASE WHEN count(width) OVER w >= 12 THEN median(width) OVER w / nullif(width, 0) END AS ratio FROM w WINDOW w AS (PARTITION BY key ORDER BY month ROWS UNBOUNDED PRECEDING))
 SELECT key, month, {sql_r('width', 'width')}, {sql_r('CASE WHEN ratio IS NOT NULL THEN least(ratio, 1) END', 'confidence')} FROM c""")
def conformal_intervals(spark, sf_dir):
    w = timeline()
    s = signals(spark, sf_dir).withColumn("width", intelligence.conformal_width(F.col("ret") - F.col("signal"), w))
    return s.select("key", "month", r("width", "width"), r(intelligence.interval_confidence("width", w, 12), "confidence"))


@query(f"SELECT key, month, CASE WHEN signal <> 0 AND fwd IS NOT NULL THEN (sign(signal) = sign(fwd))::INT END AS label FROM (SELECT key, month, lag(ret) OVER w AS signal, lead(ret) OVER w AS fwd FROM ({RETURNS_SQL}) WINDOW w AS (PARTITION BY key ORDER BY month))")
def meta_labels(spark, sf_dir):
    return signals(spark, sf_dir).select("key", "month", intelligence.meta_label(F.col("signal"), F.col("fwd")).alias("label"))


@query()
def meta_probability(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("label", intelligence.meta_label(F.col("signal"), F.col("fwd")).cast("double"))
    return intelligence.meta_probability(s, "key", "month", ["signal", "carry"], "label").select("key", "month", r("proba", "proba"))


@query(f"SELECT key, month, ret, row_number() OVER (PARTITION BY month ORDER BY ret DESC NULLS LAST, key) <= 2 AND ret IS NOT NULL AS selected FROM (SELECT key, month, round(ret, 7) AS ret FROM ({RETURNS_SQL}))")
def top_k_mask(spark, sf_dir):
    x = returns(spark, sf_dir).select("key", "month", r("ret", "ret"))
    return intelligence.selected(x, "month", "key", "ret", top=2)


@query()
def rolling_importance(spark, sf_dir):
    s = signals(spark, sf_dir).select("key", "month", "signal", "carry", "fwd")
    return intelligence.rolling_importance(s, "key", "month", ["signal", "carry"], "fwd").withColumn("importance", r("importance", "importance"))


OPERATED_SQL = f"SELECT key, month, round(frozen_position / 2, 6) AS operator_position FROM ({POSITION_SQL}) WHERE month(month) % 4 <> 0"


@query(f"""WITH o AS ({OPERATED_SQL}) SELECT o.key, o.month, {sql_r('o.operator_position', 'held')}, {sql_r('coalesce(b.operator_position, 0)', 'previous')}, {sql_r('o.operator_position * ret - abs(o.operator_position - coalesce(b.operator_position, 0)) * 0.0002', 'sleeve_return')}
 FROM o LEFT JOIN o b ON b.key = o.key AND last_day((b.month + 1)::DATE) = o.month JOIN ({RETURNS_SQL}) x ON x.key = o.key AND x.month = o.month WHERE ret IS NOT NULL""")
def operator_realizations(spark, sf_dir):
    decided = _decided(spark, sf_dir)
    operator = decided.where("month(month) % 4 <> 0").select("key", "month", F.round(F.col("frozen_position") / 2, 6).alias("operator_position"))
    x = autonomy.operator_realizations(decided, operator, returns(spark, sf_dir), "key", "2002-01-01")
    return x.select("key", "month", *(r(c, c) for c in ("held", "previous", "sleeve_return")))


@query()
def sizing_trial(spark, sf_dir):
    x = ledger.realizations(_decided(spark, sf_dir), returns(spark, sf_dir), "key", "2002-01-01").where("stream = 'frozen'")
    t = autonomy.sizing_trial(autonomy.sized_returns(x, "key"), "key", 10)
    return t.select("key", *(r(c, c) for c in ("flat_dsr", "sized_dsr", "flat_sharpe", "sized_sharpe")), "met")


@query(f"""SELECT key, {sql_r('avg(m) * 12 * 0.0005', 'drag')}, {sql_r('avg(m)', 'turnover')} FROM (SELECT key, abs(frozen_position - coalesce(lag(frozen_position) OVER (PARTITION BY key ORDER BY month), 0)) AS m FROM ({POSITION_SQL})) GROUP BY 1""")
def execution_drag(spark, sf_dir):
    d = autonomy.execution_drag(_decided(spark, sf_dir), "key", "month", "frozen_position", 5)
    return d.select("key", r("drag", "drag"), r("turnover", "turnover"))
