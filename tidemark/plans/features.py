"""Queries of instrument returns and macro features; an order priority is a country, its monthly counts make the series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as operators
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


#: How each series follows from the month's number of orders n and the key's months k.
SERIES = {
    "selic_over": "10 + n % 7", "ptax": "4 + (n % 11) / 10.0", "fx_cupom_1m": "3 + n % 3", "di_3m": "10 + n % 5", "di_1y": "11 + n % 6", "di_2y": "11 + n % 4", "di_5y": "12 + n % 5", "di_10y": "13 + n % 3",
    "embi_spread": "200 + n % 90", "ntnb_5y": "5 + n % 2", "ust_2y": "2 + n % 3", "ust_10y": "3 + n % 2", "ipca_exp": "4 + n % 2", "ipca_yoy": "5 + n % 4", "us_cpi_exp": "2 + (n % 5) / 10.0", "reer": "90 + n % 31", "tot": "100 + n % 13",
    "bop_current": "n % 17 - 9", "ibc_br": "140 + n % 19", "us_breakeven_10y": "2 + (n % 7) / 10.0", "us_tips_10y": "1 + (n % 3) / 10.0", "primary_balance": "n % 9 - 4", "debt_gdp": "80 + n % 15", "vix": "15 + n % 23",
}
PANEL_SQL = f"SELECT key, month, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in SERIES.items())} FROM ({MONTHLY_SQL})"


def panel(spark, sf_dir):
    return monthly(spark, sf_dir).select("key", "month", *(F.expr(v.replace("10.0", "10.0D")).cast("double").alias(k) for k, v in SERIES.items()))


_W = "(PARTITION BY key ORDER BY month)"
_LAG = lambda c: f"lag({c}) OVER {_W}"
_RECEIVED = {
    name: f"-({y} - {_LAG(y)}) / 100 * {duration} + {_LAG(f'({y} - selic_over) / 1200')} + coalesce({_LAG(f'({y} - {s}) / 100')} * {roll} / 12, 0)" for name, (y, s, duration, roll) in operators.RECEIVERS.items()
}


@query(f"""SELECT key, month, {sql_r('power(1 + selic_over / 100, 1 / 12.0) - 1', 'ret_cash')}, {sql_r(f"ptax / {_LAG('ptax')} - 1 - {_LAG('fx_cupom_1m / 1200')}", 'ret_fx')}, {', '.join(sql_r(v, f'ret_{k}') for k, v in _RECEIVED.items())},
 {sql_r(f"-(embi_spread - {_LAG('embi_spread')}) / 10000 * 5 + {_LAG('embi_spread')} / 120000", 'ret_hard')}, {sql_r(f"-(ntnb_5y - {_LAG('ntnb_5y')}) / 100 * 4.5 + {_LAG('ntnb_5y')} / 1200", 'ret_ntnb')} FROM ({PANEL_SQL})""")
def instrument_returns(spark, sf_dir):
    x = operators.instrument_returns(panel(spark, sf_dir), "key", "month")
    return x.select("key", "month", *(r(c, c) for c in x.columns if c.startswith("ret_")))


RAW = {
    "carry_fx": "-(di_3m - ust_2y) / 1200", "carry_front": "(di_1y - selic_over) / 1200", "carry_hard": "embi_spread / 120000", "cip_basis": "(di_1y - ust_2y) / 100 - ((1 + di_1y / 100) / (1 + ust_2y / 100) - 1)", "real_diff": "di_1y - ipca_exp - (ust_2y - us_cpi_exp)",
    "reer_gap": "ln(reer) - CASE WHEN count(*) OVER w60 >= 36 THEN avg(ln(reer)) OVER w60 END", "term_premium": "di_10y - di_1y", "tp_5y": "di_5y - (selic_over + CASE WHEN count(*) OVER w24 >= 12 THEN avg(di_1y - selic_over) OVER w24 END)",
    "us_irp": "us_breakeven_10y - us_cpi_exp", "fiscal_premium": "di_10y - ust_10y - embi_spread / 100", "debt_accel": "debt_gdp - lag(debt_gdp, 12) OVER w",
}
_Z = lambda c: f"CASE WHEN count({c}) OVER w60 >= 30 THEN ({c} - avg({c}) OVER w60) / greatest(stddev_samp({c}) OVER w60, 0.5) END"
_WINDOWS = "WINDOW w AS (PARTITION BY key ORDER BY month), w60 AS (PARTITION BY key ORDER BY month ROWS 59 PRECEDING), w24 AS (PARTITION BY key ORDER BY month ROWS 23 PRECEDING)"


@query(f"""WITH f AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in RAW.items())} FROM ({PANEL_SQL}) {_WINDOWS})
 SELECT key, month, {', '.join(sql_r(k, k) for k in RAW)}, {', '.join(sql_r(_Z(k), f'Z_{k}') for k in ('real_diff', 'term_premium', 'fiscal_premium', 'vix'))}, {sql_r(f"({_Z('debt_gdp')} + {_Z('embi_spread')}) / 2", 'Z_fiscal')} FROM f {_WINDOWS}""")
def macro_features(spark, sf_dir):
    x = operators.features(panel(spark, sf_dir), "key", "month")
    return x.select("key", "month", *(r(c, c) for c in (*RAW, "Z_real_diff", "Z_term_premium", "Z_fiscal_premium", "Z_vix", "Z_fiscal")))


@query()
def exchange_misalignment(spark, sf_dir):
    x = operators.features(panel(spark, sf_dir), "key", "month")
    return x.select("key", "month", r("beer_misalignment", "beer_misalignment"), r("Z_beer", "Z_beer"))


@query(f"""WITH x AS (SELECT key, month, CASE WHEN month(month) % 5 = 0 THEN vix END AS a, CASE WHEN month(month) % 4 = 0 AND n % 2 = 0 THEN reer END AS b FROM ({PANEL_SQL}) JOIN (SELECT key AS k2, month AS m2, n FROM ({MONTHLY_SQL})) ON key = k2 AND month = m2),
 f AS (SELECT key, month, last_value(a IGNORE NULLS) OVER w AS a, last_value(b IGNORE NULLS) OVER w AS b FROM x WINDOW w AS (PARTITION BY key ORDER BY month ROWS 3 PRECEDING))
 SELECT key, arg_max(month, month) AS month, arg_max({{'v': a}}, month).v AS a, arg_max({{'v': b}}, month).v AS b FROM f WHERE (a IS NOT NULL OR b IS NOT NULL) AND month <= DATE '1996-05-31' GROUP BY 1""")
def features_at(spark, sf_dir):
    n = monthly(spark, sf_dir).select("key", "month", "n")
    x = panel(spark, sf_dir).join(n, ["key", "month"]).select("key", "month", F.when(F.month("month") % 5 == 0, F.col("vix")).alias("a"), F.when((F.month("month") % 4 == 0) & (F.col("n") % 2 == 0), F.col("reer")).alias("b"))
    return operators.features_at(operators.feature_matrix(x, "key", "month", ["a", "b"], 3), "key", "month", "1996-05-31")
