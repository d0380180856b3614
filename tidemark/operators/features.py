"""Instrument returns and macro features of a wide monthly panel: window expressions over each key's months.

The panel has a row for each (key, month) without gaps and a column for each
series; every function makes the columns whose inputs the panel has, for all keys at once, from the
present and earlier rows alone. A row that lacks an input lacks the column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series
from . import models

# Of each receiver its yield, the shorter yield it rolls towards, duration in years, and the share of the slope it rolls in a year.
RECEIVERS = {"front": ("di_1y", "di_3m", 1.0, 9 / 12), "belly": ("di_5y", "di_2y", 4.5, 3 / 5), "long": ("di_10y", "di_5y", 7.5, 5 / 10)}
SPREAD_DURATION, REAL_DURATION = 5.0, 4.5
CORE = ("fx", "front", "belly", "long")
#: Rows of a z-score's window, the least that it takes, and the floor of its deviation.
WINDOW, LEAST, FLOOR = 60, 30, 0.5


def _first(df: DataFrame, *names: str) -> Column | None:
    """The first of the columns that the panel has, as known numbers."""
    name = next((n for n in names if n in df.columns), None)
    return None if name is None else series.known(F.col(name).cast("double"))


def _monthly(percent: Column) -> Column:
    return percent / 100 / 12


def instrument_returns(df: DataFrame, key: str, at: str) -> DataFrame:
    """``df`` with ret_cash, ret_fx, ret_front, ret_belly, ret_long, ret_hard, ret_ntnb, as far as their series are there; a gain of the position is positive."""
    w = Window.partitionBy(key).orderBy(at)
    before = lambda c, k=1: F.lag(c, k).over(w)
    made: dict[str, Column] = {}
    cash = _first(df, "selic_over", "selic_target")
    if cash is not None:
        made["cash"] = F.pow(1 + cash / 100, F.lit(1 / 12)) - 1
    spot, cupom = _first(df, "ptax", "spot"), _first(df, "fx_cupom_1m")
    home, abroad = _first(df, "di_3m", "di_1y"), _first(df, "ust_2y")
    if spot is not None:
        held = cupom if cupom is not None else home - abroad if home is not None and abroad is not None else None
        made["fx"] = spot / F.nullif(before(spot), F.lit(0.0)) - 1 - (before(_monthly(held)) if held is not None else 0.0)
    for name, (own, shorter, duration, roll) in RECEIVERS.items():
        y, s = _first(df, own), _first(df, shorter, *(("di_1y",) if name == "belly" else ()))
        if y is None:
            continue
        carry = before(F.coalesce(_monthly(y - cash), F.lit(0.0))) if cash is not None else F.when(before(y).isNotNull(), 0.0)
        slope = F.coalesce(before((y - s) / 100) * roll / 12, F.lit(0.0)) if s is not None else F.lit(0.0)
        made[name] = -(y - before(y)) / 100 * duration + carry + slope
    embi, real = _first(df, "embi_spread"), _first(df, "tesouro_ntnb_5y", "ntnb_5y")
    if embi is not None:
        made["hard"] = -(embi - before(embi)) / 10000 * SPREAD_DURATION + before(embi) / 10000 / 12
    if real is not None:
        made["ntnb"] = -(real - before(real)) / 100 * REAL_DURATION + before(_monthly(real))
    return df.withColumns({f"ret_{n}": v for n, v in made.items()})


def aligned_returns(df: DataFrame, key: str, at: str) -> DataFrame:
    """(key, at, returns): the months in which every core instrument that the panel has is known; of the others the unknown ones count as 0."""
    have = [c for c in df.columns if c.startswith("ret_") and c != "ret_cash"]
    core = [c for c in have if c.removeprefix("ret_") in CORE] or have
    rest = [c for c in have if c not in core]
    return df.dropna(subset=core).select(key, at, *core, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in rest))


def features(df: DataFrame, key: str, at: str, beer: tuple[str, ...] = ("tot", "bop_12m", "log_ibc")) -> DataFrame:
    """``df`` with carries, parity basis, real exchange rate gap and misalignment, term, inflation and fiscal premia, and their z-scores (Z_name), as far as their series are there."""
    w = Window.partitionBy(key).orderBy(at)
    get = lambda *names: _first(df, *names)
    made: dict[str, Column] = {}

    def put(name: str, made_of: tuple, value) -> None:
        if all(c is not None for c in made_of):
            made[name] = value(*made_of)

    cash, home, abroad, embi = get("selic_over", "selic_target"), get("di_3m", "di_1y"), get("ust_2y"), get("embi_spread")
    credit, real = get("cds_5y", "embi_spread"), get("tesouro_ntnb_5y", "ntnb_5y")
    put("carry_fx", (home, abroad), lambda a, b: -_monthly(a - b))
    for name, (own, *_) in RECEIVERS.items():
        put(f"carry_{name}", (get(own), cash), lambda y, c: _monthly(y - c))
    put("carry_hard", (embi,), lambda e: e / 10000 / 12)
    put("carry_ntnb", (real,), _monthly)
    put("cip_basis", (get("di_swap_360d", "di_1y"), abroad), lambda a, b: (a - b) / 100 - ((1 + a / 100) / (1 + b / 100) - 1))
    put("real_diff", (get("di_1y"), get("ipca_exp"), abroad, get("us_cpi_exp")), lambda a, b, c, d: (a - b) - (c - d))
    put("infl_surprise", (get("ipca_yoy"), get("ipca_exp")), lambda a, b: a - b)
    put("reer_gap", (get("reer"),), lambda x: F.log(F.when(x > 0, x)) - series.rolling(F.avg, F.log(F.when(x > 0, x)), w, 60, 36))
    put("term_premium", (get("di_10y"), get("di_1y")), lambda a, b: a - b)
    put("tp_5y", (get("di_5y"), get("di_1y"), cash), lambda a, b, c: a - (c + series.rolling(F.avg, b - c, w, 24, 12)))
    put("us_irp", (get("us_breakeven_10y"), get("us_cpi_exp")), lambda a, b: a - b)
    put("us_real_yield", (get("us_tips_10y"),), lambda a: a)
    put("us_breakeven", (get("us_breakeven_10y"),), lambda a: a)
    put("fiscal_premium", (get("di_10y"), get("ust_10y"), credit), lambda a, b, c: a - b - c / 100)
    put("pb_momentum", (get("primary_balance"),), lambda a: a - F.lag(a, 12).over(w))
    put("debt_accel", (get("debt_gdp"),), lambda a: a - F.lag(a, 12).over(w))
    for name, source in (("dxy", "dxy"), ("vix", "vix"), ("cds_br", "cds_5y"), ("tot", "tot"), ("hy_spread", "us_hy_spread"), ("bop", "bop_current")):
        put(f"raw_{name}", (get(source),), lambda a: a)
    for name in ("ewz", "iron_ore"):
        put(f"raw_{name}", (get(name),), lambda a: a / F.nullif(F.lag(a).over(w), F.lit(0.0)) - 1)
    out = df.withColumns(made)
    scored = [n for n in made if not n.startswith("carry_")]
    out = out.withColumns({f"Z_{n.removeprefix('raw_')}": series.zscore(n, w, WINDOW, LEAST, FLOOR) for n in scored})
    out = out.drop(*(n for n in made if n.startswith("raw_")))
    debt = get("debt_gdp")
    if debt is not None and credit is not None:
        out = out.withColumn("Z_fiscal", (series.zscore(debt, w, WINDOW, LEAST, FLOOR) + series.zscore(credit, w, WINDOW, LEAST, FLOOR)) / 2)
    return _misalignment(out, key, at, beer) if get("reer") is not None else out


def _misalignment(df: DataFrame, key: str, at: str, fundamentals: tuple[str, ...]) -> DataFrame:
    """The log real exchange rate beyond a regression on its fundamentals over the 60 rows before; needs two of them."""
    w = Window.partitionBy(key).orderBy(at)
    reer, bop, ibc = (_first(df, n) for n in ("reer", "bop_current", "ibc_br"))
    made = {"_log_reer": F.log(F.when(reer > 0, reer))}
    if bop is not None:
        made["_bop_12m"] = series.rolling(F.sum, bop, w, 12, 6)
    if ibc is not None:
        made["_log_ibc"] = F.log(F.greatest(ibc, F.lit(1.0)))
    if "tot" in df.columns:
        made["_tot"] = series.known(F.col("tot").cast("double"))
    if "Z_real_diff" in df.columns:
        made["_real_diff"] = F.col("Z_real_diff")
    used = [f"_{n}" for n in (*fundamentals, "real_diff") if f"_{n}" in made]
    if len(used) < 2:
        return df
    whole = df.withColumns(made)
    # complete rows only, so that 60 rows are 60 observations
    fitted = models.rolling_regression(whole.select(key, at, "_log_reer", *used).dropna(), key, at, used, "_log_reer", 60, name="_beer", least=60)
    gap = fitted.select(key, at, series.known("_beer_residual").alias("beer_misalignment"))
    return df.join(gap, [key, at], "left").withColumn("Z_beer", series.zscore("beer_misalignment", w, WINDOW, LEAST, FLOOR))


def feature_matrix(df: DataFrame, key: str, at: str, names: list[str], limit: int = 12) -> DataFrame:
    """(key, at, names) with each feature carried forward at most ``limit`` rows, without the rows that know none of them."""
    w = Window.partitionBy(key).orderBy(at)
    carried = df.select(key, at, *(series.bounded_ffill(F.col(n), w, limit).alias(n) for n in names))
    return carried.dropna("all", subset=names)


def features_at(matrix: DataFrame, key: str, at: str, date) -> DataFrame:
    """The last row of each key at or before a date."""
    rest = [c for c in matrix.columns if c != key]
    known = matrix.where(F.col(at) <= F.lit(date))
    return known.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("_r")).select(key, "_r.*")
