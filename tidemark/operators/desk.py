"""Desk analytics over books of positions: sizing, VaR, stress, exposure, rebalancing and marks.

A table of positions has one row for each (book, instrument); every function
works on any number of books at once. The market is one row for each book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Contract type, duration in years, contract size, unit and margin of each instrument.
INSTRUMENTS = [
    ("fx", "WDO", 0.0, 10000.0, "USD", 0.15),
    ("front", "DI1", 0.95, 100000.0, "BRL_PU", 0.02),
    ("belly", "DI1", 4.2, 100000.0, "BRL_PU", 0.02),
    ("long", "DI1", 7.5, 100000.0, "BRL_PU", 0.02),
    ("hard", "DDI", 4.5, 50000.0, "USD", 0.04),
    ("ntnb", "NTNB", 4.5, 1000.0, "BRL", 0.10),
]
# Correlations between fx, front, belly, long, hard and ntnb, and annual volatilities.
NAMES = ("fx", "front", "belly", "long", "hard", "ntnb")
CORRELATIONS = [
    (1.00, -0.45, -0.50, -0.55, -0.30, -0.40),
    (-0.45, 1.00, 0.92, 0.85, 0.40, 0.75),
    (-0.50, 0.92, 1.00, 0.95, 0.45, 0.85),
    (-0.55, 0.85, 0.95, 1.00, 0.50, 0.88),
    (-0.30, 0.40, 0.45, 0.50, 1.00, 0.35),
    (-0.40, 0.75, 0.85, 0.88, 0.35, 1.00),
]
VOLATILITIES = {"fx": 0.15, "front": 0.08, "belly": 0.12, "long": 0.18, "hard": 0.10, "ntnb": 0.14}
Z95, Z99 = 1.645, 2.326
# Shocks of the stress scenarios by instrument, in the order of NAMES.
SCENARIOS = {
    "2008 Lehman Crisis": (-0.30, 0.03, 0.03, 0.03, -0.04, 0.025),
    "2013 Taper Tantrum": (-0.15, 0.015, 0.015, 0.015, -0.01, 0.012),
    "2015 Dilma Crisis": (-0.25, 0.04, 0.04, 0.04, -0.02, 0.035),
    "2020 COVID Crash": (-0.20, -0.02, 0.005, 0.01, -0.03, 0.008),
    "2022 Lula Election": (-0.10, 0.02, 0.02, 0.02, -0.01, 0.015),
    "Bull Scenario: EM Rally": (0.15, -0.02, -0.02, -0.02, 0.01, -0.015),
}
# Costs in basis points by contract type; any other costs 3.
COSTS_BPS = {"DOL": 2.0, "WDO": 3.0, "DI1": 1.5, "FRA": 2.0, "DDI": 3.0, "NTNB": 5.0}
# Largest exposure in percent of assets by factor.
FACTOR_LIMITS = {"fx": 30.0, "rates": 100.0, "credit": 50.0}
MONTH_CODES = "FGHJKMNQUVXZ"


def instruments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INSTRUMENTS, "instrument string, contract_type string, duration double, contract_size double, contract_unit string, margin_pct double")


def direction_sign(direction: Column | str) -> Column:
    d = F.col(direction) if isinstance(direction, str) else direction
    return F.when(d == "long", 1).when(d == "short", -1).otherwise(0)


def ticker(kind: Column, year: Column, month: Column) -> Column:
    return F.concat(kind, F.substring(F.lit(MONTH_CODES), 1, 12).substr(month, F.lit(1)), F.lpad((year % 100).cast("string"), 2, "0"))


def nearest_fx_ticker(kind: str, at: Column) -> Column:
    after = F.add_months(F.trunc(at, "MM"), 1)
    return ticker(F.lit(kind), F.year(after), F.month(after))


def nearest_di_ticker(tenor_years: int, at: Column) -> Column:
    """The contract of January, April, July or October whose month is nearest; an earlier month more than one away is next year's."""
    month, year = F.month(at), F.year(at) + tenor_years
    best = F.array_min(F.array(*(F.struct(F.abs(F.lit(m) - month).alias("d"), F.lit(m).alias("m")) for m in (1, 4, 7, 10))))
    return ticker(F.lit("DI1"), year + ((best["m"] < month) & (best["d"] > 1)).cast("int"), best["m"])


def risk_budget(weights: DataFrame) -> DataFrame:
    """(book, instrument, weight, expected, aum, vol_target) with direction, risk_brl, risk_pct, expected_annual, sharpe_part."""
    w, total = F.col("weight"), F.sum(F.abs("weight")).over(Window.partitionBy("book"))
    return weights.select(
        "*",
        F.when(w > 0.001, "long").when(w < -0.001, "short").otherwise("flat").alias("direction"),
        (F.abs(w) * F.col("aum") * F.col("vol_target")).alias("risk_brl"),
        F.when(total > 0, F.abs(w) / total * 100).otherwise(0.0).alias("risk_pct"),
        (F.coalesce("expected", F.lit(0.0)) * 12).alias("expected_annual"),
        (w * F.coalesce("expected", F.lit(0.0))).alias("sharpe_part"),
    )


def size_contracts(budget: DataFrame, market: DataFrame) -> DataFrame:
    """Positions in contracts: ``budget`` by instrument rules under ``market`` (book, spot, vol30d, di1y, di5y, di10y, embi). Unknown instruments are dropped."""
    p = budget.join(market, "book").join(F.broadcast(instruments(budget.sparkSession)), "instrument")  # six instruments
    kind, risk, dur, size, spot = (F.col(c) for c in ("instrument", "risk_brl", "duration", "contract_size", "spot"))
    vol = F.col("vol30d") / 100
    rate = F.when(kind == "front", F.col("di1y")).when(kind == "belly", F.col("di5y")).when(kind == "long", F.col("di10y")) / 100
    real = F.greatest((F.col("di5y") - 4.5) / 100, F.lit(0.03))
    rates, hard, ntnb, fx = kind.isin("front", "belly", "long"), kind == "hard", kind == "ntnb", kind == "fx"
    p = p.withColumn("pu", F.when(rates, 100000 / F.pow(1 + rate, dur)).when(ntnb, size / F.pow(1 + real, dur)))
    p = p.withColumn("dv01_brl", F.when(rates, risk / (rate * dur * 10000)).when(ntnb, risk / (real * dur * 10000)))
    p = p.withColumn("spread_dv01_usd", F.when(hard, risk / (spot * F.when(F.col("embi") > 0, F.col("embi")).otherwise(200.0))))
    fx_notional = risk / F.when(vol > 0, vol).otherwise(0.15)
    raw = F.when(fx, fx_notional / spot / size).when(rates | ntnb, F.col("dv01_brl") / (F.col("pu") * dur / 10000))
    raw = raw.when(hard, F.least(F.col("spread_dv01_usd") / (size * dur / 10000), F.col("aum") * 2 / (size * spot)))
    p = p.withColumn("contracts_exact", raw)
    n = F.floor(F.col("contracts_exact") + 0.5)
    notional = F.when(fx, fx_notional).when(rates | ntnb, F.col("contracts_exact") * F.col("pu")).when(hard, F.col("contracts_exact") * size * spot)
    entry = F.when(fx, spot).when(rates, rate * 100).when(hard, F.col("embi")).when(ntnb, F.col("di5y") - 4.5)
    return p.select(
        "book", "instrument", "contract_type", "direction", "weight", "aum", "risk_brl", "contract_size", "contract_unit", "contracts_exact",
        n.cast("long").alias("contracts"),
        notional.alias("notional_brl"),
        F.when(fx | hard, notional / spot).otherwise(0.0).alias("notional_usd"),
        "dv01_brl",
        F.when(fx, notional * F.when(F.col("weight") > 0, -1).otherwise(1)).alias("fx_delta_brl"),
        "spread_dv01_usd",
        (n * size * F.when(F.col("contract_unit") == "USD", spot).otherwise(1.0) * F.col("margin_pct")).alias("margin_brl"),
        entry.alias("entry_price"),
    )


def correlations(spark: SparkSession) -> DataFrame:
    rows = [(a, b, CORRELATIONS[i][j]) for i, a in enumerate(NAMES) for j, b in enumerate(NAMES)]
    return spark.createDataFrame(rows, "i string, j string, rho double")


def _exposures(positions: DataFrame, market: DataFrame) -> DataFrame:
    vol = F.element_at(F.create_map(*(F.lit(x) for item in VOLATILITIES.items() for x in item)), F.col("instrument"))
    rows = positions.join(market.select("book", "vol30d"), "book").where(F.col("instrument").isin(*NAMES))
    annual = F.when(F.col("instrument") == "fx", F.col("vol30d") / 100).otherwise(vol)
    return rows.select("book", "instrument", (F.abs(direction_sign("direction")) * F.col("risk_brl") * annual / 252**0.5).alias("v"))


def value_at_risk(positions: DataFrame, market: DataFrame) -> DataFrame:
    """(book, sigma, var95, var99, month95, month99): undirected exposures under the fixed correlations."""
    e = _exposures(positions, market)
    both = e.select("book", F.col("instrument").alias("i"), F.col("v").alias("vi")).join(e.select("book", F.col("instrument").alias("j"), F.col("v").alias("vj")), "book")  # six by six a book
    v = both.join(F.broadcast(correlations(e.sparkSession)), ["i", "j"]).groupBy("book").agg(F.sqrt(F.greatest(F.sum(F.col("vi") * F.col("vj") * F.col("rho")), F.lit(0.0))).alias("sigma"))
    return v.select("book", "sigma", *((F.col("sigma") * z * m).alias(n) for n, z, m in (("var95", Z95, 1), ("var99", Z99, 1), ("month95", Z95, 21**0.5), ("month99", Z99, 21**0.5))))


def component_value_at_risk(positions: DataFrame, market: DataFrame) -> DataFrame:
    """(book, instrument, marginal, contribution, share_pct) of the 95 % VaR."""
    e = _exposures(positions, market)
    both = e.select("book", F.col("instrument").alias("i"), F.col("v").alias("vi")).join(e.select("book", F.col("instrument").alias("j"), F.col("v").alias("vj")), "book")
    m = both.join(F.broadcast(correlations(e.sparkSession)), ["i", "j"]).groupBy("book", "i").agg(F.first("vi").alias("vi"), F.sum(F.col("vj") * F.col("rho")).alias("m"))
    sigma = F.sqrt(F.greatest(F.sum(F.col("vi") * F.col("m")).over(Window.partitionBy("book")), F.lit(0.0)))
    m = m.withColumn("_s", sigma)
    return m.select("book", F.col("i").alias("instrument"), F.when(F.col("_s") > 0, F.col("m") / F.col("_s") * Z95).otherwise(0.0).alias("marginal"), F.when(F.col("_s") > 0, F.abs(F.col("vi") * F.col("m") / F.col("_s") * Z95)).otherwise(0.0).alias("contribution"), F.when(F.col("_s") > 0, F.abs(F.col("vi") * F.col("m")) / (F.col("_s") * F.col("_s")) * 100).otherwise(0.0).alias("share_pct"))


def stress(positions: DataFrame) -> DataFrame:
    """(book, scenario, pnl_brl, pnl_pct) of every fixed scenario: six rows meet each position."""
    spark = positions.sparkSession
    shocks = spark.createDataFrame([(s, n, x) for s, row in SCENARIOS.items() for n, x in zip(NAMES, row)], "scenario string, instrument string, shock double")
    rows = positions.join(F.broadcast(shocks), "instrument")
    unit = F.when(F.col("instrument") == "fx", F.col("notional_brl") * F.col("shock")).when(F.col("instrument") == "hard", F.coalesce("spread_dv01_usd", F.lit(0.0)) * F.col("shock") * 10000).otherwise(F.coalesce("dv01_brl", F.lit(0.0)) * F.col("shock") * 10000)
    g = rows.groupBy("book", "scenario").agg(F.sum(-unit * direction_sign("direction")).alias("pnl_brl"), F.first("aum").alias("aum"))
    return g.select("book", "scenario", "pnl_brl", F.when(F.col("aum") > 0, F.col("pnl_brl") / F.col("aum") * 100).otherwise(0.0).alias("pnl_pct"))


def exposure(positions: DataFrame) -> DataFrame:
    """(book, gross, net, leverages, dv01, margin, largest_pct, herfindahl)."""
    sign = direction_sign("direction")
    total = F.sum("risk_brl").over(Window.partitionBy("book"))
    rows = positions.withColumn("_share", F.when(total > 0, F.col("risk_brl") / total).otherwise(0.0))
    g = rows.groupBy("book").agg(
        F.first("aum").alias("aum"), F.sum("notional_brl").alias("gross_brl"), F.sum(F.col("notional_brl") * sign).alias("net_brl"), F.sum(F.coalesce("fx_delta_brl", F.lit(0.0))).alias("fx_delta_brl"),
        F.sum(F.coalesce("dv01_brl", F.lit(0.0)) * sign).alias("dv01_brl"), F.sum(F.coalesce("spread_dv01_usd", F.lit(0.0)) * sign).alias("spread_dv01_usd"), F.sum("margin_brl").alias("margin_brl"),
        (F.max("_share") * 100).alias("largest_pct"), F.sum(F.col("_share") * F.col("_share")).alias("herfindahl"),
    )
    return g.withColumn("gross_leverage", F.col("gross_brl") / F.col("aum")).withColumn("net_leverage", F.col("net_brl") / F.col("aum")).withColumn("margin_pct", F.col("margin_brl") / F.col("aum") * 100)


def rebalance(current: DataFrame, target: DataFrame) -> DataFrame:
    """(book, instrument, action, delta, notional_brl, cost_brl, current, target): a row for each target position."""
    signed = lambda d, n: F.when(F.col(d) == "short", -F.col(n)).otherwise(F.col(n))
    c = current.select("book", "instrument", signed("direction", "contracts").alias("current"))
    t = target.join(c, ["book", "instrument"], "left").withColumn("current", F.coalesce("current", F.lit(0))).withColumn("target", signed("direction", "contracts"))
    delta = F.col("target") - F.col("current")
    bps = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for item in COSTS_BPS.items() for x in item)), F.col("contract_type")), F.lit(3.0))
    price = F.when(F.col("contract_unit") == "USD", F.coalesce(F.nullif("entry_price", F.lit(0.0)), F.lit(5.0))).otherwise(1.0)
    notional = F.abs(delta) * F.col("contract_size") * price
    action = F.when(delta > 0, "BUY").when(delta < 0, "SELL").otherwise("HOLD")
    return t.select("book", "instrument", action.alias("action"), delta.alias("delta"), notional.alias("notional_brl"), (notional * bps / 10000).alias("cost_brl"), F.abs("current").alias("current"), F.abs("target").alias("target"))


def mark_to_market(positions: DataFrame, prices: DataFrame, keep_ntnb_quirk: bool = True) -> DataFrame:
    """Positions with current_price and pnl_brl under ``prices`` (book, spot, di1y, di5y, di10y, embi). By default ntnb is not marked, as desks expect of this report."""
    p = positions.join(prices, "book")
    kind, sign = F.col("instrument"), direction_sign("direction")
    now = F.when(kind == "fx", F.col("spot")).when(kind == "front", F.col("di1y")).when(kind == "belly", F.col("di5y")).when(kind == "long", F.col("di10y")).when(kind == "hard", F.col("embi"))
    now = (now if keep_ntnb_quirk else now.when(kind == "ntnb", F.col("di5y") - 4.5)).otherwise(F.col("entry_price"))
    move = now - F.col("entry_price")
    units = F.coalesce(F.nullif("notional_usd", F.lit(0.0)), F.col("notional_brl") / F.col("spot"))
    pnl = F.when(kind == "fx", units * move * sign).when(kind == "hard", -F.coalesce("spread_dv01_usd", F.lit(0.0)) * move * sign * F.col("spot")).otherwise(-F.coalesce("dv01_brl", F.lit(0.0)) * move * 100 * sign)
    return p.select(*positions.columns, now.alias("current_price"), pnl.alias("pnl_brl"))


def slippage(instrument: Column, target: Column, executed: Column, contracts: Column, spot: Column) -> tuple[Column, Column]:
    """Slippage in basis points and in BRL, to two digits; zero where a price is zero."""
    gap = F.abs(executed - target)
    rates = instrument.isin("front", "belly", "long")
    bps = F.when(instrument == "fx", gap / target * 10000).when(rates, gap * 100).when(instrument == "hard", gap).otherwise(0.0)
    brl = F.when(instrument == "fx", gap * contracts * 10000).when(rates, gap * (100000 / (1 + target / 100) * 0.01) * contracts).when(instrument == "hard", gap * 50 * contracts * spot / 10000).otherwise(0.0)
    none = (target == 0) | (executed == 0)
    cents = lambda v: F.when(none, 0.0).otherwise(F.floor(v * 100 + 0.5) / 100)
    return cents(bps), cents(brl)


def factor_exposure(positions: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """(book, factor, exposure_brl, exposure_pct, risk_pct, utilization_pct, breached) for every factor of every book."""
    spark = positions.sparkSession
    kind = F.col("instrument")
    factor = F.when(kind == "fx", "fx").when(kind.isin("front", "belly", "long"), "rates").when(kind == "hard", "credit")
    risk = F.when(kind == "fx", F.abs(F.coalesce("fx_delta_brl", F.lit(0.0)))).when(kind == "hard", F.abs(F.coalesce("spread_dv01_usd", F.lit(0.0))) * 50).otherwise(F.abs(F.coalesce("dv01_brl", F.lit(0.0))) * 100)
    rows = positions.withColumn("factor", factor).where("factor is not null").withColumn("_r", risk).groupBy("book", "factor").agg(F.sum(F.abs("notional_brl")).alias("exposure_brl"), F.sum("_r").alias("_r"))
    dim = spark.createDataFrame(list((limits or FACTOR_LIMITS).items()), "factor string, limit_pct double")
    books = positions.groupBy("book").agg(F.first("aum").alias("aum"))
    every = books.crossJoin(F.broadcast(dim)).join(rows, ["book", "factor"], "left").na.fill(0.0, ["exposure_brl", "_r"])  # three factors
    total = F.sum("_r").over(Window.partitionBy("book"))
    pct = F.when(F.col("aum") > 0, F.col("exposure_brl") / F.col("aum") * 100).otherwise(0.0)
    return every.select("book", "factor", "exposure_brl", pct.alias("exposure_pct"), (F.col("_r") / F.when(total > 0, total).otherwise(1.0) * 100).alias("risk_pct"), (pct / F.col("limit_pct") * 100).alias("utilization_pct"), (pct > F.col("limit_pct")).alias("breached"))
