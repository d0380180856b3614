"""Series contracts: where a series comes from, when it can be known and which values it may take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "series_id string, source string, source_code string, frequency string, unit string, publication_lag_days int, valid_min double, valid_max double, monotonic boolean, allowed_revision_abs double, license string, description string"

# Series, source, code, frequency, unit, lag in days, least and largest value, allowed revision.
CONTRACTS = [
    ("SELIC_TARGET", "BCB_SGS", "432", "D", "pct_aa", 1, 0.0, 100.0, None),
    ("CDI", "BCB_SGS", "12", "D", "pct_day", 1, 0.0, 5.0, None),
    ("USDBRL_PTAX", "BCB_SGS", "1", "D", "BRL", 1, 0.5, 15.0, None),
    ("IPCA_MOM", "BCB_SGS", "433", "M", "pct", 10, -2.0, 10.0, 0.5),
    ("DIVIDA_BRUTA_PIB", "BCB_SGS", "13762", "M", "pct_gdp", 30, 0.0, 200.0, 2.0),
    ("FOCUS_IPCA_12M", "BCB_FOCUS", "IPCA", "D", "pct", 1, 0.0, 30.0, None),
    ("UST10Y", "FRED", "DGS10", "D", "pct", 1, -2.0, 25.0, None),
    ("UST2Y", "FRED", "DGS2", "D", "pct", 1, -2.0, 25.0, None),
    ("US_CPI", "FRED", "CPIAUCSL", "M", "index", 14, 0.0, None, None),
    ("NTNB_REAL_5Y", "TESOURO_TD", "Tesouro IPCA+", "M", "pct", 1, -5.0, 20.0, None),
    ("NTNB_REAL_10Y", "TESOURO_TD", "Tesouro IPCA+", "M", "pct", 1, -5.0, 20.0, None),
    ("CFTC_BRL_NET_SPEC", "CFTC_COT", "102741", "W", "contracts", 3, -200000.0, 200000.0, None),
    ("IDP_FLOW", "BCB_SGS", "22885", "M", "usd_mn", 30, -50000.0, 50000.0, 5000.0),
    ("PORTFOLIO_FLOW", "BCB_SGS", "22924", "M", "usd_mn", 30, -50000.0, 50000.0, 5000.0),
]

# Publication lags in days of file-backed series; any other has one day.
FILE_LAGS = {
    "IPCA_MONTHLY": 10,
    "IPCA_12M": 10,
    "DIVIDA_BRUTA_PIB": 30,
    "PRIMARY_BALANCE": 30,
    "BOP_CURRENT": 30,
    "TERMS_OF_TRADE": 30,
    "IBC_BR": 45,
    "REER_BIS": 35,
    "REER_BCB": 35,
    "PPP_FACTOR": 365,
    "GDP_PER_CAPITA": 365,
    "CURRENT_ACCOUNT": 365,
    "TRADE_OPENNESS": 365,
}


def contracts(spark: SparkSession) -> DataFrame:
    rows = [(*c[:8], False, c[8], None, None) for c in CONTRACTS]
    return spark.createDataFrame(rows, SCHEMA)


def contract(spark: SparkSession, series_id: str) -> DataFrame:
    """The contract of one series; KeyError if there is none."""
    if series_id not in {c[0] for c in CONTRACTS}:
        raise KeyError(series_id)
    return contracts(spark).where(F.col("series_id") == series_id)


def by_source(spark: SparkSession, source: str) -> DataFrame:
    return contracts(spark).where(F.col("source") == source)


def file_lag(series_id):
    """Publication lag in days of a file-backed series column."""
    known = F.create_map(*(F.lit(x) for item in FILE_LAGS.items() for x in item))
    return F.coalesce(F.element_at(known, series_id), F.lit(1))


def file_contract(series_id: str) -> tuple:
    """A contract made up for a series that only a file has."""
    lag = FILE_LAGS.get(series_id, 1)
    return (series_id, "CSV_BRIDGE", None, "A" if lag == 365 else "M" if lag > 1 else "D", "native", lag, None, None, False, None, None, None)
