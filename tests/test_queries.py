"""Every registered query of the library runs, and those with SQL equal DuckDB over the smallest data folder."""

from __future__ import annotations

import datetime
import math
import os

import pytest

from tidemark.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return "None"
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return str(value).replace(" 00:00:00", "")
    return str(value)


def shape(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    got = shape(df.columns, df.collect())
    if name in registry.oracle_sql():
        c = duck.execute(registry.oracle_sql()[name])
        assert got == shape([d[0] for d in c.description], c.fetchall())
    else:
        assert got[0] and got[1] and any(v != "None" for row in got[1] for v in row)
