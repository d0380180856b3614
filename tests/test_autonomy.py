"""The operator's stream, sized against flat arms, pools scored once, and costs of turnover."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import autonomy, ledger


def ends(n, start=2020):
    return [d.date() for d in pd.date_range(f"{start}-01-31", periods=n, freq="ME")]


def test_operated_months_are_realized_beside_the_frozen_ones(spark):
    m = ends(5)
    decided = spark.createDataFrame([("s", x) for x in m[:4]], "key string, month date")
    operator = spark.createDataFrame([("s", m[0], 1.0), ("s", m[1], 0.5), ("s", m[3], -1.0), ("s", m[4], 1.0)], "key string, month date, operator_position double")
    returns = spark.createDataFrame([("s", m[0], 0.01), ("s", m[1], 0.02), ("s", m[3], 0.03), ("s", m[4], 0.04)], "key string, month date, ret double")
    got = {r.month: (r.held, r.previous, round(r.sleeve_return, 10)) for r in autonomy.operator_realizations(decided, operator, returns, "key", m[4], 10).collect()}
    assert got == {m[0]: (1.0, 0.0, 0.009), m[1]: (0.5, 1.0, 0.0095), m[3]: (-1.0, 0.0, -0.031)}  # no decision for the last, flat before the fourth
    assert autonomy.operator_realizations(decided, operator, returns, "key", m[0], 10, 1).count() == 0


def test_operator_decisions_are_not_repainted(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/l")
    d = spark.createDataFrame([("h", ends(1)[0], "override", 1.0, 0.5)], "strategy_hash string, month date, action string, proposed_position double, operator_position double")
    autonomy.decide(book, d)
    autonomy.decide(book, d)
    assert book.read("operator_decisions").count() == 1
    with pytest.raises(ledger.DataRevisionError):
        autonomy.decide(book, d.withColumn("operator_position", F.lit(0.6)))


def frozen(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    held, realized = rng.normal(size=n), rng.normal(size=n) * 0.02 + 0.01
    held[30] = 0.0
    rows = [("k", m, float(h), float(r), float(h * r - 0.0001)) for m, h, r in zip(ends(n), held, realized)]
    return held, realized, spark.createDataFrame(rows, "key string, month date, held double, realized double, sleeve_return double")


def test_sizing_looks_at_the_past_alone(spark):
    held, realized, df = frozen(spark)
    run = lambda d: autonomy.sized_returns(d, "key").orderBy("month").collect()
    got = run(df)
    error = np.abs(realized - np.array([np.nan, *(realized[:t].mean() for t in range(1, 60))]))
    width = np.full(60, np.nan)
    for t in range(60):
        past = np.sort(error[:t][np.isfinite(error[:t])])
        m = len(past)
        if m >= 12:
            width[t] = np.quantile(past, min(1.0, np.ceil((m + 1) * 0.9 - 1e-12) / m), method="higher")
    conf = np.array([np.nan if np.isfinite(width[: t + 1]).sum() < 12 else min(np.nanmedian(width[: t + 1]) / width[t], 1.0) for t in range(60)])
    for t, r in enumerate(got):
        assert (r.confidence is None) == np.isnan(conf[t]) and (r.confidence is None or r.confidence == pytest.approx(conf[t]))
        if r.confidence is None:
            assert r.sized == pytest.approx(0.0 if held[t] == 0 else r.flat)
        else:
            assert 0.25 * abs(held[t] * realized[t]) - 1e-12 <= abs(r.sized) <= abs(held[t] * realized[t]) + 1e-12
    assert [(r.sized, r.confidence) for r in run(df.where(F.col("month") <= F.lit(ends(60)[39])))] == [(r.sized, r.confidence) for r in got[:40]]
    t = autonomy.sizing_trial(autonomy.sized_returns(df, "key"), "key", 5).collect()
    assert len(t) == 1 and t[0].met in (True, False)


def test_pools_are_scored_once_over_shared_months(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/l")
    members = [{"kind": "a"}, {"kind": "b"}]
    assert autonomy.pool_spec(members) == autonomy.pool_spec(members[::-1])
    rng = np.random.default_rng(3)
    for k, spec in enumerate(members):
        months = ends(40)[k : 39 + k]  # 38 in common
        rows = [(ledger.strategy_hash(spec), m, s, float(rng.normal(0.02, 0.01))) for m in months for s in ("frozen", "live")]
        book.append("realizations", spark.createDataFrame(rows, "strategy_hash string, month date, stream string, sleeve_return double"))
    with pytest.raises(PermissionError, match="no deflation basis"):
        autonomy.pool_verdict(book, members)
    book.book(autonomy.pool_spec(members), 3, 0.1, 38)
    first = autonomy.pool_verdict(book, members)
    assert first["n"] == 38 and first["passed"] and first == autonomy.pool_verdict(book, members[::-1])
    other = [*members, {"kind": "absent"}]
    book.book(autonomy.pool_spec(other), 3, 0.1, 38)
    with pytest.raises(PermissionError, match="0 months, 38 agreed"):
        autonomy.pool_verdict(book, other)
    flat = ledger.Ledger(spark, f"file://{tmp_path}/flat")
    flat.append("realizations", spark.createDataFrame([(ledger.strategy_hash(members[0]), m, "frozen", 0.01) for m in ends(30)], "strategy_hash string, month date, stream string, sleeve_return double"))
    flat.book(autonomy.pool_spec(members[:1]), 1, 0.1, 30)
    assert not autonomy.pool_verdict(flat, members[:1])["passed"]  # too even to be a sample


def test_turnover_costs_from_flat(spark):
    df = spark.createDataFrame([("k", 1, 1.0), ("k", 2, 0.5), ("k", 3, 0.5)], "key string, t int, w double")
    r = autonomy.execution_drag(df, "key", "t", "w", 10).collect()[0]
    assert r.turnover == pytest.approx(0.5) and r.drag == pytest.approx(0.5 * 12 * 0.001)
