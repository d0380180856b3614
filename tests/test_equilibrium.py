"""Aligned series, curve and composite rates, and mean-variance books."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.operators import equilibrium, optimizer


def test_alignment_of_many_series(spark):
    make = lambda rows: spark.createDataFrame(rows, "k string, t int, v double")
    a, b = make([("x", t, float(t)) for t in range(6)] + [("y", 1, 1.0)]), make([("x", t, None if t == 3 else -float(t)) for t in range(2, 9)] + [("y", 1, 2.0)])
    empty = make([])
    got = equilibrium.aligned({"a": a, "b": b, "c": empty}, "k", "t", "v", 3, 0.0).orderBy("t").collect()
    assert [(r.k, r.t, r.a, r.b, r.c) for r in got] == [("x", 2, 2.0, -2.0, 0.0), ("x", 3, 3.0, None, 0.0), ("x", 4, 4.0, -4.0, 0.0), ("x", 5, 5.0, -5.0, 0.0)]
    assert equilibrium.aligned({"a": a, "b": b}, "k", "t", "v", 5).count() == 0
    assert equilibrium.aligned({"a": a, "c": empty}, "k", "t", "v", 1).count() == 0  # one series is none


def curve(rows=90, seed=3):
    rng = np.random.default_rng(seed)
    level = np.zeros(rows)
    for t in range(1, rows):
        level[t] = 0.9 * level[t - 1] + rng.normal() * 0.4
    return 10 + level[:, None] * [1, 0.95, 0.9, 0.7] + rng.normal(size=(rows, 4)) * 0.1


def test_curve_rate_is_that_of_each_window_and_causal(spark):
    x = curve()
    rows = [("a", t, *map(float, x[t])) for t in range(len(x))]
    rows[50] = ("a", 50, None, *rows[50][3:])  # carried forward
    schema = "key string, t int, y1 double, y2 double, y3 double, y5 double"
    names = ["y1", "y2", "y3", "y5"]
    run = lambda r: equilibrium.curve_rate(spark.createDataFrame(r, schema), "key", "t", names, "y5", 40, 48, 2).orderBy("t").collect()
    got = run(rows)
    x[50, 0] = x[49, 0]
    assert all(r.curve_rate is None for r in got[:48]) and all(r.curve_rate is not None for r in got[48:])
    for t in (48, 60, 89):
        w = x[t - 40 : t + 1]
        values, vectors = np.linalg.eigh(np.cov(w.T))  # another way to the same factors
        v = vectors[:, ::-1][:, :2]
        f = (w - w.mean(0)) @ v
        b = np.linalg.lstsq(np.column_stack([np.ones(40), f[:-1]]), f[1:], rcond=None)[0]
        level = w.mean(0) + v @ np.linalg.inv(np.eye(2) - b[1:].T) @ b[0]
        assert got[t].curve_rate == pytest.approx(np.clip(level @ [0.4, 0.3, 0.2, 0.1], 6, 18))
        assert got[t].curve_premium == pytest.approx(x[t, 3] - (w.mean(0) + v @ f[-1])[3])
    assert [r.curve_rate for r in run(rows[:70])] == [r.curve_rate for r in got[:70]]
    assert equilibrium.tenor_weights(2) == pytest.approx([0.625, 0.375]) and equilibrium.tenor_weights(6).sum() == pytest.approx(1)


def test_composite_takes_each_rows_own_regime(spark):
    names = ["state_space", "fiscal"]
    m = spark.createDataFrame([("k", t, 4.0 if t != 2 else None, None if t == 0 else 8.0) for t in range(5)], "key string, t int, state_space double, fiscal double")
    h = spark.createDataFrame([("k", 1, 0.0, 0.0, 2.0), ("k", 4, 1.0, 1.0, 0.0), ("k", 3, 0.0, 0.0, 0.0)], "key string, t int, carry double, riskoff double, stress double")
    got = {r.t: r for r in equilibrium.composite_rate(m, h, "key", "t", names).collect()}
    assert (got[0].p_carry, got[1].p_stress, got[3].p_carry, got[4].p_riskoff) == (1.0, 1.0, 1.0, 0.5)
    assert got[0].composite == pytest.approx(4 * 0.35 / 0.5)
    assert got[1].composite == pytest.approx(min(10, (4 * 0.1 + 8 * 0.4) / 0.5)) == got[2].composite  # carried forward
    assert got[4].composite == pytest.approx((4 * 0.275 + 8 * 0.125) / 0.4)
    # a later regime moves no earlier row
    again = {r.t: r.composite for r in equilibrium.composite_rate(m, h.where("t < 4"), "key", "t", names).collect()}
    assert all(again[t] == got[t].composite for t in range(4))
    w = Window.partitionBy("key").orderBy("t")
    p = equilibrium.policy_rate(equilibrium.composite_rate(m, h, "key", "t", names), F.lit(5.0), None, F.lit(3.0), F.lit(2.0), w)
    rate = {r.t: r.policy_rate for r in p.collect()}
    assert rate[0] is None and rate[4] == pytest.approx(got[4].composite + 5 + 0.9 * 2 + 0.25 * 2)


def problem(seed, n=5):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n)) * 0.04
    return rng.normal(size=n) * 0.01, a @ a.T + 1e-5 * np.eye(n), rng.normal(size=n) * 0.3, rng.uniform(0, 0.004, n), rng.uniform(0.2, 1.5, n)


@pytest.mark.parametrize("seed", range(12))
def test_books_meet_the_conditions_of_the_best(seed):
    mu, v, previous, cost, limit = problem(seed)
    gamma, vol = 2.0, (0.03, 0.005, 1.0)[seed % 3]
    p, price = optimizer.best_book(mu, v, previous, cost, limit, gamma, vol)
    risk = np.sqrt(p @ v @ p)
    assert (np.abs(p) <= limit + 1e-12).all() and risk <= vol * (1 + 1e-7)
    assert price == 0 or risk == pytest.approx(vol, rel=1e-6)
    slope = mu - (gamma + 2 * price) * v @ p  # what a little more of each would earn, before costs
    for i in range(5):
        if abs(p[i] - previous[i]) < 1e-12:
            low, high = slope[i] - cost[i], slope[i] + cost[i]
        else:
            low = high = slope[i] - cost[i] * np.sign(p[i] - previous[i])
        if p[i] >= limit[i] - 1e-12:
            assert high >= -1e-7
        elif p[i] <= -limit[i] + 1e-12:
            assert low <= 1e-7
        else:
            assert low <= 1e-7 and high >= -1e-7
    value = lambda q: mu @ q - gamma / 2 * q @ v @ q - cost @ np.abs(q - previous)
    rng = np.random.default_rng(seed)
    for _ in range(500):
        q = np.clip(p + rng.normal(size=5) * rng.choice([0.001, 0.05, 0.5]), -limit, limit)
        if np.sqrt(q @ v @ q) <= vol:
            assert value(q) <= value(p) + 1e-9


def test_books_of_spark_are_solved_apart(spark):
    rows, pairs, wanted = [], [], {}
    for book in range(3):
        mu, v, previous, cost, limit = problem(20 + book)
        rows += [(book, f"i{k}", float(mu[k]), float(previous[k]), float(cost[k]), float(limit[k])) for k in range(5)]
        pairs += [(book, f"i{i}", f"i{j}", float(v[i, j])) for i in range(5) for j in range(i, 5)]
        wanted |= {(book, f"i{k}"): w for k, w in enumerate(optimizer.best_book(mu, v, previous, cost, limit, 2.0, 0.02)[0])}
    a = spark.createDataFrame(rows + [(9, "alone", 0.01, None, 0.0, 1.0)], "book int, instrument string, mu double, previous double, cost double, limit double")
    c = spark.createDataFrame(pairs + [(8, "x", "y", 1.0)], "book int, i string, j string, cov double")
    got = {(r.book, r.instrument): r.weight for r in optimizer.mean_variance(a, c, "book", 2.0, 0.02).collect()}
    assert got.pop((9, "alone")) == 1.0  # without risk, up to the limit
    assert got == pytest.approx(wanted)
    b = spark.createDataFrame([("a", 0.2), ("a", -0.1), ("a", 0.6), ("b", 0.1), ("b", None), ("c", -0.1), ("c", -0.2), ("c", 0.0)], "book string, ic double").withColumn("s", optimizer.budget_scale("ic", "book"))
    assert sorted((r.book, round(r.s, 6)) for r in b.collect()) == [("a", 0.0), ("a", 0.75), ("a", 2.25), ("b", 1.0), ("b", 1.0), ("c", 0.5), ("c", 0.5), ("c", 0.5)]
    mixed = b.select(optimizer.blended({"x": F.lit(0.5), "y": F.lit(None).cast("double")}, {"x": F.lit(1.0), "y": F.lit(2.0)}, 0.5).alias("m")).first().m
    assert mixed == pytest.approx(1.16)
