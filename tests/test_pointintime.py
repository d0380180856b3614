"""Views at many cutoffs, correlations by pairs, regimes that are never repainted, and filters over streams."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import store
from tidemark.functions import series, statistics
from tidemark.operators import models, regimes, risk, vintages
from tidemark.streaming import filters

DAY = dt.datetime(2024, 1, 1)
LEDGER = "series_id string, event_time timestamp_ntz, knowledge_time timestamp_ntz, value double, source string, _seq long"


def ledger_rows() -> list[tuple]:
    rng, rows = np.random.default_rng(1), []
    for k in range(400):
        event = DAY + dt.timedelta(days=int(rng.integers(0, 12)))
        known = event + dt.timedelta(hours=int(rng.integers(0, 300)))
        rows.append((str(rng.choice(["a", "b", "c"])), event, known, float(rng.normal()), "s", k))
    noon = DAY + dt.timedelta(hours=12)
    # equal knowledge, knowledge at a cutoff to the moment, a null value, the same row again
    return rows + [("a", DAY, noon, 1.0, "s", 900), ("a", DAY, noon, 2.0, "s", 901), ("d", DAY, noon, None, "s", 902), ("d", DAY, noon, None, "s", 902)]


@pytest.fixture(scope="module")
def ledger(spark):
    return spark.createDataFrame(ledger_rows(), LEDGER).repartition(3)


def cutoff_table(spark, moments):
    return spark.createDataFrame([(m,) for m in moments], "at timestamp_ntz")


def plain_rows(df):
    return sorted(map(repr, df.collect()))


def test_views_are_those_of_each_cutoff(spark, ledger):
    moments = [DAY + dt.timedelta(hours=h) for h in (-5, 12, 13, 36, 37, 100, 240, 2000)]
    got = vintages.views(ledger, cutoff_table(spark, [*moments, moments[2], None]))
    for m in moments:
        mine = got.where(F.col("cutoff") == F.lit(m).cast("timestamp_ntz")).drop("cutoff")
        assert plain_rows(mine) == plain_rows(store.as_of_rows(ledger, m).select(*mine.columns))
    assert {r.cutoff for r in got.select("cutoff").distinct().collect()} <= set(moments)
    assert vintages.views(ledger, cutoff_table(spark, [None])).count() == 0
    assert vintages.views(ledger.where("false"), cutoff_table(spark, moments)).count() == 0


def test_views_scan_the_ledger_once(spark, tmp_path, ledger):
    ledger.write.parquet(str(tmp_path / "ledger"))
    got = vintages.views(spark.read.parquet(str(tmp_path / "ledger")), cutoff_table(spark, [DAY + dt.timedelta(hours=h) for h in range(0, 300, 7)]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_validity_intervals_do_not_overlap(ledger):
    rows = vintages.validity(ledger).orderBy("series_id", "event_time", "valid_from").collect()
    for a, b in zip(rows, rows[1:]):
        same = (a.series_id, a.event_time) == (b.series_id, b.event_time)
        assert a.valid_until == (b.valid_from if same else None)
    assert [r.value for r in rows if r.series_id == "a" and r.event_time == DAY and r.valid_from == DAY + dt.timedelta(hours=12)] == [2.0]


def test_readings_and_spine(spark, ledger):
    moments = [DAY + dt.timedelta(days=d) for d in (2, 9, 30)]
    got = vintages.readings(ledger, cutoff_table(spark, moments), lambda v, w: series.rolling(F.avg, v, w, 3, 1))
    for m in moments:
        for name in "abcd":
            x = [r.value for r in store.as_of_series(ledger, m, name).collect()]
            mine = [r.reading for r in got.where((F.col("cutoff") == F.lit(m).cast("timestamp_ntz")) & (F.col("series_id") == name)).collect()]
            last = [v for v in x[-3:] if v is not None]
            assert mine == ([] if not x else [pytest.approx(np.mean(last))] if last else [None])
    assert plain_rows(vintages.spine(ledger, moments[1])) == plain_rows(store.as_of_rows(ledger, moments[1]).select("series_id", "event_time", "value"))
    assert plain_rows(vintages.spine(ledger)) == plain_rows(store.as_of_rows(ledger, dt.datetime(2100, 1, 1)).select("series_id", "event_time", "value"))


def panel(spark, assets=4, times=80):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(times, assets)) @ rng.normal(size=(assets, assets)) * 0.02
    rows = [(f"s{k}", t, float(x[t, k])) for t in range(times) for k in range(assets)]
    return x, spark.createDataFrame([*rows, ("s0", 900, 1.0), ("s1", 901, float("nan")), ("s1", 902, None)], "asset string, at int, ret double").repartition(3)


def dense_dcc(x, a, b, alpha=0.06, beta=0.9):
    e = x - x.mean(0)
    v = (e**2).mean(0)
    h = np.array([risk.garch_recursion(np.append(e[:, k] ** 2, 0), v[k] * (1 - alpha - beta), alpha, beta, v[k]) for k in range(x.shape[1])]).T
    z = e / np.sqrt(h[:-1])
    scaled = lambda m: m / np.sqrt(np.outer(np.diag(m), np.diag(m)))
    bar = scaled(np.cov(z.T))
    q = bar.copy()
    for t in range(1, len(z)):
        q = (1 - a - b) * bar + a * np.outer(z[t - 1], z[t - 1]) + b * q
    return scaled(q), np.sqrt(h[-1]), z


def test_correlations_by_pairs_are_those_of_the_matrix(spark):
    x, df = panel(spark)
    want, sigma, _ = dense_dcc(x, 0.05, 0.9)
    for r in risk.dcc_correlation(df, "asset", "at", "ret", 0.05, 0.9, (0.06, 0.9)).collect():
        assert r["corr"] == pytest.approx(want[int(r.i[1:]), int(r.j[1:])], abs=1e-9)
    got = risk.dcc_garch_covariance(df, "asset", "at", "ret", 0.05, 0.9, (0.06, 0.9)).collect()
    assert len(got) == 10
    for r in got:
        i, j = int(r.i[1:]), int(r.j[1:])
        assert r["cov"] == pytest.approx(sigma[i] * sigma[j] * want[i, j], rel=1e-9)


def test_correlation_parameters_by_pairs(spark):
    x, df = panel(spark)
    z = risk.standardised(df, "asset", "at", "ret", (0.06, 0.9))
    grid = ((0.01, 0.6), (0.05, 0.9), (0.12, 0.85))
    dense = dense_dcc(x, 0, 0)[2]

    def loss(a, b):
        total = 0.0
        for i in range(4):
            for j in range(i + 1, 4):
                p = dense[:, [i, j]]
                bar = np.corrcoef(p.T)
                q = bar.copy()
                for t in range(len(p)):
                    if t:
                        q = (1 - a - b) * bar + a * np.outer(p[t - 1], p[t - 1]) + b * q
                    c = q / np.sqrt(np.outer(np.diag(q), np.diag(q)))
                    total += 0.5 * (np.linalg.slogdet(c)[1] + p[t] @ np.linalg.inv(c) @ p[t])
        return total

    assert risk.fit_dcc(z, grid) == min(grid, key=lambda g: loss(*g))
    assert risk.fit_dcc(z.where("s < 5"), grid) is None
    # what cannot be fitted, or is not stationary, is the plain correlation
    for a, b in ((None, None), (0.5, 0.5)):
        short = df.where("at < 6") if a is None else df
        assert all(r["corr"] == pytest.approx(r.qbar) for r in risk.dcc_correlation(short, "asset", "at", "ret", a, b, (0.06, 0.9)).collect())
    assert {(r.i, r.j) for r in risk.dcc_garch_covariance(df.where("asset = 's0'"), "asset", "at", "ret").collect()} == {("s0", "s0")}


def two_regimes(spark, months=150):
    rng = np.random.default_rng(4)
    wild = (np.arange(months) // 40) % 2 == 1
    rows = []
    for key in ("x", "y"):
        for t in range(months):
            level = 3.0 if wild[t] else 0.0
            v = [float(rng.normal(level, 1)), float(rng.normal(-level, 1)), None if t < 100 else float(rng.normal())]
            rows.append((key, t, *v))
    rows[7] = ("x", 7, None, 1.0, None)
    return wild, spark.createDataFrame(rows, "key string, t int, a double, b double, late double")


def test_later_months_repaint_no_regime(spark):
    wild, df = two_regimes(spark)
    fit = lambda d: {(r.key, r.t): (r.asof, round(r.p0, 9), round(r.p1, 9)) for r in regimes.point_in_time(d, "key", "t", ["a", "b", "late"], F.col("t") % 12 == 0, 2, "a").collect()}
    whole = fit(df)
    for most in (75, 100, 130):
        part = fit(df.where(F.col("t") <= most))
        assert part and all(whole[k] == v for k, v in part.items())
    assert ("x", 7) not in whole  # an incomplete row
    assert min(t for _, t in whole) == 0 and {asof for (_, t), (asof, *_) in whole.items() if 0 < t <= 60} <= {60, 72}
    right = [(p1 > 0.5) == wild[t] for (_, t), (_, _, p1) in whole.items() if t > 60]
    assert np.mean(right) > 0.9
    assert all(abs(p0 + p1 - 1) < 1e-8 for _, p0, p1 in whole.values())
    # written once: history wins
    first = regimes.point_in_time(df.where("t <= 75"), "key", "t", ["a", "b", "late"], F.col("t") % 12 == 0, 2, "a")
    changed = first.withColumn("p0", F.lit(9.0))
    kept = regimes.append_regimes(changed, regimes.point_in_time(df, "key", "t", ["a", "b", "late"], F.col("t") % 12 == 0, 2, "a"), "key", "t").collect()
    assert len(kept) == len(whole) and sum(r.p0 == 9.0 for r in kept) == first.count()


def test_lookup_of_probabilities(spark):
    history = spark.createDataFrame([("x", 3, 0.7), ("x", 5, None)], "key string, t int, p double")
    dates = spark.createDataFrame([("x", 2), ("x", 3), ("x", 4), ("x", 9), ("y", 4)], "key string, t int")
    got = {(r.key, r.t): (r.p, r.other) for r in regimes.probabilities_at(dates, history, "key", "t", {"p": 0.33, "other": 0.5}).collect()}
    assert got == {("x", 2): (0.33, 0.5), ("x", 3): (0.7, 0.5), ("x", 4): (0.7, 0.5), ("x", 9): (0.33, 0.5), ("y", 4): (0.33, 0.5)}
    one = spark.createDataFrame([("x", 3, 0.7)], "key string, t int, p double")
    assert regimes.combined(one, None, "key", "t", {"p": 0.3}, {"q": 0.5}).collect()[0].q == 0.5
    assert regimes.combined(one, history.withColumnRenamed("p", "q"), "key", "t", {"p": 0.3}, {"q": 0.5}).count() == 1


HMM = (np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.0, 0.0], [2.0, -1.0]]), np.array([np.eye(2), 2 * np.eye(2)]))


@pytest.mark.parametrize("name", ["level", "variance", "regime", "cooldown"])
def test_streamed_filters_are_the_batch_ones_after_a_restart(spark, tmp_path, name):
    rng = np.random.default_rng(6)
    rows = [(k % 3, k, None if k % 17 == 5 else float(rng.normal()), float(rng.normal())) for k in range(90)]
    made = {"level": filters.level_filter(), "variance": filters.variance_filter(0.1, 0.1, 0.8, 1.0), "regime": filters.regime_filter(*HMM), "cooldown": filters.cooldown_filter(3)}[name]
    columns = ["v"] if name in ("level", "variance") else ["v", "w"]
    schema = "key int, seq long, v double, w double"
    # the second run gets the last rows of the first once more
    for a, b in ((0, 40), (33, 90)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with filters.state_store(spark):
            q = filters.stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "key", "seq", columns, made)
            q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    df = spark.createDataFrame(rows + rows[:4], schema)
    assert got == sorted(map(tuple, filters.batch(df, "key", "seq", columns, made).collect()))
    part = [r for r in rows if r[0] == 1]
    mine = [r[2:] for r in got if r[0] == 1]
    if name == "level":
        other = models.local_level(spark.createDataFrame(part, schema), "key", "seq", "v").orderBy("seq").collect()
        assert np.allclose([m[0] for m in mine], [r.level for r in other], equal_nan=True)
    elif name == "variance":
        whole = [r for r in part if r[2] is not None]
        if len(whole) == len(part):
            assert np.allclose([m[0] for m in mine], risk.garch_recursion(np.array([r[2] ** 2 for r in part]), 0.1, 0.1, 0.8, 1.0))
    elif name == "regime":
        x = np.array([[np.nan if v is None else v for v in r[2:]] for r in part])
        e = np.column_stack([models.gaussian_log_density(np.nan_to_num(x), HMM[2][k], HMM[3][k]) for k in range(2)])
        e[~np.isfinite(x).all(axis=1)] = 0
        assert np.allclose(mine, models.log_forward(e, HMM[0], HMM[1]))
    else:
        dominant = [int(np.argmax([-np.inf if v is None else v for v in r[2:]])) for r in part]
        at, wanted = -999, []
        for k, now in enumerate(dominant):
            changed = k > 0 and now != dominant[k - 1]
            fires = changed and k + 1 - at >= 3
            at = k + 1 if fires else at
            wanted.append((now, changed, fires))
        assert mine == wanted


def test_stability_by_key_is_that_of_each(spark):
    rng = np.random.default_rng(8)
    rows = [(k, float(rng.normal(k * n, 1)), bool(n)) for k in range(3) for n in (0, 1) for _ in range(200)] + [(7, 1.0, False), (8, 1.0, True)]
    df = spark.createDataFrame(rows, "key int, v double, now boolean")
    got = {r.key: r.psi for r in statistics.stability_by(df, "key", "v", F.col("now")).collect()}
    for k in range(3):
        part = df.where(F.col("key") == k)
        assert got[k] == pytest.approx(statistics.population_stability(part.where("not now"), part.where("now"), "v").first()[0])
    assert got[7] is None and got[8] is None
