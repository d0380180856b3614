"""Point-in-time and causal guarantees, edge cases and stateful parts."""

from __future__ import annotations

import datetime as dt
import importlib
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import catalog, store
from tidemark.functions import calendar, series, statistics
from tidemark.operators import ensembles, execution, governance, intelligence, joins, ledger, models, risk
from tidemark.sources import parsers

T = dt.datetime
ROWS = [
    ("A", T(2024, 1, 31), T(2024, 2, 10), 1.0, 0),
    ("A", T(2024, 1, 31), T(2024, 5, 1), 1.5, 1),
    ("A", T(2024, 2, 29), T(2024, 3, 10), 2.0, 2),
    ("B", T(2024, 1, 31), T(2024, 2, 5), 9.0, 3),
    ("B", T(2024, 1, 31), T(2024, 2, 5), 9.5, 4),
]


@pytest.fixture(scope="module")
def observations(spark):
    return spark.createDataFrame(ROWS, "series_id string, event_time timestamp_ntz, knowledge_time timestamp_ntz, value double, _seq long").withColumn("source", F.lit("s"))


@pytest.mark.parametrize(("cutoff", "wanted"), [("2024-02-06", {("B", 1): 9.5}), ("2024-02-15", {("A", 1): 1.0, ("B", 1): 9.5}), ("2024-04-01", {("A", 1): 1.0, ("A", 2): 2.0, ("B", 1): 9.5}), ("2024-06-01", {("A", 1): 1.5, ("A", 2): 2.0, ("B", 1): 9.5})])
def test_as_of_sees_only_what_was_known(observations, cutoff, wanted):
    assert {(r.series_id, r.event_time.month): r.value for r in store.as_of_rows(observations, cutoff).collect()} == wanted


def test_append_numbers_rows_on(spark, observations):
    new = spark.createDataFrame([("C", T(2024, 1, k), T(2024, 2, k), float(k)) for k in range(1, 20)], "series_id string, event_time timestamp_ntz, knowledge_time timestamp_ntz, value double").withColumn("source", F.lit("n")).repartition(4)
    base = store.append(store.empty(spark), observations.drop("_seq"))
    got = [r._seq for r in store.append(base, new).collect()]
    assert sorted(got) == list(range(24))
    assert [r._seq for r in store.append(base, new).where("series_id = 'C'").orderBy("knowledge_time").collect()] == list(range(5, 24))


def test_ingest_quarantines(spark):
    rows = spark.createDataFrame([("CDI", T(2024, 1, 1), T(2024, 1, 2), v) for v in (1.0, 9.0, -1.0, None)] + [("NONE", T(2024, 1, 1), T(2024, 1, 2), 1.0)], "series_id string, event_time timestamp_ntz, knowledge_time timestamp_ntz, value double").withColumn("source", F.lit("s"))
    good, bad = store.ingest(store.empty(spark), rows, catalog.contracts(spark))
    assert good.count() == 1
    assert sorted(str(r.violations) for r in bad.collect()) == ["['above maximum']", "['below minimum']", "['missing']", "['no contract']"]
    with pytest.raises(KeyError):
        catalog.contract(spark, "NOT_THERE")


CAUSAL = {
    "z": lambda w: series.zscore("v", w, 12),
    "winsor": lambda w: series.winsorize("v", w),
    "fill": lambda w: series.bounded_ffill("v", w, 3),
    "rank": lambda w: series.expanding_rank("v", w),
    "position": lambda w: series.causal_position("v", w),
    "drawdown": lambda w: series.drawdown(F.abs("v") + 1, w),
    "width": lambda w: intelligence.conformal_width(F.col("v"), w),
}


@pytest.fixture(scope="module")
def canary():
    rng = np.random.default_rng(7)
    v = 0.3 * np.cumsum(rng.normal(size=120))
    return pd.DataFrame({"key": "a", "t": range(120), "v": [None if k % 17 == 5 else float(x) for k, x in enumerate(v)]})


@pytest.mark.parametrize("name", CAUSAL)
def test_transforms_never_look_ahead(spark, canary, name):
    w = Window.partitionBy("key").orderBy("t")
    whole = {r.t: r.x for r in spark.createDataFrame(canary).select("t", CAUSAL[name](w).alias("x")).collect()}
    shocked = canary.copy()
    shocked.loc[90:, "v"] = shocked.loc[90:, "v"] * 12 + 5
    for k, frame in ((60, canary[:60]), (90, shocked)):
        part = {r.t: r.x for r in spark.createDataFrame(frame).select("t", CAUSAL[name](w).alias("x")).collect()}
        assert all(part[t] == whole[t] or abs(part[t] - whole[t]) < 1e-12 for t in range(k) if part[t] is not None or whole[t] is not None)


def test_windows_equal_pandas(spark, canary):
    w = Window.partitionBy("key").orderBy("t")
    got = spark.createDataFrame(canary).select("t", series.zscore("v", w, 12).alias("z"), series.winsorize("v", w).alias("c"), series.bounded_ffill("v", w, 2).alias("f")).orderBy("t").toPandas()
    v = canary.v.astype(float)
    roll = v.rolling(12, min_periods=6)
    np.testing.assert_allclose(got.z.astype(float), (v - roll.mean()) / roll.std(), atol=1e-9)
    e = v.expanding(min_periods=20)
    np.testing.assert_allclose(got.c.astype(float), v.clip(e.quantile(0.05), e.quantile(0.95)).where(e.count() >= 20, v), atol=1e-9)
    np.testing.assert_allclose(got.f.astype(float), v.ffill(limit=2))
    ewm = series.ewm(spark.createDataFrame(canary), "key", "t", "v", span=20).orderBy("t").toPandas()
    np.testing.assert_allclose(ewm.ewm_std.astype(float), v.ewm(span=20).std(), atol=1e-12)


def test_as_of_join_is_backward_and_strict_on_request(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 40), ("b", 3, 30), ("a", None, 99)], "k string, t int, v int")
    read = lambda df: {(r.k, r.t): r.v for r in df.collect()}
    assert read(joins.asof_join(left, right, "k", "t", ["v"])) == {("a", 1): 10, ("a", 5): 40, ("b", 2): None, ("a", None): None}
    assert read(joins.asof_join(left, right, "k", "t", ["v"], strict=True))[("a", 1)] is None


def test_calendars(spark):
    a = spark.createDataFrame([("k", dt.date(2020, 12, 31), 1.0), ("k", dt.date(2021, 12, 31), 3.0)], "key string, at date, v double")
    held = calendar.annual_to_monthly(a, "key", "at", "v").orderBy("month").collect()
    assert len(held) == 13 and [r.v for r in held[:12]] == [1.0] * 12 and held[12].v == 3.0
    line = calendar.annual_to_monthly_linear(a, "key", "at", "v").orderBy("month").collect()
    assert len(line) == 13 and line[0].v == 1.0 and line[12].v == 3.0 and 1.9 < line[6].v < 2.1
    at = spark.createDataFrame([(dt.date(2024, 1, 31),), (dt.date(2024, 2, 10),)], "d date")
    assert [tuple(map(str, r)) for r in at.select(calendar.next_month_end("d"), calendar.previous_month_end("d")).collect()] == [("2024-02-29", "2023-12-31"), ("2024-02-29", "2024-01-31")]


def test_sharpe_of_luck_and_of_skill(spark):
    rng = np.random.default_rng(0)
    rows = [("luck", float(x)) for x in rng.normal(0, 0.02, 200)] + [("skill", float(x)) for x in rng.normal(0.01, 0.02, 200)] + [("flat", 0.01)] * 30
    got = {r.key: r for r in statistics.sharpe_statistics(spark.createDataFrame(rows, "key string, r double"), "key", "r", 20).collect()}
    assert got["skill"].dsr > 0.95 > got["luck"].dsr and got["flat"].sharpe is None


def test_parsers(spark):
    raw = lambda s: spark.createDataFrame([(s,)], "raw string")
    read = lambda df: [(str(r.event_time), r.value) for r in df.collect()]
    assert read(parsers.sgs(raw('[{"data":"01/02/2024","valor":"0,46"},{"data":"bad","valor":"1"},{"data":"02/02/2024","valor":"0.38"}]'))) == [("2024-02-01", 0.46), ("2024-02-02", 0.38)]
    assert read(parsers.fred(raw('{"observations":[{"date":"2024-01-01","value":"."},{"date":"2024-01-02","value":"4.1"}]}'))) == [("2024-01-02", 4.1)]
    assert read(parsers.cot(raw('[{"report_date_as_yyyy_mm_dd":"2024-01-02T00:00:00","noncomm_positions_long_all":"10","noncomm_positions_short_all":"4"},{"report_date_as_yyyy_mm_dd":"2024-01-09","noncomm_positions_long_all":"x","noncomm_positions_short_all":"4"}]'))) == [("2024-01-02", 6.0)]
    assert read(parsers.focus(raw('{"value":[{"Indicador":"IPCA","Data":"2024-01-02","Media":4.0,"Mediana":3.9}]}'))) == [("2024-01-02", 3.9)]
    assert read(parsers.ipeadata(raw('{"value":[{"VALDATA":"2024-01-05T00:00:00-03:00","VALVALOR":7.5}]}'))) == [("2024-01-31", 7.5)]
    assert parsers.single_entity(raw('{"value":[{"a":1}]}'), "a int").first().entity.a == parsers.single_entity(raw('{"a":1}'), "a int").first().entity.a == 1
    meta = spark.createDataFrame([("Saldo de Transações", "BCB")], "name string, source string")
    assert parsers.verified_metadata(meta, ["transacoes", "bcb"], ["fipe"], ["name", "source"]).first().verified
    lines = spark.createDataFrame([(1, 4.0, 10.0), (1, 6.0, 12.0), (2, 5.5, 9.0), (3, 9.0, 1.0), (4, 5.0, 7.0)], "base int, ttm_years double, rate double")
    assert {r.base: r.value for r in parsers.constant_maturity(lines, 5.0).collect()} == {1: 11.0, 2: 9.0, 4: 7.0}
    ppp = parsers.extrapolated_ppp(spark.createDataFrame([(2020, 2.0)], "year int, ppp double"), spark.createDataFrame([(2020, 0.5, 0.5), (2021, 0.1, 0.0), (2022, 0.21, 0.1)], "year int, home double, abroad double"))
    assert {r.year: round(r.ppp, 6) for r in ppp.collect()} == {2021: 2.2, 2022: 2.42}


def test_order_states(spark):
    moves = spark.createDataFrame([("NEW", "WORKING"), ("WORKING", "FILLED"), ("FILLED", "WORKING"), ("NEW", "FILLED")], "a string, b string")
    assert [r[0] for r in moves.select(execution.can_transition(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]


def test_paper_fills_are_capped_and_hold_on_missing(spark):
    rows = [("k", 0, 10.0, 100.0, 40.0), ("k", 1, 10.0, 100.0, 40.0), ("k", 2, None, 100.0, 40.0), ("k", 3, 0.0, 101.0, 400.0)]
    got = execution.paper_fills(spark.createDataFrame(rows, "key string, t int, target double, price double, liq double"), "key", "t", "target", "price", "liq", 10, 5, 0.1).orderBy("t").collect()
    assert [r.position for r in got] == [4.0, 8.0, 8.0, 0.0]
    assert got[0].fill_price == pytest.approx(100.1) and got[0].commission == pytest.approx(0.2) and got[3].fill_price == pytest.approx(100.899)


def _returns(spark, n=60):
    rng = np.random.default_rng(3)
    days = pd.date_range("2010-01-31", periods=n, freq="ME").date
    return spark.createDataFrame([("s", d, float(x)) for d, x in zip(days, rng.normal(0.01, 0.02, n))], "strategy_hash string, month date, ret double")


def test_replay_equals_ticking(spark):
    r = _returns(spark)
    whole = {x.month: x.frozen_position for x in ledger.decisions(r, "strategy_hash", "month", "ret").collect()}
    for cut in ("2012-06-30", "2013-12-31"):
        part = {x.month: x.frozen_position for x in ledger.decisions(r.where(F.col("month") <= cut), "strategy_hash", "month", "ret").collect()}
        assert part and all(whole[m] == pytest.approx(p) for m, p in part.items())


def test_ledger_is_append_only_and_scores_once(spark, tmp_path):
    spec = {"kind": "momentum", "lookback": 3}
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger")
    with pytest.raises(PermissionError):
        book.verdict(spec)
    h = book.book(spec, 5, 0.1, 46)
    r = _returns(spark).withColumn("strategy_hash", F.lit(h))
    d = ledger.decisions(r, "strategy_hash", "month", "ret")
    book.append("decisions", d)
    book.append("decisions", d)
    assert book.read("decisions").count() == d.count() and book.duplicates("decisions").count() == 0
    with pytest.raises(ledger.DataRevisionError):
        book.append("decisions", d.withColumn("signal", F.col("signal") + 1))
    x = ledger.realizations(d, r, "strategy_hash", "2016-01-31")
    n = x.where("stream = 'frozen'").count()
    book.append("realizations", x)
    with pytest.raises(PermissionError if n != 46 else AssertionError):
        book.verdict(spec)
        raise AssertionError
    other = {**spec, "lookback": 4}
    h2 = book.book(other, 5, 0.1, n)
    book.append("realizations", x.withColumn("strategy_hash", F.lit(h2)))
    first = book.verdict(other)
    assert first == book.verdict(other) and first["n"] == n and book.read("consumed").where(F.col("strategy_hash") == h2).count() == 1
    with pytest.raises(ledger.DataRevisionError):
        book.book(other, 6, 0.1, n)


def test_garch_and_filters(spark):
    rng = np.random.default_rng(5)
    calm, wild = rng.normal(0, 0.01, 300), rng.normal(0, 0.06, 300)
    rows = [("a", k, float(x)) for k, x in enumerate([*calm, *wild])]
    vol = risk.garch(spark.createDataFrame(rows, "key string, t int, r double"), "key", "t", "r").orderBy("t").toPandas().garch_vol
    assert vol[400:].mean() > 2 * vol[100:300].mean()


def test_black_litterman_without_views_is_equilibrium():
    cov = np.array([[0.04, 0.01], [0.01, 0.09]])
    mu, _ = models.black_litterman(cov, np.array([0.6, 0.4]), np.zeros((0, 2)), np.zeros(0))
    assert np.allclose(mu, 2.5 * cov @ [0.6, 0.4])
    mu, _ = models.black_litterman(cov, np.array([0.6, 0.4]), np.array([[1.0, 0.0]]), np.array([0.5]))
    assert mu[0] > (2.5 * cov @ [0.6, 0.4])[0]


def test_breaker_stream(spark, tmp_path):
    from tidemark.streaming import jobs

    spark.createDataFrame([("a", k, x) for k, x in enumerate([0.01, -0.05, 0.1])], "key string, seq long, ret double").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("key string, seq long, ret double").parquet(f"file://{tmp_path}/in")
    q = jobs.live_breaker(stream).writeStream.format("memory").queryName("breaker").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.halted for r in spark.sql("SELECT * FROM breaker ORDER BY seq").collect()] == [False, True, True]


def test_append_absent_stream_is_idempotent(spark, tmp_path):
    from tidemark.streaming import jobs

    rows = spark.createDataFrame([(k % 5, k) for k in range(20)], "id long, v long")
    rows.write.parquet(f"file://{tmp_path}/in")
    for n in range(2):
        stream = spark.readStream.schema("id long, v long").parquet(f"file://{tmp_path}/in")
        jobs.append_absent(stream, f"file://{tmp_path}/out", ["id"], f"file://{tmp_path}/state{n}").awaitTermination(60)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 5


def test_repaired_matrices_are_nearest(spark):
    rows = [("m", "a", "a", 1.0), ("m", "a", "b", 2.0), ("m", "b", "b", 1.0), ("sound", "a", "a", 2.0), ("sound", "a", "b", 0.5), ("sound", "b", "b", 1.0)]
    got = {(r.book, r.i, r.j): r.v for r in governance.nearest_psd(spark.createDataFrame(rows, "book string, i string, j string, v double"), "book", "i", "j", "v").collect()}
    # eigenvalues 3 and -1 along (1, 1) and (1, -1): without the second, 1.5 everywhere
    assert all(abs(got["m", i, j] - 1.5) < 1e-9 for i in "ab" for j in "ab")
    assert [round(got["sound", i, j], 9) for i, j in ("aa", "ab", "ba", "bb")] == [2.0, 0.5, 0.5, 1.0]


def test_criterion_fails_on_missing_figures(spark):
    rows = [(0.5, 0.6, 1.0, 1.1), (0.5, 0.54, 1.0, 1.1), (0.5, 0.6, 1.1, 1.1), (float("nan"), 0.6, 1.0, 1.1), (0.5, None, 1.0, 1.1)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert [r.ok for r in df.select(ensembles.criterion_met(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 0.05).alias("ok")).collect()] == [True, False, False, False, False]


def test_entry_works_without_the_corpus_folders(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("tidemark.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    for name in ("corpus_pipeline", "tidemark.llm"):
        monkeypatch.setitem(sys.modules, name, None)
    entry = importlib.import_module("__spark_entry__")
    assert "asof_wide" in entry.queries() and not any(n.startswith("op1") for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
