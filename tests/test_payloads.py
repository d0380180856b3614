"""Stored payloads as a data source with filters, lines put aside, and ledgers saved, loaded and appended to."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import store
from tidemark.functions import series
from tidemark.operators import joins
from tidemark.sources import parsers, payloads


@pytest.fixture()
def root(tmp_path):
    def put(source, name, content, file="a.json"):
        folder = tmp_path / source / name
        folder.mkdir(parents=True, exist_ok=True)
        (folder / file).write_text(content if isinstance(content, str) else json.dumps(content))

    put("BCB_SGS", "CDI", [{"data": "02/01/2024", "valor": "1,5"}, {"data": "03/01/2024", "valor": "x"}, {"data": "04/01/2024", "valor": "2"}])
    put("BCB_SGS", "CDI", [{"data": "05/01/2024", "valor": "3"}], "b.json")
    put("BCB_SGS", "SELIC", [{"data": "02/01/2024", "valor": "11"}])
    put("BCB_SGS", "BROKEN", "no json at all")
    put("FRED", "DGS10", {"observations": [{"date": "2024-01-02", "value": "4.1"}, {"date": "2024-01-03", "value": "."}]})
    return str(tmp_path)


def load(spark, root, source):
    payloads.install(spark)
    return spark.read.format("payloads").option("path", root).option("source", source).load()


def test_the_source_takes_filters(spark, root):
    df = load(spark, root, "BCB_SGS")
    day = lambda d: dt.date(2024, 1, d)
    assert sorted(map(tuple, df.collect())) == [("CDI", day(2), 1.5), ("CDI", day(4), 2.0), ("CDI", day(5), 3.0), ("SELIC", day(2), 11.0)]
    some = df.where((F.col("series_id") == "CDI") & (F.col("event_time") > F.lit(day(2))) & (F.col("event_time") <= F.lit(day(4))))
    assert sorted(map(tuple, some.collect())) == [("CDI", day(4), 2.0)]
    reader = payloads.PayloadReader(root, "BCB_SGS")
    left = list(reader.pushFilters([payloads.EqualTo(("series_id",), "CDI"), payloads.GreaterThan(("event_time",), day(2)), payloads.GreaterThan(("value",), 0.0)]))
    assert left == [payloads.GreaterThan(("value",), 0.0)] and len(reader.partitions()) == 2
    assert [r[1] for p in reader.partitions() for r in reader.read(p)] == [day(4), day(5)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    # Spark keeps its own checks for nulls; the comparisons went to the source
    assert ">" not in plan.split("Filter (")[1].split("\n")[0] and "CDI" not in plan.split("BatchScan")[0]
    assert load(spark, root, "FRED").collect()[0].value == 4.1
    with pytest.raises(Exception, match="BCB_SGS or FRED"):
        load(spark, root, "OTHER").collect()


def test_the_registry_and_the_readers_agree(spark, root):
    for source in ("BCB_SGS", "FRED"):
        mine = sorted(map(tuple, payloads.read(spark, f"file://{root}", source).select("series_id", "event_time", "value").collect()))
        assert mine == sorted(map(tuple, load(spark, root, source).collect()))
    assert payloads.adapter_for("BCB_FOCUS") is parsers.focus
    with pytest.raises(KeyError, match="no adapter for NONE"):
        payloads.adapter_for("NONE")
    payloads.register("OWN", parsers.fred)
    assert payloads.adapter_for("OWN") is parsers.fred
    payloads.ADAPTERS.pop("OWN")


LINES = ['{"k": 1, "v": "a"}', '{"k": 2', "", "  ", '{"v": "b"}', '{"k": "x", "v": "c"}', "[1]", '{"k": 3, "v": null, "more": 1}', None]


def test_lines_that_cannot_be_read_are_put_aside(spark, tmp_path):
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "n int, value string")
    good, bad = payloads.parsed_lines(lines, "k long not null, v string")
    assert sorted(map(tuple, good.collect())) == [(0, 1, "a"), (7, 3, None)]
    assert {r.n: r.reason for r in bad.collect()} == {1: "not readable", 4: "no k", 5: "not readable", 6: "not readable"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(t for t in LINES if t))
    for more in ('{"k": 4}', "{"):
        payloads.quarantine_stream(spark.readStream.text(str(tmp_path / "in")), "k long not null, v string", str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state")).awaitTermination()
        (tmp_path / "in" / f"{len(more)}.txt").write_text(more)
    payloads.quarantine_stream(spark.readStream.text(str(tmp_path / "in")), "k long not null, v string", str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [1, 3, 4]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 5


def ledger(spark, rows):
    return spark.createDataFrame([(s, dt.datetime(2024, 1, e), dt.datetime(2024, 1, k) if k else None, float(v), "s", None, None, None, None, q) for s, e, k, v, q in rows], store.LEDGER)


def test_ledgers_are_saved_by_series_and_loaded(spark, tmp_path):
    a = ledger(spark, [("a", 1, 2, 1, 0), ("b", 1, 2, 2, 1), ("a", 1, 3, 3, 2)])
    store.save(a, str(tmp_path / "l"))
    b = store.load(spark, str(tmp_path / "l"))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and b.schema == a.schema
    assert len(b.where("series_id = 'b'").inputFiles()) >= 1 and (tmp_path / "l" / "series_id=a").is_dir()
    with pytest.raises(Exception, match="already exists"):
        store.save(a, str(tmp_path / "l"))


def test_appended_rows_are_numbered_by_what_they_are(spark):
    old = ledger(spark, [("a", 1, 2, 1, 7)])
    new = ledger(spark, [("b", 1, 5, 1, 0), ("a", 2, 5, 2, 0), ("a", 1, 5, 3, 0), ("c", 1, 3, 4, 0), ("a", 9, 9, 5, 0), (None, 1, None, 6, 0), ("a", 2, 5, 2, 0)]).drop("_seq")
    for parts in (1, 5):
        got = store.append(old, new.repartition(parts)).orderBy("_seq").collect()
        assert [(r.value, r["_seq"]) for r in got] == [(1.0, 7), (6.0, 8), (4.0, 9), (3.0, 10), (2.0, 11), (2.0, 12), (1.0, 13), (5.0, 14)]
    assert store.append(store.empty(spark), new).agg(F.min("_seq")).first()[0] == 0


def test_spans_without_bound_go_by_days(spark, monkeypatch):
    rows = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in range(1, 20)], "at date, n int")
    spans = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 3), "x"), (dt.date(2024, 1, 3), dt.date(2024, 1, 3), "y"), (dt.date(2024, 1, 5), dt.date(2024, 1, 4), "none")], "start date, end date, name string").where("end >= start")
    few = sorted((r.n, r.name) for r in joins.range_join(rows, spans, "at").collect())
    monkeypatch.setattr(joins, "FEW_SPANS", 1)
    assert few == sorted((r.n, r.name) for r in joins.range_join(rows, spans, "at").collect()) == [(1, "x"), (2, "x"), (3, "x"), (3, "y")]


def test_floor_quantiles_of_repeated_values(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 1, 1, 2)] + [("b", 3.0), ("b", None), ("b", float("nan"))], "k string, v double")
    got = {r.k: r.q for r in series.floor_quantiles(df, "k", "v", [0.0, 0.5, 0.6, 0.8, 1.0]).collect()}
    assert got == {"a": [1.0, 1.0, 2.0, 5.0, 5.0], "b": [3.0] * 5}
