"""No task gathers what a large group holds, and streams do not call Python for each key."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import execution, risk
from tidemark.streaming import jobs


def _windowed_rows(df) -> int:
    """The most rows that were shuffled to one window of the plan that ``df`` last ran."""
    most = 0

    def walk(node, under: bool) -> None:
        nonlocal most
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), under)
        if "QueryStage" in name or name.startswith("ReusedExchange"):
            return walk(node.plan() if "QueryStage" in name else node.child(), under)
        under = under or name == "Window"
        if name == "Exchange":
            if under:
                most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
            under = False
        for k in range(node.children().size()):
            walk(node.children().apply(k), under)

    walk(df._jdf.queryExecution().executedPlan(), False)
    return most


def test_tail_ranks_no_whole_key(spark):
    rng = np.random.default_rng(11)
    values = np.concatenate([rng.normal(0, 1, 30_000).round(3), [float("inf")] * 3, [float("-inf")] * 2])
    rows = [("a", float(x)) for x in values] + [("b", 1.5)] * 9_000 + [("c", 2.0), ("d", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(4)
    out = risk.tail(df, "key", "v", 0.05)
    got = {r.key: (r.n, r.var, r.es) for r in out.collect()}
    assert 0 < _windowed_rows(out) < 6_000  # of 39,006
    edge = np.sort(values)[int((len(values) - 1) * 0.05)]
    assert got["a"][:2] == (len(values), -edge) and got["a"][2] == -np.mean(values[values <= edge])
    assert got["b"] == (9_000, -1.5, -1.5) and got["c"] == (1, -2.0, -2.0) and set(got) == {"a", "b", "c"}


@pytest.mark.parametrize("alpha", [0.0, 0.01, 0.5, 1.0])
def test_tail_at_all_levels(spark, alpha):
    values = np.random.default_rng(12).integers(-50, 50, 700).astype(float)
    r = risk.tail(spark.createDataFrame([("a", float(x)) for x in values], "k string, n double"), "k", "n", alpha).first()
    edge = np.sort(values)[int(np.floor((len(values) - 1) * alpha))]
    assert (r.n, r.var, r.es) == (700, -edge, pytest.approx(-values[values <= edge].mean()))


def _by_hand(events):
    now, filled, price, rows = "NEW", 0.0, 0.0, []
    for _, seq, target, qty, fill_qty, fill_price in sorted(events, key=lambda e: e[1]):
        legal = target in execution.TRANSITIONS[now]
        if legal:
            now = target
            if fill_qty is not None and fill_qty > 0:
                price = (price * filled + fill_price * fill_qty) / (filled + fill_qty)
                filled = min(filled + fill_qty, qty)
        rows.append((seq, now, filled, price if filled else None, legal))
    return rows


def test_order_stream_over_batches_without_python(spark, tmp_path):
    rng = np.random.default_rng(13)
    names = [*execution.TRANSITIONS, "UNKNOWN", None]
    events = [(k % 40, k, names[rng.integers(len(names))] if k >= 40 else "WORKING", 5.0, None if k % 7 == 0 else float(rng.integers(0, 4)), float(k)) for k in range(400)]
    schema = "order_id long, seq long, target string, qty double, fill_qty double, fill_price double"
    for part in (0, 1):  # the later events come first: what is late falls into place
        spark.createDataFrame([e for e in events if (e[1] < 200) == bool(part)], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    plans, batches = [], []

    def keep(df, k):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        batches.append({r.order_id: jobs.moves_of(df.where(F.col("order_id") == r.order_id)).count() for r in df.select("order_id").limit(1).collect()})
        df.write.mode("overwrite").parquet(f"file://{tmp_path}/out/{k}")

    jobs.order_states(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    assert len(batches) == 2 and not any("Pandas" in p or "Python" in p for p in plans)
    got = {r.order_id: [tuple(m) for m in r.moves] for r in spark.read.parquet(f"file://{tmp_path}/out/1").collect()}
    assert got == {k: _by_hand([e for e in events if e[0] == k]) for k in range(40)}
