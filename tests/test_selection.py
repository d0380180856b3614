"""Trees, selection by shadows and stability, the history of selections, purged search and attributions."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import trees
from tidemark.operators import selection

NAMES = ["a", "b", "n1", "n2", "n3"]


def planted(rows=160, seed=1, nonlinear=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, 5))
    y = (np.where(x[:, 0] > 0, 1.5, -1.5) * np.where(x[:, 1] > 0, 1, -1) if nonlinear else 2 * x[:, 0] - x[:, 1]) + (x[:, 0] if nonlinear else 0) + rng.normal(size=rows) * 0.3
    own = (y - y.mean()) / np.linalg.norm(y - y.mean())
    x[:, 2:] -= np.outer(own, own @ x[:, 2:])  # noise that does not follow the target by chance
    return x, y


def frame(spark, keys=("p", "q"), rows=160, nonlinear=True):
    out = []
    for k, key in enumerate(keys):
        x, y = planted(rows, k + 1, nonlinear)
        out += [(key, t, *map(float, x[t]), float(y[t])) for t in range(rows)]
    out += [("short", t, *[float(t)] * 5, 1.0) for t in range(5)] + [(keys[0], 999, None, 1.0, 1.0, 1.0, 1.0, 5.0), (keys[0], 998, *[1.0] * 5, None)]
    return spark.createDataFrame(out, "key string, t int, a double, b double, n1 double, n2 double, n3 double, y double")


def test_a_tree_takes_the_best_split():
    x = np.array([[0.0, 5], [1, 5], [2, 5], [3, 5], [4, 5]])
    y = np.array([0.0, 0, 0, 9, 9])
    tree = trees.fit_tree(x, y, 1, 1, np.random.default_rng(0))
    assert tree.feature[0] == 0 and tree.threshold[0] == 2.5 and np.allclose(trees.tree_values(tree, x), y)
    assert np.allclose(trees.fit_tree(x, y, 1, 3, np.random.default_rng(0)).value, y.mean())  # too few rows to split
    penalised = trees.fit_tree(x, y, 1, 1, np.random.default_rng(0), l1=1.0, l2=1.0)
    assert penalised.value[0] == pytest.approx(17 / 6) and sorted(penalised.value[1:]) == pytest.approx([0, 17 / 3])


def test_boosted_trees_and_forests_find_what_is_not_linear():
    x, y = planted(400)
    new, truth = planted(400, 9)
    for model in (trees.boosted(x, y, 1, 100, 3, 0.1), trees.forest(x, y, 1, 100, 6)):
        left = ((trees.predicted(model, new) - truth) ** 2).mean() / truth.var()
        assert left < 0.35
        share = trees.importances(model, 5)
        assert share.sum() == pytest.approx(1) and set(np.argsort(-share)[:2]) == {0, 1}
    ridge = selection.fitted("ridge", {"alpha": 1.0}, x, y, 0)(new)
    assert ((ridge - truth) ** 2).mean() / truth.var() > 0.6


@pytest.mark.parametrize("kind", ["boosted", "forest", "penalised"])
def test_attributions_are_the_shapley_values(kind):
    x, y = planted(60)
    if kind == "forest":
        model = trees.forest(x, y, 3, 4, 4, 3)
    else:
        model = trees.boosted(x, y, 3, 4, 4, 0.3, 0.8, 3, 1.0 if kind == "boosted" else 0.6, *((0.0, 0.0) if kind == "boosted" else (0.1, 1.0)))
    base, values = trees.attributions(model, x[:8])
    assert np.allclose(values, trees.plain_attributions(model, x[:8]))
    assert np.allclose(base + values.sum(axis=1), trees.predicted(model, x[:8]))


def test_shadows_confirm_what_was_planted(spark):
    df = frame(spark, rows=400)
    run = lambda d: {(r.key, r.feature, r.iteration): (r.importance, r.shadow, r.hit) for r in selection.shadow_hits(d, "key", "t", NAMES, "y", 20, 30, 4).collect()}
    first = run(df.repartition(2))
    assert first == run(df.repartition(7, "t"))  # the same on any partitioning
    assert {k for k, *_ in first} == {"p", "q"}
    hits = selection.shadow_hits(df, "key", "t", NAMES, "y", 20, 30, 4)
    kinds = {(r.key, r.feature): r["class"] for r in selection.shadow_classes(hits, "key").collect()}
    assert all(kinds[k, f] == "confirmed" for k in "pq" for f in "ab")
    # a column of noise can split what is left of the two by chance, and then does so in every iteration
    noise = [kinds[k, f] for k in "pq" for f in ("n1", "n2", "n3")]
    assert "confirmed" not in noise and noise.count("rejected") >= 5
    assert [selection.binomial_quantile(q, 20) for q in (0.05, 0.95)] == [6, 14] and selection.binomial_quantile(0.5, 0) == 0


def test_interactions_are_built_and_validated(spark):
    df = frame(spark)
    got = selection.validated_interactions(df, "key", "t", [("a", "b", "ab"), ("n1", "n2", "nn"), ("a", "absent", "x")], "y", 10, 30, 4)
    assert {(r.key, r.feature): r.confirmed for r in got.collect()} == {(k, f): f == "IX_ab" for k in "pq" for f in ("IX_ab", "IX_nn")}
    assert selection.validated_interactions(df, "key", "t", [("a", "absent", "x")], "y").count() == 0


def test_stability_ranks_what_was_planted_first(spark):
    scores = selection.subsample_scores(frame(spark, nonlinear=False), "key", "t", NAMES, "y", 5, fast=4, size=15, depth=4)
    got = selection.stability_classes(scores, "key").collect()
    assert {r.key for r in got} == {"p", "q"}
    for key in "pq":
        own = sorted((r for r in got if r.key == key), key=lambda r: -r.score)
        assert {own[0].feature, own[1].feature} == {"a", "b"} and own[0]["class"] == "robust" and own[-1]["class"] == "unstable"
        assert own[0].net == own[1].net == 1 and max(r.importance for r in own) == 1
        assert all(r.score == pytest.approx(0.4 * r.net + 0.3 * r.shadow + 0.3 * r.importance) for r in own)


def history_frame(spark, rows):
    days = [(dt.date(2024, 1, d), i, f, float(s), c, c != "unstable") for d, i, f, s, c in rows]
    return spark.createDataFrame(days, "date date, instrument string, feature string, score double, class string, selected boolean")


def test_history_of_selections(spark):
    h = history_frame(spark, [(1, "x", "f", 1, "robust"), (1, "x", "g", 0, "unstable"), (2, "x", "f", 0, "unstable"), (2, "x", "g", 1, "robust"), (4, "x", "f", 1, "robust"), (4, "x", "h", 1, "moderate"), (3, "y", "f", 1, "robust"), (5, "y", "f", 1, "moderate")])
    assert {(r.date.day, r.instrument, r.feature, r.severity) for r in selection.class_transitions(h).collect()} == {(2, "x", "f", "critical"), (2, "x", "g", "info"), (4, "x", "f", "info"), (5, "y", "f", "warning")}
    assert {(r.instrument, r.feature): r.share for r in selection.persistence(h).collect()} == {("x", "f"): pytest.approx(2 / 3), ("x", "g"): pytest.approx(1 / 3), ("x", "h"): pytest.approx(1 / 3), ("y", "f"): 1.0}
    rolled = selection.rolling_scores(h, 3).collect()
    assert {(r.instrument, r.feature, r.date.day, r["class"]) for r in rolled} == {("x", "f", 4, "robust"), ("x", "f", 3, "unknown"), ("x", "f", 5, "unknown"), ("x", "h", 4, "moderate"), ("x", "h", 3, "unknown"), ("x", "h", 5, "unknown"), ("y", "f", 3, "robust"), ("y", "f", 5, "moderate"), ("y", "f", 4, "unknown")}
    new = history_frame(spark, [(5, "z", "f", 9, "robust"), (6, "x", "f", 9, "robust")])
    kept = selection.save_snapshot(h, new, 3).collect()
    assert {(r.date.day, r.instrument) for r in kept} == {(4, "x"), (5, "z"), (6, "x")}
    assert {(r.instrument, r.date.day): r.pct_robust for r in selection.class_counts(h).collect()}[("x", 1)] == 50
    none = h.where("false")
    assert selection.class_transitions(none).count() == selection.persistence(none).count() == selection.rolling_scores(none).count() == 0


def test_purged_search_prefers_trees_where_nothing_is_linear(spark):
    settings = (("ridge", {"alpha": 1.0}), ("ridge", {"alpha": 50.0}), ("boosted", dict(trees=40, depth=3, rate=0.1, share=0.8)), ("forest", dict(trees=20, depth=4)))
    scores = selection.purged_scores(frame(spark), "key", "t", NAMES, "y", settings)
    folds = {(r.key, r.fold, r.n_train, r.n_test) for r in scores.collect()}
    assert folds == {(k, f, f * 32 - 3, 32) for k in "pq" for f in range(1, 5)}
    best = {(r.key, r.model): r for r in selection.best_settings(scores, "key").collect()}
    assert all(best[k, "boosted"].r2 > best[k, "ridge"].r2 + 0.2 for k in "pq") and {best[k, "boosted"].setting for k in "pq"} == {2}
    # rows after a fold, and in the gap before it, are not trained on
    df = frame(spark).where("t < 900")
    third = scores.where("fold = 2 and setting = 0").orderBy("key").collect()
    moved = df.withColumn("y", F.when((F.col("t") >= 96) | F.col("t").between(61, 63), F.lit(1e6)).otherwise(F.col("y")))
    again = selection.purged_scores(moved, "key", "t", NAMES, "y", settings).where("fold = 2 and setting = 0").orderBy("key").collect()
    assert [r.r2 for r in third] == pytest.approx([r.r2 for r in again])


def test_forecasts_of_all_models(spark):
    df = frame(spark, nonlinear=False).where("t < 900")
    got = {(r.key, r.model): r.prediction for r in selection.forecasts(df, "key", "t", NAMES, "y").collect()}
    assert {m for _, m in got} == set(selection.USUAL) and {k for k, _ in got} == {"p", "q"}
    x, y = planted(160, 1, False)
    assert all(abs(got["p", m] - (2 * x[-1, 0] - x[-1, 1])) < 1.5 for m in selection.USUAL)
    # the last row's own target and later settings do not matter
    other = df.withColumn("y", F.when(F.col("t") == 159, F.lit(None).cast("double")).otherwise(F.col("y")))
    assert got == {(r.key, r.model): r.prediction for r in selection.forecasts(other, "key", "t", NAMES, "y").collect()}
    predictions = spark.createDataFrame([("p", "ridge", 1.0), ("p", "forest", 3.0)], "key string, model string, prediction double")
    weights = spark.createDataFrame([("p", "ridge", 0.5)], "key string, model string, weight double")
    assert selection.ensemble_forecast(predictions, weights, "key").collect()[0].prediction == 1.25


def test_attributions_by_key(spark):
    got = selection.tree_attributions(frame(spark), "key", "t", NAMES, "y").collect()
    assert {r.key for r in got} == {"p", "q"} and {r.feature for r in got if r["rank"] <= 2} == {"a", "b"}
    assert all(sorted(r["rank"] for r in got if r.key == k) == [1, 2, 3, 4, 5] for k in "pq")
