"""Queries of feature selection, its history, and models of trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensembles, selection
from ..session import table
from .base import RETURNS_SQL, monthly, r, signals, sql_r, timeline

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


# snapshots: a day's events of one kind are an instrument's snapshot, every eighth user is a feature, its mean value the score


def history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("instrument"), F.concat(F.lit("u"), F.col("user_id") % 8).alias("feature"), "value")
    h = e.groupBy("date", "instrument", "feature").agg(F.round(F.avg("value"), 6).alias("score"))
    h = selection.classified(h, ["date", "instrument"], "score")
    return h.withColumn("selected", F.col("class") != "unstable")


HISTORY_SQL = """SELECT h.date, h.instrument, feature, score, robust_from, moderate_from, CASE WHEN score >= robust_from THEN 'robust' WHEN score >= moderate_from THEN 'moderate' ELSE 'unstable' END AS class, score >= moderate_from AS selected FROM (
  SELECT ts::DATE AS date, event_type AS instrument, 'u' || (user_id % 8) AS feature, round(avg(value), 6) AS score FROM events GROUP BY ALL) h JOIN (
  SELECT date, instrument, CASE WHEN q[1] - q[2] < 0.05 THEN q[3] ELSE q[1] END AS robust_from, CASE WHEN q[1] - q[2] < 0.05 THEN q[4] ELSE q[2] END AS moderate_from FROM (
   SELECT date, instrument, quantile_cont(score, [0.75, 0.4, 0.7, 0.35]) AS q FROM (SELECT ts::DATE AS date, event_type AS instrument, 'u' || (user_id % 8) AS feature, round(avg(value), 6) AS score FROM events GROUP BY ALL) GROUP BY 1, 2)) p
  ON h.date = p.date AND h.instrument = p.instrument"""


@query(f"SELECT date, instrument, feature, class, {sql_r('score', 'score')} FROM ({HISTORY_SQL}) WHERE date IN (SELECT DISTINCT ts::DATE FROM events ORDER BY 1 DESC LIMIT 20)")
def selection_snapshots(spark, sf_dir):
    """The last days come again as a snapshot, changed back from what the history had."""
    h = history(spark, sf_dir)
    old = h.withColumn("score", F.when(F.dayofmonth("date") >= 15, -1.0).otherwise(F.col("score")))
    s = selection.save_snapshot(old, h.where(F.dayofmonth("date") >= 15), 20)
    return s.select("date", "instrument", "feature", "class", r("score", "score"))


@query(f"""WITH h AS ({HISTORY_SQL}), d AS (SELECT instrument, date, lag(date) OVER (PARTITION BY instrument ORDER BY date) AS past FROM (SELECT DISTINCT instrument, date FROM h)),
 t AS (SELECT n.date, n.instrument, n.feature, o.class AS before, n.class, CASE WHEN o.class = 'robust' AND n.class = 'unstable' THEN 'critical' WHEN o.class = 'robust' AND n.class = 'moderate' THEN 'warning' WHEN o.class = 'unstable' AND n.class = 'robust' THEN 'info' END AS severity
  FROM h n JOIN d ON d.instrument = n.instrument AND d.date = n.date JOIN h o ON o.instrument = n.instrument AND o.date = d.past AND o.feature = n.feature)
 SELECT * FROM t WHERE severity IS NOT NULL""")
def class_transitions(spark, sf_dir):
    return selection.class_transitions(history(spark, sf_dir))


@query(f"WITH h AS (SELECT * FROM ({HISTORY_SQL}) WHERE selected) SELECT instrument, feature, {sql_r('count(*) / (SELECT count(DISTINCT date) FROM h x WHERE x.instrument = h.instrument)', 'share')} FROM h GROUP BY 1, 2")
def selection_persistence(spark, sf_dir):
    return selection.persistence(history(spark, sf_dir)).select("instrument", "feature", r("share", "share"))


@query(f"""WITH h AS ({HISTORY_SQL}), d AS (SELECT DISTINCT date FROM h ORDER BY 1 DESC LIMIT 12), x AS (SELECT * FROM h WHERE date IN (SELECT date FROM d))
 SELECT f.instrument, f.feature, d.date, {sql_r('coalesce(score, 0)', 'score')}, coalesce(class, 'unknown') AS class FROM (SELECT DISTINCT instrument, feature FROM x) f CROSS JOIN d LEFT JOIN x ON x.instrument = f.instrument AND x.feature = f.feature AND x.date = d.date""")
def rolling_scores(spark, sf_dir):
    return selection.rolling_scores(history(spark, sf_dir)).select("instrument", "feature", "date", r("score", "score"), "class")


@query(f"SELECT instrument, date, count(*) FILTER (class = 'robust') AS robust, count(*) FILTER (class = 'moderate') AS moderate, count(*) FILTER (class = 'unstable') AS unstable, {sql_r(chr(34) + 'robust' + chr(34) + ' / n * 100', 'pct_robust')} FROM (SELECT *, count(*) OVER (PARTITION BY instrument, date) AS n, count(*) FILTER (class = 'robust') OVER (PARTITION BY instrument, date) AS robust FROM ({HISTORY_SQL})) GROUP BY instrument, date, n, \"robust\"")
def class_counts(spark, sf_dir):
    return selection.class_counts(history(spark, sf_dir)).select("instrument", "date", "robust", "moderate", "unstable", r("pct_robust", "pct_robust"))


# models: the months of an order priority are an instrument


def panel(spark, sf_dir):
    """Monthly signals with two more that say nothing, made of digits of the totals."""
    w = timeline()
    digits = monthly(spark, sf_dir).select("key", "month", (F.pmod(F.col("total") * 100, F.lit(101)) / 101).alias("noise"), (F.pmod(F.col("total") * 100, F.lit(37)) / 37).alias("hum"))
    x = signals(spark, sf_dir).join(digits, ["key", "month"])
    return x.withColumn("level", F.avg("ret").over(w.rowsBetween(-2, 0)))


FEATURES = ["ret", "signal", "carry", "level", "noise", "hum"]


@query()
def shadow_selection(spark, sf_dir):
    hits = selection.shadow_hits(panel(spark, sf_dir), "key", "month", FEATURES, "fwd", iterations=20, size=30, depth=4)
    found = selection.shadow_classes(hits, "key")
    return found.select("key", "feature", "iterations", r("hit_rate", "hit_rate"), r("importance", "importance"), "class")


@query()
def shadow_interactions(spark, sf_dir):
    pairs = [("ret", "carry", "ret_x_carry"), ("signal", "level", "signal_x_level"), ("absent", "level", "none")]
    return selection.validated_interactions(panel(spark, sf_dir), "key", "month", pairs, "fwd", iterations=10, size=20, depth=4)


@query(f"""WITH x AS (SELECT key, month, ret, n, ret * 0 AS z FROM ({RETURNS_SQL}) WHERE ret IS NOT NULL), s AS (SELECT key, stddev_samp(ret) + 1e-10 AS sr, stddev_samp(ln(n)) + 1e-10 AS sn, avg(ret) AS mr, avg(ln(n)) AS mn FROM x GROUP BY 1)
 SELECT key, month, {sql_r('(ret - mr) / sr * (ln(n) - mn) / sn', 'product')} FROM x JOIN s USING (key)""")
def interaction_terms(spark, sf_dir):
    x = signals(spark, sf_dir).where("ret is not null").select("key", "month", "ret", "carry")
    wide, names = selection.interactions(x, "key", [("ret", "carry", "ret_x_carry")])
    return wide.select("key", "month", r(names[0], "product"))


@query()
def stability_selection(spark, sf_dir):
    scores = selection.subsample_scores(panel(spark, sf_dir), "key", "month", FEATURES, "fwd", subsamples=6, fast=3, size=15, depth=3)
    found = selection.stability_classes(scores, "key")
    return found.select("key", "feature", "subsamples", *(r(c, c) for c in ("net", "shadow", "importance", "score")), "class")


@query(f"""WITH x AS (SELECT key, month, ret, lag(ret) OVER w AS signal, lead(ret) OVER w AS fwd, avg(ret) OVER (PARTITION BY key ORDER BY month ROWS 2 PRECEDING) AS level FROM ({RETURNS_SQL}) WINDOW w AS (PARTITION BY key ORDER BY month)),
 n AS (SELECT key, count(*) // 5 AS size, count(*) AS n FROM x WHERE ret IS NOT NULL AND signal IS NOT NULL AND fwd IS NOT NULL AND level IS NOT NULL GROUP BY 1)
 SELECT key, fold::INT AS fold, (fold * size - 3)::INT AS n_train, size::INT AS n_test FROM n CROSS JOIN range(5) t(fold) WHERE size >= 12 AND fold * size - 3 >= 24""")
def purged_folds(spark, sf_dir):
    scores = selection.purged_scores(panel(spark, sf_dir), "key", "month", ["ret", "signal", "level"], "fwd", selection.RIDGE[:1])
    return scores.select("key", "fold", "n_train", "n_test")


SEARCHED = selection.RIDGE[::2] + tuple((m, p | {"trees": 20}) for m, p in (selection.BOOSTED[0], selection.BOOSTED[1], selection.FOREST[0], selection.PENALISED[0]))


@query()
def hyperparameter_search(spark, sf_dir):
    scores = selection.purged_scores(panel(spark, sf_dir), "key", "month", FEATURES, "fwd", SEARCHED)
    return selection.best_settings(scores, "key").select("key", "model", "setting", r("r2", "r2"))


@query()
def ensemble_forecasts(spark, sf_dir):
    x = panel(spark, sf_dir)
    best = selection.best_settings(selection.purged_scores(x, "key", "month", FEATURES, "fwd", SEARCHED), "key")
    made = selection.forecasts(x, "key", "month", FEATURES, "fwd", best, SEARCHED)
    past = x.select("key", F.lit("ridge").alias("model"), "month", F.col("signal").alias("f"), F.col("fwd").alias("o"))
    weights = ensembles.ensemble_weights(past, "key", "model", "month", "f", "o")
    return selection.ensemble_forecast(made, weights, "key").select("key", r("prediction", "prediction"))


@query()
def tree_attributions(spark, sf_dir):
    found = selection.tree_attributions(panel(spark, sf_dir), "key", "month", FEATURES, "fwd", dict(trees=30, depth=3, rate=0.05, share=0.8))
    return found.select("key", "feature", r("mean_abs", "mean_abs"), r("current", "current"), "rank")
