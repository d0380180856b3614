"""Model runs, alerts and repository queries: latest rows, upserts, comparisons of a run with the one before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins

ALERT = "run_id long, kind string, severity string, subject string, detail double"


def latest(df: DataFrame, by: list[str], order: list[str], n: int = 1, where: Column | None = None) -> DataFrame:
    """The last ``n`` rows of each ``by`` (of all, with none) by ``order``. Spark keeps at most n rows a group and task before the shuffle."""
    df = df if where is None else df.where(where)
    if not by:
        return df.orderBy(*(F.col(c).desc() for c in order)).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def upsert_latest(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return joins.upsert(table, new, keys)


def deactivate(table: DataFrame, where: Column, flag: str = "is_active") -> DataFrame:
    """The table as it is after an update that clears a flag."""
    return table.withColumn(flag, F.col(flag) & ~F.coalesce(where, F.lit(False)))


def with_previous(runs: DataFrame, columns: list[str], by: str = "strategy", order: str = "completed_at") -> DataFrame:
    """Completed runs with the ``columns`` of the completed run before."""
    w = Window.partitionBy(by).orderBy(order)
    done = runs.where("status = 'completed'")
    return done.select("*", *(F.lag(c).over(w).alias(f"previous_{c}") for c in columns))


def _alert(rows: DataFrame, when: Column, kind: str, severity: Column, subject: Column, detail: Column) -> DataFrame:
    return rows.where(F.coalesce(when, F.lit(False))).select("run_id", F.lit(kind).alias("kind"), severity.alias("severity"), subject.alias("subject"), detail.cast("double").alias("detail"))


def run_alerts(runs: DataFrame) -> DataFrame:
    """Regime, score and drawdown alerts of runs (run_id, strategy, completed_at, status, regime, p_stress, score, max_drawdown in percent)."""
    r = with_previous(runs, ["regime", "p_stress", "score"])
    none = F.lit(None).cast("string")
    stress, move = F.col("p_stress") - F.col("previous_p_stress"), F.col("score") - F.col("previous_score")
    turned = (F.signum("score") * F.signum("previous_score")) < 0
    dd = F.col("max_drawdown")
    parts = [
        _alert(r, F.col("regime") != F.col("previous_regime"), "regime_change", F.lit("warning"), F.col("regime"), stress),
        _alert(r, (stress > 0.15) & (F.col("regime") == F.col("previous_regime")), "stress_rise", F.lit("warning"), F.col("regime"), stress),
        _alert(r, F.abs(move) > 1, "score_change", F.when(F.abs(move) > 2, "warning").otherwise("info"), none, move),
        _alert(r, turned, "direction_reversal", F.lit("warning"), none, move),
        _alert(r, dd < -10, "drawdown", F.when(dd < -15, "critical").otherwise("warning"), none, dd),
    ]
    return reduce(DataFrame.unionByName, parts)


def importance_alerts(shares: DataFrame, runs: DataFrame) -> DataFrame:
    """Alerts on shares of importance (run_id, feature, share): one that crosses 20 %, one that moves over 15 points, a new first."""
    order = with_previous(runs, ["run_id"]).select("run_id", F.col("previous_run_id").alias("_before"))
    first = Window.partitionBy("run_id").orderBy(F.col("share").desc(), "feature")
    ranked = shares.withColumn("rank", F.row_number().over(first))
    before = ranked.select(F.col("run_id").alias("_before"), "feature", F.col("share").alias("_share"), F.col("rank").alias("_rank"))
    r = ranked.join(order, "run_id").where("_before is not null").join(before, ["_before", "feature"], "left").withColumn("_share", F.coalesce("_share", F.lit(0.0)))
    move = F.col("share") - F.col("_share")
    parts = [
        _alert(r, (F.col("share") >= 0.2) != (F.col("_share") >= 0.2), "importance_crossing", F.lit("info"), F.col("feature"), move),
        _alert(r, F.abs(move) > 0.15, "importance_shift", F.lit("warning"), F.col("feature"), move),
        _alert(r, (F.col("rank") == 1) & F.coalesce(F.col("_rank") != 1, F.lit(True)), "importance_first", F.lit("info"), F.col("feature"), move),
    ]
    return reduce(DataFrame.unionByName, parts)


def weight_alerts(weights: DataFrame, runs: DataFrame) -> DataFrame:
    """Alerts on weights (run_id, instrument, weight, mu): moves over 0.10, gross over 2.0, weights against their expected return."""
    order = with_previous(runs, ["run_id"]).select("run_id", F.col("previous_run_id").alias("_before"))
    before = weights.select(F.col("run_id").alias("_before"), "instrument", F.col("weight").alias("_weight"))
    r = weights.join(order, "run_id").join(before, ["_before", "instrument"], "left")
    move = F.col("weight") - F.coalesce("_weight", F.lit(0.0))
    gross = weights.groupBy("run_id").agg(F.sum(F.abs("weight")).alias("gross"))
    against = (F.abs("weight") > 0.05) & (((F.col("weight") > 0) & (F.col("mu") < -0.01)) | ((F.col("weight") < 0) & (F.col("mu") > 0.01)))
    parts = [
        _alert(r, F.col("_before").isNotNull() & (F.abs(move) > 0.1), "weight_move", F.when(F.abs(move) > 0.2, "warning").otherwise("info"), F.col("instrument"), move),
        _alert(gross, F.col("gross") > 2, "gross_weight", F.lit("critical"), F.lit(None).cast("string"), F.col("gross")),
        _alert(weights, against, "signal_conflict", F.lit("warning"), F.col("instrument"), F.col("mu")),
    ]
    return reduce(DataFrame.unionByName, parts)


def selection_changes(snapshots: DataFrame) -> DataFrame:
    """(instrument, at, gained, lost, stable, turnover_pct) of feature arrays (instrument, at, features) against the snapshot before."""
    w = Window.partitionBy("instrument").orderBy("at")
    s = snapshots.withColumn("_p", F.lag("features").over(w)).where("_p is not null")
    gained, lost, stable = F.array_except("features", "_p"), F.array_except("_p", "features"), F.array_intersect("features", "_p")
    total = F.size(F.array_union("features", "_p"))
    return s.select("instrument", "at", F.array_sort(gained).alias("gained"), F.array_sort(lost).alias("lost"), F.array_sort(stable).alias("stable"), F.when(total > 0, (F.size(gained) + F.size(lost)) / total * 100).otherwise(0.0).alias("turnover_pct"))


def pnl_summary(daily: DataFrame, asof) -> DataFrame:
    """(book, mtd, ytd, inception, drawdown) at a date, from (book, day, pnl); the drawdown is from the highest running total."""
    day = F.lit(asof).cast("date")
    w = Window.partitionBy("book").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.where(F.col("day") <= day).withColumn("_c", F.sum("pnl").over(w))
    rows = rows.withColumn("_h", F.greatest(F.max("_c").over(w), F.lit(0.0)))
    part = lambda unit: F.sum(F.when(F.col("day") >= F.trunc(day, unit), F.col("pnl")).otherwise(0.0))
    return rows.groupBy("book").agg(part("MM").alias("mtd"), part("YEAR").alias("ytd"), F.sum("pnl").alias("inception"), F.max_by(F.col("_c") - F.col("_h"), "day").alias("drawdown"))


def health(probes: DataFrame, last: int = 100) -> DataFrame:
    """(source, status, uptime_pct, n) from probes (source, at, code, seconds): healthy within 10 s, slower degraded, server errors and 15 s down; over the last probes."""
    ok = F.col("code").isNotNull() & (F.col("code") < 400)
    status = F.when(F.col("code").isNull() | (F.col("code") >= 500) | (F.col("seconds") >= 15), "down").when(~ok | (F.col("seconds") > 10), "degraded").otherwise("healthy")
    rows = latest(probes.withColumn("status", status), ["source"], ["at"], last)
    return rows.groupBy("source").agg(F.max_by("status", "at").alias("status"), (F.avg((F.col("status") != "down").cast("double")) * 100).alias("uptime_pct"), F.count("*").alias("n"))


def backoff_seconds(attempt: Column, jitter: Column) -> Column:
    """Two seconds doubled for each attempt, 30 at most, moved by up to 30 percent; ``jitter`` lies between -1 and 1."""
    return F.least(2 * F.pow(F.lit(2.0), attempt), F.lit(30.0)) * (1 + 0.3 * jitter)
