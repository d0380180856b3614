"""The promotion gate as one call: every measure of an overlay and its predictions, and a verdict with its reasons."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series, statistics


class Thresholds(NamedTuple):
    """What an overlay must reach."""

    dsr: float = 0.95
    ic_t: float = 2.0
    carry_neutral_ic: float = 0.02
    beat_carry: bool = True
    worst_fold: float = -0.10
    decay: float = 0.15


class SignalThresholds(NamedTuple):
    """What one signal must reach."""

    carry_neutral_ic: float = 0.05
    second_half: float = 0.03
    decay: float = 0.15
    out_of_sample: float = 0.03
    worst_fold: float = -0.10
    least: int = 40


def instrument_measures(panel: DataFrame, key: str, at: str, predicted: str, realized: str, carry: str, least: int = 12) -> DataFrame:
    """(key, n, ic, carry_neutral_ic, carry_only_ic, fold_mean, fold_least, first, second, drop) over the complete rows of each instrument; all but n are null under ``least`` rows."""
    full = panel.select(key, at, *(series.known(F.col(c).cast("double")).alias(c) for c in (predicted, realized, carry))).dropna()
    n = full.groupBy(key).agg(F.count("*").alias("n"))
    rows = full.join(n.where(F.col("n") >= least).select(key), key, "left_semi")
    ic = lambda d, name: d.select(key, F.col("ic").alias(name))
    parts = [
        ic(statistics.information_coefficient(rows, key, predicted, realized), "ic"),
        ic(statistics.carry_neutral_ic(rows, key, predicted, realized, carry), "carry_neutral_ic"),
        ic(statistics.information_coefficient(rows, key, carry, realized), "carry_only_ic"),
        statistics.combinatorial_ic(rows, key, at, predicted, realized).select(key, F.col("mean").alias("fold_mean"), F.col("least").alias("fold_least")),
        statistics.half_sample_ic(rows, key, at, predicted, realized, carry),
    ]
    out = panel.select(key).distinct().join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    for p in parts:
        out = out.join(p, key, "left")
    return out


def _reasons(checks: list[tuple[Column, str]]) -> Column:
    """The names of the checks that do not hold; one that cannot be told does not hold."""
    return F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name)) for ok, name in checks)))


def promotion_report(panel: DataFrame, overlay: DataFrame, key: str, at: str, predicted: str, realized: str, carry: str, ret: str, trials: int, sr_std: float | None = None, candidates: DataFrame | None = None, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One row: the overlay's and the carry portfolio's Sharpe ratios, the instruments' measures together, the probability of overfitting, passed and reasons.

    ``panel`` has a row for each instrument and time, whose prediction and carry are for its outcome; ``overlay`` the
    (at, ret) to be promoted; ``candidates`` (trial, at, ret) gives the probability of overfitting, which is told and not judged.
    """
    one = lambda df: statistics.sharpe_statistics(df.select(F.lit(0).alias("_k"), at, ret), "_k", ret, trials, sr_std)
    own = one(overlay).select(F.col("n").alias("overlay_n"), F.col("sharpe_annual").alias("overlay_sharpe"), F.col("psr").alias("overlay_psr"), F.col("dsr").alias("overlay_dsr"))
    carried = statistics.carry_portfolio(panel, at, carry, realized).withColumnRenamed("ret", ret)
    carried = statistics.sharpe_statistics(carried.select(F.lit(0).alias("_k"), at, ret), "_k", ret, 1, sr_std).select(F.col("sharpe_annual").alias("carry_sharpe"))
    each = instrument_measures(panel, key, at, predicted, realized, carry)
    known = each.where("carry_neutral_ic is not null")
    # the mean over its HAC error, with the instruments in order of their names in place of times
    t = statistics.newey_west(known.select(F.lit(0).alias("_k"), key, "carry_neutral_ic"), "_k", key, "carry_neutral_ic").where("n >= 3").select(F.col("tstat").alias("carry_neutral_ic_t"))
    median = lambda c: F.percentile(c, F.lit(0.5))
    together = each.agg(
        F.count("carry_neutral_ic").alias("instruments"), F.avg("carry_neutral_ic").alias("carry_neutral_ic"), F.min("fold_least").alias("worst_fold"),
        median("first").alias("first_half"), median("second").alias("second_half"), median("drop").alias("decay"),
    )
    pbo = statistics.overfitting_probability(candidates, "trial", at, ret).select("pbo") if candidates is not None else panel.sparkSession.range(1).select(F.lit(None).cast("double").alias("pbo"))
    row = together
    for part in (own, carried, t, pbo):  # each has one row, or none
        row = row.withColumn("_j", F.lit(0)).join(part.withColumn("_j", F.lit(0)), "_j", "left").drop("_j")
    c = F.col
    checks = [
        (c("overlay_dsr") >= thresholds.dsr, "deflated Sharpe"),
        (c("carry_neutral_ic") >= thresholds.carry_neutral_ic, "carry-neutral IC"),
        (c("carry_neutral_ic_t") >= thresholds.ic_t, "t of carry-neutral IC"),
        (c("overlay_sharpe") > c("carry_sharpe") if thresholds.beat_carry else F.lit(True), "carry portfolio"),
        (c("worst_fold").isNull() | (c("worst_fold") >= thresholds.worst_fold), "worst fold"),
        (c("decay").isNull() | (c("decay") <= thresholds.decay), "decay"),
    ]
    return row.withColumn("reasons", _reasons(checks)).withColumn("passed", F.size("reasons") == 0)


def signal_measures(candidates: DataFrame, at: str, thresholds: SignalThresholds = SignalThresholds()) -> DataFrame:
    """(instrument, feature, n, ic, carry_neutral_ic, first, second, decay, fold_mean, fold_least, passed, reasons) of rows (instrument, feature, at, signal, fwd, carry).

    All candidates are measured together, a pair being a group. A pair whose carry does not vary is measured without it; the
    folds' IC is that of the signal as it stands (its sign fitted on the other folds), whose fit has one coefficient.
    """
    full = candidates.select("instrument", "feature", at, *(series.known(F.col(c).cast("double")).alias(c) for c in ("signal", "fwd", "carry"))).dropna()
    full = full.withColumn("_pair", F.struct("instrument", "feature"))
    w = Window.partitionBy("_pair")
    full = full.withColumn("carry", F.when(F.coalesce(F.stddev_samp("carry").over(w), F.lit(0.0)) > 1e-12, F.col("carry")).otherwise(0.0))
    n = full.groupBy("_pair").agg(F.count("*").alias("n"))
    rows = full.join(n.where(F.col("n") >= thresholds.least).select("_pair"), "_pair", "left_semi")
    oos = _refitted_folds(rows, "_pair", at)
    out = candidates.select(F.struct("instrument", "feature").alias("_pair")).distinct().join(n, "_pair", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    for part in (
        statistics.information_coefficient(rows, "_pair", "signal", "fwd").select("_pair", "ic"),
        statistics.carry_neutral_ic(rows, "_pair", "signal", "fwd", "carry").select("_pair", F.col("ic").alias("carry_neutral_ic")),
        statistics.half_sample_ic(rows, "_pair", at, "signal", "fwd", "carry").withColumnRenamed("drop", "decay"),
        oos,
    ):
        out = out.join(part, "_pair", "left")
    c, t = F.col, thresholds
    checks = [
        (c("n") >= t.least, "too few rows"),
        ((c("n") < t.least) | (c("carry_neutral_ic") >= t.carry_neutral_ic), "carry-neutral IC"),
        ((c("n") < t.least) | (c("second") >= t.second_half), "second half"),
        ((c("n") < t.least) | c("decay").isNull() | (c("decay") <= t.decay), "decay"),
        ((c("n") < t.least) | (c("fold_mean") >= t.out_of_sample), "out of sample"),
        ((c("n") < t.least) | c("fold_least").isNull() | (c("fold_least") >= t.worst_fold), "worst fold"),
    ]
    out = out.withColumn("reasons", _reasons(checks)).withColumn("passed", F.size("reasons") == 0)
    return out.select("_pair.instrument", "_pair.feature", *(x for x in out.columns if x != "_pair"))


def _refitted_folds(rows: DataFrame, pair: str, at: str, groups: int = 6) -> DataFrame:
    """(pair, fold_mean, fold_least): rank IC of each contiguous fold under the slope fitted on the others, from sums of each fold."""
    g = statistics.folds(rows, pair, at, groups, "_fold")
    ic = statistics.information_coefficient(g.withColumn("_part", F.struct(F.col(pair).alias("p"), F.col("_fold").alias("f"))), "_part", "signal", "fwd").select("_part.p", "_part.f", "ic")
    s = g.groupBy(pair, "_fold").agg(F.count("*").alias("n"), F.sum("signal").alias("x"), F.sum("fwd").alias("y"), F.sum(F.col("signal") * F.col("fwd")).alias("xy"))
    w = Window.partitionBy(pair)
    rest = {c: F.sum(c).over(w) - F.col(c) for c in ("n", "x", "y", "xy")}
    slope = s.select(F.col(pair).alias("p"), F.col("_fold").alias("f"), F.signum(rest["xy"] - rest["x"] * rest["y"] / F.nullif(rest["n"], F.lit(0))).alias("sign"))
    # a rank correlation only changes its sign with that of the slope
    both = ic.join(slope, ["p", "f"]).withColumn("v", F.col("ic") * F.col("sign"))
    return both.groupBy(F.col("p").alias(pair)).agg(F.avg("v").alias("fold_mean"), F.min("v").alias("fold_least"))


def rank_signals(candidates: DataFrame, at: str, registered: DataFrame | None = None, thresholds: SignalThresholds = SignalThresholds()) -> DataFrame:
    """The measures of all candidates, best carry-neutral IC first in each instrument (``rank``, null for pairs not tested), with ``hypotheses``, the number tested in all.

    ``registered`` (instrument, feature) names pairs agreed on beforehand; one without rows is there with none, marked absent.
    """
    found = signal_measures(candidates, at, thresholds)
    if registered is not None:
        found = registered.select("instrument", "feature").distinct().join(found, ["instrument", "feature"], "left")
        found = found.withColumn("reasons", F.coalesce("reasons", F.array(F.lit("feature absent")))).withColumns({"n": F.coalesce("n", F.lit(0)), "passed": F.coalesce("passed", F.lit(False))})
    tested = found.agg(F.count_if(F.col("n") >= thresholds.least).alias("hypotheses"))
    w = Window.partitionBy("instrument").orderBy(F.desc_nulls_last("carry_neutral_ic"), "feature")
    ranked = found.withColumn("rank", F.when(F.col("n") >= thresholds.least, F.row_number().over(w)))
    return ranked.crossJoin(F.broadcast(tested))  # one row


def nowcast_surprise(factor: Column | str, w, least: int = 12) -> Column:
    """A factor's distance from its own past and present mean, in deviations; null before ``least`` rows and where it has not varied."""
    return series.zscore(factor, w, None, least)
