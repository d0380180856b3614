"""Forward paper beside the frozen stream: the months an operator decided, sized against flat arms, and pools of members scored once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, series, statistics
from . import intelligence, ledger, risk
from .ledger import Ledger, strategy_hash

#: Bounds of a sized position, and the rows before an interval and a confidence exist.
LOW, HIGH, LEAST = 0.25, 1.0, 12
#: Deviation under which a stream is no sample of anything.
FLAT = 1e-9


def operator_realizations(decided: DataFrame, operator: DataFrame, returns: DataFrame, key: str, asof, cost_bps: float = 2.0, settlement_days: int = 0) -> DataFrame:
    """(key, month, stream, held, previous, realized, sleeve_return) of the months that an operator (key, month, operator_position) decided, that have a decision of the strategy too, and whose return is final at ``asof``.

    The month before counts as held where the operator decided it, else as flat, so a first month pays for its entry. The frozen and
    live streams are not looked at.
    """
    final = returns.where(F.col("ret").isNotNull() & (F.datediff(F.last_day(F.lit(asof).cast("date")), F.last_day("month")) >= settlement_days))
    before = operator.select(key, calendar.next_month_end("month").alias("month"), F.col("operator_position").alias("_before"))
    rows = operator.join(decided.select(key, "month").distinct(), [key, "month"], "left_semi").join(before, [key, "month"], "left").join(final.select(key, "month", F.col("ret").alias("realized")), [key, "month"])
    rows = rows.select(key, "month", F.lit("operator").alias("stream"), F.col("operator_position").alias("held"), F.coalesce("_before", F.lit(0.0)).alias("previous"), "realized")
    return rows.withColumn("sleeve_return", F.col("held") * F.col("realized") - ledger.turnover_cost(F.col("held"), F.col("previous"), cost_bps))


def decide(book: Ledger, decisions: DataFrame) -> None:
    """Commit an operator's decisions (strategy_hash, month, action, proposed_position, operator_position): the same again changes nothing, another choice for a month raises DataRevisionError."""
    book.append("operator_decisions", decisions.select("strategy_hash", "month", "action", "proposed_position", "operator_position"))


def sized_returns(frozen: DataFrame, key: str, alpha: float = 0.1) -> DataFrame:
    """(key, month, flat, confidence, sized) of frozen rows (key, month, held, realized, sleeve_return).

    The outcome's guess is the mean of those before; the confidence of its interval scales the position between ``LOW`` and ``HIGH``.
    Where the confidence is not there yet, the flat return counts. Every row looks at itself and earlier ones only.
    """
    w = Window.partitionBy(key).orderBy("month")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = frozen.select(key, "month", "held", "realized", F.col("sleeve_return").alias("flat")).withColumn("_error", F.col("realized") - F.avg("realized").over(past))
    rows = rows.withColumn("_width", intelligence.conformal_width(F.col("_error"), w, alpha, LEAST))
    rows = rows.withColumn("confidence", intelligence.interval_confidence("_width", w, LEAST))
    rows = rows.withColumn("_scaled", intelligence.confidence_scaled(F.col("held"), F.col("confidence"), w, LOW, HIGH))
    sized = F.when(F.col("held") == 0, 0.0).when(F.col("_scaled").isNull(), F.col("flat")).otherwise(F.col("_scaled") * F.col("realized"))
    return rows.select(key, "month", "flat", "confidence", F.when(F.col("realized").isNotNull(), sized).alias("sized"))


def sizing_trial(sized: DataFrame, key: str, trials: int, sr_std: float | None = None, margin: float = 0.05) -> DataFrame:
    """(key, flat_dsr, sized_dsr, flat_sharpe, sized_sharpe, met): both arms under one deflation basis, and whether the sized one beats the flat one by the margin."""
    from .ensembles import criterion_met

    arm = lambda c: statistics.sharpe_statistics(sized.select(key, F.col(c).alias("_v")).where("_v is not null"), key, "_v", trials, sr_std).select(key, F.col("dsr").alias(f"{c}_dsr"), F.col("sharpe_annual").alias(f"{c}_sharpe"))
    both = arm("flat").join(arm("sized"), key)
    return both.withColumn("met", criterion_met(*(F.col(c) for c in ("flat_dsr", "sized_dsr", "flat_sharpe", "sized_sharpe")), margin))


def pool_spec(members: list[dict]) -> dict:
    """What a pool of members is, whatever their order; its hash is the pool's."""
    return {"kind": "pool", "members": sorted(strategy_hash(m) for m in members), "weights": "equal"}


def pool_verdict(book: Ledger, members: list[dict], least_dsr: float = 0.95) -> dict:
    """Score the pool's equally weighted frozen returns over the months of all members exactly once.

    As for a single strategy: a verdict there is comes back; else a booked basis is needed, the shared months must be
    as many as agreed, and the trial is consumed before anything is scored. A stream that hardly varies fails.
    """
    spec = pool_spec(members)
    rows = book.read("realizations")
    own = None if rows is None else rows.where(F.col("strategy_hash").isin(spec["members"]) & (F.col("stream") == "frozen"))
    shared = None
    if own is not None:
        have = own.select("strategy_hash").distinct().count()
        months = own.groupBy("month").agg(F.countDistinct("strategy_hash").alias("_k"), F.avg("sleeve_return").alias("sleeve_return"))
        shared = months.where((F.col("_k") == len(spec["members"])) & F.lit(have == len(spec["members"]))).select(F.lit(strategy_hash(spec)).alias("strategy_hash"), "month", "sleeve_return")
    return book.score(strategy_hash(spec), shared, least_dsr, FLAT)


def leverage_by_budget(realized: DataFrame, key: str, budget: float, alpha: float = 0.05) -> DataFrame:
    """(key, unit, most): the loss of one unit at ``alpha`` and the leverage that keeps it within ``budget``; without a loss there is no bound."""
    t = risk.tail(realized.where("stream = 'frozen'"), key, "sleeve_return", alpha)
    return t.select(key, F.col("var").alias("unit"), F.when(F.col("var") > 0, budget / F.col("var")).alias("most"))


def execution_drag(flows: DataFrame, key: str, at: str, weight: str, cost_bps: float) -> DataFrame:
    """(key, drag, turnover): what the changes of weights cost a year of twelve periods, and how much is turned over a period; the first row is an entry from flat."""
    w = Window.partitionBy(key).orderBy(at)
    move = F.abs(series.known(weight) - F.coalesce(F.lag(weight).over(w), F.lit(0.0)))
    return flows.withColumn("_m", move).groupBy(key).agg((F.avg("_m") * 12 * cost_bps / 1e4).alias("drag"), F.avg("_m").alias("turnover"))
