"""Forward paper trading: decisions, realizations, monitoring and one-shot verdicts.

Every step is a set of rows computed for all months and strategies at once: a
decision for a month looks only at rows up to the month before, so replaying a
history and ticking through it give the same table. A ledger keeps the rows
append-only; what is there is never changed.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar, series, statistics
from . import joins, risk


class DataRevisionError(ValueError):
    """A row with the same key but other content is in the ledger."""


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def strategy_hash(spec: dict) -> str:
    return hashlib.sha256(canonical_json(spec).encode()).hexdigest()[:16]


def record_sha(*columns: Column | str) -> Column:
    """SHA-256 over the JSON of the columns; numbers should be rounded first, as their texts differ between engines."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def turnover_cost(held: Column, before: Column, bps: float) -> Column:
    return F.abs(held - before) * (bps / 1e4)


def decisions(signals: DataFrame, key: str, month: str, signal: str, least: int = 12, clip: float = 2.0, halted: Column | None = None, forward_start=None) -> DataFrame:
    """(key, month, frozen_position, live_position, signal, signal_z, data_month): the position that each month earns, from the signal of the month before.

    ``halted`` zeroes the live position only; months up to ``forward_start`` are in sample and make no row.
    """
    w = Window.partitionBy(key).orderBy(month)
    known = signals.where(F.col(signal).isNotNull()).select(key, F.last_day(month).alias("data_month"), F.col(signal).alias("signal"), *([halted.alias("_halted")] if halted is not None else [F.lit(False).alias("_halted")]))
    w = Window.partitionBy(key).orderBy("data_month")
    rows = known.withColumn("frozen_position", series.causal_position("signal", w, least, clip)).withColumn("signal_z", series.zscore("signal", w, None, least))
    rows = rows.where("frozen_position is not null").withColumn("month", calendar.next_month_end("data_month"))
    if forward_start is not None:
        rows = rows.where(F.col("month") > F.last_day(F.lit(forward_start).cast("date")))
    return rows.select(key, "month", "frozen_position", F.when(F.col("_halted"), 0.0).otherwise(F.col("frozen_position")).alias("live_position"), "signal", "signal_z", "data_month")


def realizations(decided: DataFrame, returns: DataFrame, key: str, asof, cost_bps: float = 2.0, settlement_days: int = 0) -> DataFrame:
    """(key, month, stream, held, previous, realized, sleeve_return) for decided months whose return is final at ``asof`` and whose calendar month before was decided too.

    ``returns`` has (key, month, ret).
    """
    final = returns.where(F.col("ret").isNotNull() & (F.datediff(F.last_day(F.lit(asof).cast("date")), F.last_day("month")) >= settlement_days))
    before = decided.select(key, calendar.next_month_end("month").alias("month"), F.col("frozen_position").alias("_f"), F.col("live_position").alias("_l"))
    rows = decided.join(before, [key, "month"]).join(final.select(key, "month", "ret"), [key, "month"])
    streams = F.array(
        F.struct(F.lit("frozen").alias("stream"), F.col("frozen_position").alias("held"), F.col("_f").alias("previous")),
        F.struct(F.lit("live").alias("stream"), F.col("live_position").alias("held"), F.col("_l").alias("previous")),
    )
    out = rows.select(key, "month", "ret", F.explode(streams).alias("s")).select(key, "month", "s.*", F.col("ret").alias("realized"))
    return out.withColumn("sleeve_return", F.col("held") * F.col("realized") - turnover_cost(F.col("held"), F.col("previous"), cost_bps))


def telemetry(realized: DataFrame, key: str) -> DataFrame:
    """(key, n, cumulative, last, max_drawdown, vol) of each frozen stream."""
    w = Window.partitionBy(key).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    rows = realized.where("stream = 'frozen'").withColumn("_c", F.product(1 + F.col("sleeve_return")).over(w))
    rows = rows.withColumn("_d", F.col("_c") / F.max("_c").over(w) - 1)
    return rows.groupBy(key).agg(F.count("*").alias("n"), (F.max_by("_c", "month") - 1).alias("cumulative"), F.max_by("sleeve_return", "month").alias("last"), F.min("_d").alias("max_drawdown"), F.stddev_samp("sleeve_return").alias("vol"))


def circuit_breaker(realized: DataFrame, key: str, most_drawdown: float = -0.03, months: int = 6) -> DataFrame:
    """(key, drawdown, rolling_sharpe, halted) of each live stream: halted at the drawdown or below, or if the Sharpe ratio of the last months is negative."""
    w = Window.partitionBy(key).orderBy("month")
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = realized.where("stream = 'live'").withColumn("_c", F.product(1 + F.col("sleeve_return")).over(frame))
    rows = rows.withColumn("_d", F.col("_c") / F.max("_c").over(frame) - 1)
    mean, sd = series.rolling(F.avg, "sleeve_return", w, months), series.rolling(F.stddev_samp, "sleeve_return", w, months)
    rows = rows.withColumn("_s", mean / F.when(sd > 0, sd))
    g = rows.groupBy(key).agg(F.min("_d").alias("drawdown"), F.max_by("_s", "month").alias("rolling_sharpe"))
    return g.withColumn("halted", (F.col("drawdown") <= most_drawdown) | F.coalesce(F.col("rolling_sharpe") < 0, F.lit(False)))


def pooled(realized: DataFrame, key: str) -> DataFrame:
    """(month, ret): the mean frozen return over the months that all members share."""
    frozen = realized.where("stream = 'frozen'")
    n = frozen.agg(F.countDistinct(key).alias("_n"))
    g = frozen.groupBy("month").agg(F.countDistinct(key).alias("_k"), F.avg("sleeve_return").alias("ret"))
    return g.crossJoin(F.broadcast(n)).where("_k = _n").select("month", "ret")  # n has one row


def leverage_gate(realized: DataFrame, key: str, requested: float, var_budget: float, es_budget: float, alpha: float = 0.05, least: int = 24) -> DataFrame:
    """(key, n, active, applied, binding): the requested leverage capped by VaR and ES budgets; inactive under ``least`` months."""
    t = risk.tail(realized.where("stream = 'frozen'"), key, "sleeve_return", alpha)
    cap = lambda budget, unit: F.when(F.col(unit) > 0, budget / F.col(unit)).otherwise(float("inf"))
    best = F.array_min(F.array(F.struct(F.lit(requested).alias("v"), F.lit("requested").alias("b")), F.struct(cap(var_budget, "var").alias("v"), F.lit("var").alias("b")), F.struct(cap(es_budget, "es").alias("v"), F.lit("es").alias("b"))))
    active = F.col("n") >= least
    return t.select(key, "n", active.alias("active"), F.when(active, best["v"]).otherwise(requested).alias("applied"), F.when(active, best["b"]).otherwise("inactive").alias("binding"))


def readiness(n: Column, eval_at: Column, booked: Column, consumed: Column) -> Column:
    return F.when(~booked, "UNBOOKED").when(consumed, "SPENT").when(n < eval_at, "ACCRUING").when(n > eval_at, "OVERSHOT").otherwise("READY")


class Ledger:
    """Append-only tables of Parquet under one folder, one for each kind of record.

    One writer at a time. An append reads only the keys and digests that are
    there, by a join; nothing is collected but whether a conflict exists.
    """

    KEYS = {"decisions": ["strategy_hash", "month"], "realizations": ["strategy_hash", "month", "stream"], "bookings": ["strategy_hash"], "bases": ["strategy_hash"], "consumed": ["strategy_hash"], "verdicts": ["strategy_hash"], "operator_decisions": ["strategy_hash", "month"]}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _has(self, kind: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, kind: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{kind}") if self._has(kind) else None

    def append(self, kind: str, rows: DataFrame) -> None:
        """Add the rows whose key is absent; equal rows are left alone, a different row under a known key raises DataRevisionError."""
        keys = self.KEYS[kind]
        content = [c for c in rows.columns if c not in keys]
        new = rows.withColumn("digest", record_sha(*content) if content else F.lit(""))
        old = self.read(kind)
        if old is not None:
            clash = new.join(old.select(*keys, F.col("digest").alias("_old")), keys).where("digest <> _old")
            if clash.limit(1).count():
                raise DataRevisionError(f"{kind}: {clash.select(*keys).first()}")
            new = joins.insert_absent(old, new, keys)
        new.write.mode("append").parquet(f"{self.path}/{kind}")

    def duplicates(self, kind: str) -> DataFrame:
        """Keys that occur more than once, which no append can make: a damaged ledger."""
        return self.read(kind).groupBy(*self.KEYS[kind]).count().where("count > 1")

    def book(self, spec: dict, trials: int, sr_std: float, eval_at: int) -> str:
        """Record a trial and freeze its deflation basis; booking again with other terms raises."""
        if trials < 1 or eval_at < 2:
            raise ValueError("at least one trial and two months")
        h = strategy_hash(spec)
        self.append("bookings", self.spark.createDataFrame([(h, canonical_json(spec))], "strategy_hash string, spec string"))
        self.append("bases", self.spark.createDataFrame([(h, trials, sr_std, eval_at)], "strategy_hash string, n_trials int, sr_std double, eval_at_n int"))
        return h

    def verdict(self, spec: dict, least_dsr: float = 0.95) -> dict:
        """Score the frozen stream exactly once, see ``score``."""
        h = strategy_hash(spec)
        rows = self.read("realizations")
        return self.score(h, None if rows is None else rows.where((F.col("strategy_hash") == h) & (F.col("stream") == "frozen")), least_dsr)

    def score(self, h: str, stream: DataFrame | None, least_dsr: float, least_deviation: float = 0.0) -> dict:
        """Score a stream (strategy_hash, sleeve_return) under the hash ``h`` exactly once.

        A strategy with a recorded verdict gets that one. Else the basis must
        be there and the stream must have exactly the agreed length; its
        consumption is written before anything is scored, so a failure in
        between spends the trial. A stream that varies by ``least_deviation`` or less does not pass.
        """
        own = lambda kind: None if (t := self.read(kind)) is None else t.where(F.col("strategy_hash") == h)
        if (v := own("verdicts")) is not None and (row := v.first()):
            return row.asDict()
        basis = b.first() if (b := own("bases")) is not None else None
        if basis is None:
            raise PermissionError("no deflation basis is booked")
        if (c := own("consumed")) is not None and c.limit(1).count():
            raise PermissionError("the trial is spent")
        size = stream.agg(F.count("*").alias("n"), F.stddev_samp("sleeve_return").alias("sd")).first() if stream is not None else None
        n = size["n"] if size else 0
        if n != basis["eval_at_n"]:
            raise PermissionError(f"{n} months, {basis['eval_at_n']} agreed")
        self.append("consumed", self.spark.createDataFrame([(h, n)], "strategy_hash string, n int"))
        s = statistics.sharpe_statistics(stream, "strategy_hash", "sleeve_return", basis["n_trials"], basis["sr_std"]).first()
        varied = size["sd"] is not None and size["sd"] > least_deviation
        passed = varied and s["dsr"] is not None and s["dsr"] >= least_dsr and (s["sharpe"] or 0.0) > 0
        self.append("verdicts", self.spark.createDataFrame([(h, n, s["sharpe"], s["psr"], s["dsr"], bool(passed))], "strategy_hash string, n int, sharpe double, psr double, dsr double, passed boolean"))
        return self.read("verdicts").where(F.col("strategy_hash") == h).first().asDict()
