"""The ledger as known at many cutoffs, in one pass.

A version of an observation is valid from its own knowledge until that of the
next one. ``views`` gives the as-of view of every cutoff of a grid from one scan: versions are
first reduced to the newest of each step of the grid (an aggregation with map-side
combine, so a much-revised observation shuffles at most one row a step), then each of
these is repeated for the cutoffs until the next one. The steps are found by an
equality on days, not by comparing every row with every cutoff.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERSION = ("value", "knowledge_time", "source", "_seq")
#: Most days that a grid may span to be broadcast: 80 years of them, some bytes each.
GRID_DAYS = 30_000


def validity(ledger: DataFrame) -> DataFrame:
    """Every version with valid_from (its knowledge) and valid_until (that of the next version, null for the last); of versions known at one moment the last append counts."""
    one = ledger.groupBy("series_id", "event_time", "knowledge_time").agg(F.max_by(F.struct(*(c for c in VERSION if c != "knowledge_time")), "_seq").alias("v"))
    after = F.lead("knowledge_time").over(Window.partitionBy("series_id", "event_time").orderBy("knowledge_time"))
    return one.select("series_id", "event_time", "v.*", F.col("knowledge_time").alias("valid_from"), after.alias("valid_until"))


def grid(cutoffs: DataFrame) -> DataFrame:
    """(step, cutoff, since): the distinct cutoffs of a one-column table in order, numbered from 1, each with the one before it."""
    one = cutoffs.select(F.col(cutoffs.columns[0]).cast("timestamp_ntz").alias("cutoff")).where("cutoff is not null").distinct()
    w = Window.orderBy("cutoff")  # a dimension: one row for each cutoff
    return one.select(F.row_number().over(w).alias("step"), "cutoff", F.lag("cutoff").over(w).alias("since"))


def _stepped(ledger: DataFrame, steps: DataFrame) -> DataFrame:
    """The versions that some cutoff knows, with the first step that does."""
    edge = steps.agg(F.min("cutoff").alias("_first"), F.max("cutoff").alias("_last"), F.datediff(F.max("cutoff"), F.min("cutoff")).alias("_days")).first()
    if edge is None or edge["_first"] is None:
        return ledger.where("false").withColumn("step", F.lit(1))
    known = ledger.where(F.col("knowledge_time") <= F.lit(edge["_last"]))
    days = F.explode(F.sequence(F.to_date("since"), F.to_date("cutoff")))
    table = steps.where("since is not null").select("step", "cutoff", "since", days.alias("_day"))
    table = F.broadcast(table) if edge["_days"] <= GRID_DAYS else table
    inside = (F.to_date("knowledge_time") == F.col("_day")) & (F.col("knowledge_time") > F.col("since")) & (F.col("knowledge_time") <= F.col("cutoff"))
    # what no later step has is known at the first cutoff
    return known.join(table, inside, "left").select(*ledger.columns, F.coalesce("step", F.lit(1)).alias("step"))


def views(ledger: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(cutoff, series_id, event_time, value, knowledge_time, source, _seq) for every cutoff: what ``as_of_rows`` gives at each of them.

    One scan of the ledger; null cutoffs are ignored and repeated ones count once.
    """
    steps = grid(cutoffs)
    newest = F.max_by(F.struct(*VERSION), F.struct("knowledge_time", "_seq")).alias("v")
    kept = _stepped(ledger, steps).groupBy("series_id", "event_time", "step").agg(newest)
    until = F.lead("step").over(Window.partitionBy("series_id", "event_time").orderBy("step"))
    last = steps.agg(F.max("step").alias("_steps"))
    spans = kept.withColumn("_next", until).crossJoin(F.broadcast(last))  # one row
    each = spans.withColumn("step", F.explode(F.expr("sequence(step, coalesce(_next - 1, _steps))")))
    names = steps.select("step", "cutoff")
    return each.join(names, "step").select("cutoff", "series_id", "event_time", "v.*")


def readings(ledger: DataFrame, cutoffs: DataFrame, transform: Callable, name: str = "reading") -> DataFrame:
    """(cutoff, series_id, event_time, value, ``name``): at each cutoff the last row of every series after a causal transform of the view known then.

    ``transform`` maps a value column and an ordered window, as those of
    ``functions.series`` do. A series that a cutoff does not know yet has no row there.
    """
    by = Window.partitionBy("cutoff", "series_id").orderBy("event_time")
    last = Window.partitionBy("cutoff", "series_id").orderBy(F.desc("event_time"))
    made = views(ledger, cutoffs).withColumn(name, transform(F.col("value"), by)).withColumn("_back", F.row_number().over(last))
    return made.where("_back = 1").select("cutoff", "series_id", "event_time", "value", name)


def spine(ledger: DataFrame, cutoff=None) -> DataFrame:
    """(series_id, event_time, value) that a run reads its series from: as known at ``cutoff``, or with None the newest versions whatever their knowledge."""
    known = ledger if cutoff is None else ledger.where(F.col("knowledge_time") <= F.lit(cutoff).cast("timestamp_ntz"))
    return known.groupBy("series_id", "event_time").agg(F.max_by("value", F.struct("knowledge_time", "_seq")).alias("value"))
