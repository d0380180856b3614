"""The append-only bitemporal observation ledger and its point-in-time views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_rows(ledger: DataFrame, cutoff) -> DataFrame:
    """The newest version of every (series_id, event_time) that was known at ``cutoff``; ties go to the later append.

    One hash aggregation with map-side combine: ``max_by`` keeps a single
    version per group, so a series with a third of all rows shuffles no more than its groups.
    """
    known = ledger.where(F.col("knowledge_time") <= F.lit(cutoff).cast("timestamp_ntz"))
    newest = F.max_by(F.struct("value", "knowledge_time", "source", "_seq"), F.struct("knowledge_time", "_seq"))
    return known.groupBy("series_id", "event_time").agg(newest.alias("r")).select("series_id", "event_time", "r.*")


def as_of_wide(ledger: DataFrame, cutoff, series: list[str]) -> DataFrame:
    """One row per event_time, one column per named series, as known at ``cutoff``."""
    return as_of_rows(ledger, cutoff).groupBy("event_time").pivot("series_id", series).agg(F.first("value"))


def freshness(ledger: DataFrame, cutoff) -> DataFrame:
    """Per series: last event, last knowledge time and versions known at ``cutoff``, and whole days since the last knowledge."""
    known = ledger.where(F.col("knowledge_time") <= F.lit(cutoff).cast("timestamp_ntz"))
    out = known.groupBy("series_id").agg(F.max("event_time").alias("last_event"), F.max("knowledge_time").alias("last_known"), F.count("*").alias("n_versions"))
    return out.withColumn("age_days", F.datediff(F.lit(cutoff).cast("timestamp_ntz"), "last_known"))


def revisions(ledger: DataFrame) -> DataFrame:
    """Every version of an observation with its ordinal and its change from the version before."""
    w = Window.partitionBy("series_id", "event_time").orderBy("knowledge_time", "_seq")
    return ledger.select("series_id", "event_time", "knowledge_time", "_seq", "value", F.row_number().over(w).alias("version"), (F.col("value") - F.lag("value").over(w)).alias("change"))


LEDGER = "series_id string, event_time timestamp_ntz, knowledge_time timestamp_ntz, value double, source string, vintage_id string, ingest_run_id string, source_url string, source_hash string, _seq bigint"


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def observations(series: DataFrame, lag_days, publish_time=None) -> DataFrame:
    """Ledger rows, without _seq, from (series_id, event_time, value, source); missing values make no row."""
    from .functions.calendar import knowledge_time

    rows = series.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    return rows.withColumn("knowledge_time", knowledge_time("event_time", lag_days, publish_time))


def append(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger with new rows, numbered from its last _seq on by day of knowledge, series, knowledge and event; nothing is ever changed.

    The numbers follow from the rows alone, not from where Spark keeps them, so a task that runs again gives the same ones: a row's
    number is what the days before have, what the day's series before have, and its place in its own day and series.
    The numbering has one writer: call it from one place at a time.
    """
    from pyspark.sql.types import _parse_datatype_string

    top = ledger.agg(F.coalesce(F.max("_seq"), F.lit(-1))).first()[0]
    have = {f.name: f.dataType for f in _parse_datatype_string(LEDGER).fields if f.name != "_seq"}
    full = rows.select(*(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in have.items()))
    full = full.withColumns({"_day": F.coalesce(F.to_date("knowledge_time"), F.lit("0001-01-01").cast("date")), "_series": F.coalesce("series_id", F.lit(""))})
    place = F.row_number().over(Window.partitionBy("_day", "_series").orderBy("knowledge_time", "event_time", *(c for c in have if c not in ("knowledge_time", "event_time"))))
    counts = full.groupBy("_day", "_series").agg(F.count("*").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = counts.groupBy("_day").agg(F.sum("_n").alias("_n")).select("_day", before(Window.orderBy("_day")).alias("_earlier"))  # a row for each day
    counts = counts.withColumn("_before", before(Window.partitionBy("_day").orderBy("_series"))).drop("_n").join(days, "_day")
    numbered = full.withColumn("_row", place).join(counts, ["_day", "_series"])
    return ledger.unionByName(numbered.withColumn("_seq", top + F.col("_earlier") + F.col("_before") + F.col("_row")).select(*have, "_seq"))


def save(ledger: DataFrame, path: str) -> None:
    """Write a ledger as Parquet, a folder for each series, each with the files of one task."""
    ledger.repartition("series_id").write.partitionBy("series_id").mode("errorifexists").parquet(path)


def load(spark, path: str) -> DataFrame:
    """A saved ledger. A filter on the series reads its folder only."""
    from pyspark.sql.types import _parse_datatype_string

    return spark.read.schema(LEDGER).parquet(path).select(*(f.name for f in _parse_datatype_string(LEDGER).fields))


def as_of_series(ledger: DataFrame, cutoff, series_id: str) -> DataFrame:
    """(event_time, value) of one series as known at ``cutoff``."""
    return as_of_rows(ledger.where(F.col("series_id") == series_id), cutoff).select("event_time", "value").orderBy("event_time")


def validate(rows: DataFrame) -> DataFrame:
    """``rows`` (value, valid_min, valid_max) with an array of violations; the bounds are inclusive and may be null."""
    v = F.col("value")
    found = F.array(
        F.when(v.isNull() | F.isnan(v), "missing"),
        F.when(v < F.col("valid_min"), "below minimum"),
        F.when(v > F.col("valid_max"), "above maximum"),
    )
    return rows.withColumn("violations", F.array_compact(found))


def ingest(ledger: DataFrame, rows: DataFrame, contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger with the valid rows, quarantined rows with their violations); a series without contract is quarantined."""
    named = rows.join(contracts.select("series_id", "valid_min", "valid_max", F.lit(True).alias("_known")), "series_id", "left")
    checked = validate(named).withColumn("violations", F.when(F.col("_known").isNull(), F.array(F.lit("no contract"))).otherwise(F.col("violations")))
    good = checked.where(F.size("violations") == 0).select(*rows.columns)
    return append(ledger, good), checked.where(F.size("violations") > 0).select(*rows.columns, "violations")


def triple_barrier(prices: DataFrame, w, at: str, price: str, vol: str, most: int, up: float = 1.0, down: float = 1.0) -> DataFrame:
    """``prices`` with label, t1 and ret: +1 or -1 for the barrier (price times 1 ± k vol) that is touched first in the next ``most`` rows, at t1, else 0 at the last of them; ret is the change of price until t1. A row without a row after it has no label and goes."""
    ahead = F.collect_list(F.struct(F.col(at).alias("at"), F.col(price).alias("price"))).over(w.rowsBetween(1, most))
    side = lambda x: F.when(x["price"] >= F.col(price) * (1 + up * F.col(vol)), 1).when(x["price"] <= F.col(price) * (1 - down * F.col(vol)), -1)
    rows = prices.withColumn("_ahead", ahead).where(F.size("_ahead") > 0)
    rows = rows.withColumn("_hit", F.get(F.filter("_ahead", lambda x: side(x).isNotNull()), F.lit(0)))
    end = F.coalesce("_hit", F.element_at("_ahead", -1))
    label = F.coalesce(side(F.col("_hit")), F.lit(0))
    return rows.withColumns({"label": label, "t1": end["at"], "ret": end["price"] / F.col(price) - 1}).drop("_ahead", "_hit")
