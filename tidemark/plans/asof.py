"""Point-in-time queries over the event ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..session import shared_folder, table
from ..sources import payloads

CUTOFF = "2024-01-20 12:00:00"
SERIES = ["click", "signup", "purchase", "view", "error"]
LEDGER_SQL = """SELECT event_type AS series_id, date_trunc('day', ts)::TIMESTAMP AS event_time, ts AS knowledge_time,
 value, 'events' AS source, event_id AS _seq FROM events"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a ledger: type = series, day = event time, timestamp = knowledge time."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("series_id"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("event_time"),
        F.col("ts").cast("timestamp_ntz").alias("knowledge_time"),
        "value",
        F.lit("events").alias("source"),
        F.col("event_id").alias("_seq"),
    )


def asof_long(spark, sf_dir):
    return store.as_of_rows(ledger(spark, sf_dir), CUTOFF)


def asof_wide(spark, sf_dir):
    return store.as_of_wide(ledger(spark, sf_dir), CUTOFF, SERIES)


def ledger_round_trip(spark, sf_dir):
    """The ledger saved by series, loaded again, appended to and read as of the cutoff."""
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    store.save(ledger(spark, sf_dir).select(*(F.col(c) if c in ("series_id", "event_time", "knowledge_time", "value", "source", "_seq") else F.lit(None).cast("string").alias(c) for c in store.empty(spark).columns)), path)
    again = store.load(spark, path)
    return store.as_of_rows(again.where(F.col("series_id").isin("click", "view")), CUTOFF)


def line_quarantine(spark, sf_dir):
    """Every seventeenth line cut short, every thirteenth without its number: what is left of the day's lines, and what was put aside."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.to_json(F.struct(F.when(F.col("event_id") % 13 != 0, F.col("event_id")).alias("k"), F.col("event_type").alias("kind"))).alias("line"))
    e = e.withColumn("line", F.when(F.col("event_id") % 17 == 0, F.expr("substr(line, 1, length(line) - 2)")).otherwise(F.col("line")))
    good, bad = payloads.parsed_lines(e, "k long not null, kind string", "line")
    read = good.select("event_type", F.lit("read").alias("outcome"))
    return read.unionByName(bad.select("event_type", F.col("reason").alias("outcome"))).groupBy("event_type", "outcome").agg(F.count("*").alias("n"))


QUERIES = {"asof_long": asof_long, "asof_wide": asof_wide, "ledger_round_trip": ledger_round_trip, "line_quarantine": line_quarantine}
_LONG = f"""SELECT series_id, event_time, value, knowledge_time, source, _seq FROM (
 SELECT *, row_number() OVER (PARTITION BY series_id, event_time ORDER BY knowledge_time DESC, _seq DESC) AS rn
 FROM ({LEDGER_SQL}) WHERE knowledge_time <= TIMESTAMP '{CUTOFF}') WHERE rn = 1"""
ORACLE = {
    "ledger_round_trip": f"SELECT * FROM ({_LONG}) WHERE series_id IN ('click', 'view')",
    "line_quarantine": "SELECT event_type, CASE WHEN event_id % 17 = 0 THEN 'not readable' WHEN event_id % 13 = 0 THEN 'no k' ELSE 'read' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2",
    "asof_long": _LONG,
    "asof_wide": "SELECT event_time, " + ", ".join(f"max(value) FILTER (series_id = '{s}') AS {s}" for s in SERIES) + f" FROM ({_LONG}) GROUP BY event_time",
}
