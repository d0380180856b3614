"""Structured Streaming: the ledger as a stream, windows with late data, and the order state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import execution, joins


def windowed(events: DataFrame, at: str, key: str, value: str, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window_start, key, n, total) by event time; rows later than ``late`` behind the newest are dropped, and state with them."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = events.withWatermark(at, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("window_start"), key, "n", "total")


def once_each(events: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def append_absent(rows: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Append each batch's rows whose keys the Parquet table at ``path`` lacks. A batch that is run again after a failure adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        new = joins.insert_absent(spark.read.parquet(path), batch, keys) if there else joins.keep_last(batch, keys, keys)
        new.write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def order_states(events: DataFrame) -> DataFrame:
    """(order_id, moves) for every order of a stream of events (order_id, seq, target, qty, fill_qty, fill_price), in update mode: ``moves`` has (seq, state, filled, avg_price, legal) for each of the order's events so far, by ``seq``. ``moves_of`` makes rows of them.

    A move that the state machine does not allow leaves the state as it is
    and is marked. An order's events are its state, so events that come late fall into place; the work is in SQL
    expressions, since a Python call for each order costs milliseconds.
    """
    event = F.struct(F.col("seq").isNull().alias("last"), F.col("seq").cast("long").alias("seq"), "target", *(F.col(c).cast("double").alias(c) for c in ("qty", "fill_qty", "fill_price")))
    move = "struct<seq: long, state: string, filled: double, avg_price: double, legal: boolean>"

    def step(now: Column, e: Column) -> Column:
        legal = execution.can_transition(now["state"], e["target"])
        fills = F.coalesce(legal & (e["fill_qty"] > 0) & ~F.isnan(e["fill_qty"]), F.lit(False))
        state = F.when(legal, e["target"]).otherwise(now["state"])
        total = now["filled"] + e["fill_qty"]
        price = F.when(fills, (now["price"] * now["filled"] + e["fill_price"] * e["fill_qty"]) / total).otherwise(now["price"])
        filled = F.when(fills, F.least(total, e["qty"])).otherwise(now["filled"])
        return F.struct(state.alias("state"), filled.alias("filled"), price.alias("price"), legal.alias("legal"), e["seq"].alias("seq"))

    def grow(now: Column, e: Column) -> Column:
        x = step(now["now"], e)
        shown = F.struct(x["seq"].alias("seq"), x["state"].alias("state"), x["filled"].alias("filled"), F.when((x["filled"] != 0) & ~F.isnan(x["price"]), x["price"]).alias("avg_price"), x["legal"].alias("legal"))
        return F.struct(x.alias("now"), F.array_append(now["moves"], shown).alias("moves"))

    start = F.struct(F.struct(F.lit("NEW").alias("state"), F.lit(0.0).alias("filled"), F.lit(0.0).alias("price"), F.lit(True).alias("legal"), F.lit(0).cast("long").alias("seq")).alias("now"), F.array().cast(f"array<{move}>").alias("moves"))
    return events.groupBy("order_id").agg(F.collect_list(event).alias("events")).select("order_id", F.aggregate(F.array_sort("events"), start, grow, lambda x: x["moves"]).alias("moves"))


def moves_of(orders: DataFrame) -> DataFrame:
    """(order_id, seq, state, filled, avg_price, legal): a row for each move of ``order_states``."""
    return orders.select("order_id", F.inline("moves"))


def live_breaker(returns: DataFrame, most_drawdown: float = -0.03) -> DataFrame:
    """(key, seq, equity, drawdown, halted) for every return (key, seq, ret) of a stream; once halted, always halted."""
    out = "key string, seq long, equity double, drawdown double, halted boolean"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        equity, peak, halted = state.get if state.exists else (1.0, 0.0, False)
        rows = []
        for batch in batches:
            for e in batch.sort_values("seq").itertuples():
                equity *= 1 + e.ret
                peak = max(peak, equity)
                halted = halted or equity / peak - 1 <= most_drawdown
                rows.append((key[0], e.seq, equity, equity / peak - 1, halted))
        state.update((equity, peak, halted))
        yield pd.DataFrame(rows, columns=["key", "seq", "equity", "drawdown", "halted"])

    return returns.groupBy("key").applyInPandasWithState(step, out, "equity double, peak double, halted boolean", "append", GroupStateTimeout.NoTimeout)
