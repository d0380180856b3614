"""Execution simulation: the order state machine, fills and paper trading."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states of an order and where each may go.
TRANSITIONS = {
    "NEW": ("WORKING", "REJECTED"),
    "WORKING": ("PARTIAL", "FILLED", "CANCELED", "REJECTED"),
    "PARTIAL": ("PARTIAL", "FILLED", "CANCELED"),
    "FILLED": (),
    "CANCELED": (),
    "REJECTED": (),
}
TOLERANCE = 1e-9


def can_transition(source: Column, target: Column) -> Column:
    edges = [F.concat_ws(">", F.lit(a), F.lit(b)) for a, to in TRANSITIONS.items() for b in to]
    return F.array_contains(F.array(*edges), F.concat_ws(">", source, target))


def is_terminal(state: Column) -> Column:
    return state.isin(*(s for s, to in TRANSITIONS.items() if not to))


def apply_fills(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """(order_id, qty, filled, remaining, avg_price, n_fills, state, overfilled): ``orders`` (order_id, qty) with the sums of their ``fills`` (order_id, qty, price)."""
    g = fills.groupBy("order_id").agg(F.sum("qty").alias("filled"), (F.sum(F.col("qty") * F.col("price")) / F.sum("qty")).alias("avg_price"), F.count("*").alias("n_fills"))
    o = orders.select("order_id", "qty").join(g, "order_id", "left").na.fill({"filled": 0.0, "n_fills": 0})
    left = F.greatest(F.col("qty") - F.col("filled"), F.lit(0.0))
    state = F.when(F.col("filled") <= 0, "WORKING").when(left <= TOLERANCE, "FILLED").otherwise("PARTIAL")
    return o.select("order_id", "qty", "filled", left.alias("remaining"), "avg_price", "n_fills", state.alias("state"), (F.col("filled") > F.col("qty") + TOLERANCE).alias("overfilled"))


def paper_fills(df: DataFrame, key: str, at: str, target: str, price: str, liquidity: str | None = None, slippage_bps: float = 0.0, cost_bps: float = 0.0, participation: float = 1.0) -> DataFrame:
    """``df`` with position, traded, fill_price, commission and slippage_cost.

    The position chases the target, each step at most ``participation`` of
    the liquidity; a missing target or price holds it. Series run in parallel.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "position double, traded double, fill_price double, commission double, slippage_cost double"])
    slip = slippage_bps / 1e4

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(at, kind="stable").reset_index(drop=True)
        goal, quote = rows[target].to_numpy(float), rows[price].to_numpy(float)
        most = np.maximum(np.nan_to_num(participation * rows[liquidity].to_numpy(float)), 0) if liquidity else np.full(len(rows), np.inf)
        now, out = 0.0, []
        for g, p, m in zip(goal, quote, most):
            trade = float(np.clip(g - now, -m, m)) if np.isfinite(g) and np.isfinite(p) else 0.0
            now += trade
            paid = p * (1 + np.sign(trade) * slip) if trade else np.nan
            out.append((now, trade, paid, abs(trade) * p * cost_bps / 1e4 if trade else 0.0, abs(trade) * p * slip if trade else 0.0))
        made = pd.DataFrame(out, columns=["position", "traded", "fill_price", "commission", "slippage_cost"], dtype=float)
        return pd.concat([rows, made], axis=1)

    return df.groupBy(key).applyInPandas(run, schema)


def realized_vs_paper(df: DataFrame, key: str, at: str, position: str, returns: str, cost: str) -> DataFrame:
    """``df`` with gross, net and drag: the position of the row before earns the return; missing values count as zero."""
    held = F.coalesce(F.lag(position).over(Window.partitionBy(key).orderBy(at)), F.lit(0.0))
    gross = held * F.coalesce(returns, F.lit(0.0))
    return df.withColumn("gross", gross).withColumn("drag", F.coalesce(cost, F.lit(0.0))).withColumn("net", F.col("gross") - F.col("drag"))
