"""Governance of trials: the record of what was tried, single-use holdouts, label ends, drift warnings and repair of covariances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def trial_summary(trials: DataFrame, by: list[str], config: str = "config_hash", sharpe: str = "sharpe") -> DataFrame:
    """(*by, n_trials, n_unique_configs, sharpe_std, best_config, best_sharpe) of each record of trials.

    Trials without a Sharpe ratio count as trials, and for nothing else; the
    deviation is 0 under two ratios; of equally good configurations the first by name is best.
    """
    scored = F.when(F.isnan(sharpe), None).otherwise(F.col(sharpe))
    best = F.min(F.when(scored.isNotNull(), F.struct((-scored).alias("worse"), F.col(config).alias("name"))))
    out = trials.groupBy(*by).agg(F.count("*").alias("n_trials"), F.countDistinct(config).alias("n_unique_configs"), F.coalesce(F.stddev_samp(scored), F.lit(0.0)).alias("sharpe_std"), best.alias("_best"))
    return out.select(*by, "n_trials", "n_unique_configs", "sharpe_std", F.col("_best.name").alias("best_config"), (-F.col("_best.worse")).alias("best_sharpe"))


def holdout_uses(uses: DataFrame, tokens: DataFrame, token: str, bound_to: str, at: str) -> DataFrame:
    """``uses`` (token, bound_to, at) with outcome: 'granted' for the first use with the strategy that the token was issued for, 'spent' for any later use, 'mismatch' for another strategy before that, 'unknown' without a token. A mismatch spends nothing."""
    issued = tokens.select(token, F.col(bound_to).alias("_issued"))
    both = uses.join(issued, token, "left")
    first = both.where(F.col(bound_to) == F.col("_issued")).groupBy(token).agg(F.min(at).alias("_first"))
    both = both.join(first, token, "left")
    outcome = F.when(F.col("_issued").isNull(), "unknown").when(F.col(at) > F.col("_first"), "spent").when(F.col(at) == F.col("_first"), "granted").otherwise("mismatch")
    return both.withColumn("outcome", outcome).drop("_issued", "_first")


def label_end(at: str, w: WindowSpec, horizon: int) -> Column:
    """When the label of each row ends: ``horizon`` rows on, or at the last row of the series."""
    return F.last(at).over(w.rowsBetween(0, horizon))


def drift_warnings(stability: Column, drawdown: Column, psi_warn: float = 0.2, halt: float = -0.03) -> Column:
    """Warnings (an array, not binding): a shifted signal, and a live drawdown at or below ``halt``."""
    shifted = F.when(stability > psi_warn, F.lit("distribution drift"))
    fallen = F.when(drawdown <= halt, F.lit("live drawdown"))
    return F.array_compact(F.array(shifted, fallen))


def nearest_psd(matrices: DataFrame, by: str, i: str, j: str, v: str, floor: float = 1e-12) -> DataFrame:
    """The symmetric matrices nearest to those in rows (by, i, j, v) whose eigenvalues are at ``floor`` or above. One matrix is one group: assets squared, not rows of data."""
    schema = f"`{by}` {matrices.schema[by].dataType.simpleString()}, `{i}` {matrices.schema[i].dataType.simpleString()}, `{j}` {matrices.schema[j].dataType.simpleString()}, `{v}` double"

    def repaired(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows[i]) | set(rows[j]))
        m = rows.pivot(index=i, columns=j, values=v).reindex(index=names, columns=names).to_numpy(float)
        m = np.where(np.isnan(m), m.T, m)  # one triangle is enough
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        m = (vectors * np.maximum(values, floor)) @ vectors.T
        return pd.DataFrame({by: rows[by].iloc[0], i: np.repeat(names, len(names)), j: np.tile(names, len(names)), v: m.ravel()})

    return matrices.select(by, i, j, v).groupBy(by).applyInPandas(repaired, schema)
