"""Queries and their DuckDB equivalents, collected from the plan modules."""

from __future__ import annotations


def _modules() -> list:
    from . import asof, ensembles, equilibrium, evaluation, features, governance, models, selection, timeseries, trading, vintages

    return [asof, timeseries, evaluation, trading, models, governance, ensembles, vintages, selection, equilibrium, features]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}
