"""The table of registered queries: a name, a function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans.bindings import PANEL_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, panel: bool = True):
    """Registers a function under its name; ``sql`` may use the panel, state and orders_given tables, and further tables before a final SELECT."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {PANEL_SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}" if panel else sql
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from . import queries_diagnostics, queries_evaluation, queries_features, queries_imputation, queries_learned, queries_models, queries_more, queries_resampling, queries_selection, queries_statistics, queries_tables  # noqa: F401
