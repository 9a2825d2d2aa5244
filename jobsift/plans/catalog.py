"""Registered queries: one Spark callable (spark, sf_dir) -> DataFrame per
operator, and the DuckDB oracle text where one exists.

Every query reads the driver tables (or views Spark derives from them), so
its work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a query; it always runs with the session time zone at UTC
    (timestamps are UTC instants and are rendered as UTC text)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import utc
            utc(spark)
            return fn(spark, sf_dir)
        run.__name__ = getattr(fn, "__name__", name)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the query modules so their registrations run."""
    import importlib
    for mod in MODULES:
        importlib.import_module(f"{__package__}.{mod}")


MODULES = ["q_scoring", "q_filters", "q_scalars", "q_dedup", "q_runs", "q_sinks", "q_sources", "q_models", "q_many"]
