"""Query registry: one entry per operator, each with its DuckDB oracle SQL.

Every query reads the driver's tables through the adapter, over whole tables.
``QUERIES[key](spark, sf_dir) -> DataFrame``; ``ORACLES[key]`` is SQL over the
raw test tables (the adapter CTEs are prepended by ``with_tables``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ridegrid.plans.adapter_sql import with_tables
from ridegrid.session import configure
from ridegrid.sources.testdata import TestData

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None, ctes: list[tuple[str, str]] | None = None):
    """Decorator: register ``fn(td: TestData) -> DataFrame`` under ``key``."""

    def deco(fn: Callable[[TestData], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(TestData(spark, sf_dir))

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_tables(sql, ctes)
        return fn

    return deco


def register_raw(key: str, oracle: str):
    """``register`` for an oracle that is complete already (another key's)."""

    def deco(fn: Callable[[TestData], DataFrame]):
        register(key)(fn)
        ORACLES[key] = oracle
        return fn

    return deco


def _load_all() -> None:
    # Importing the modules fills the registry.
    from ridegrid.plans import (  # noqa: F401
        q_commands,
        q_incremental,
        q_quality,
        q_replay,
        q_streams,
        q_views,
    )


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLES)
