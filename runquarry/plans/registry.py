"""Name -> (query, SQL statement of the same result)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runquarry.plans.fixtures import Tables, duckdb_with

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` may use the fixture views."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = duckdb_with(sql)
        return fn

    return register


def _load() -> None:
    from runquarry.plans import (grid_plans, merge_plans, metric_plans, nested_plans, preprocess_plans, run_plans,  # noqa: F401
                                 runlog_plans, stats_plans, stream_plans, sweep_plans, tpe_plans)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, fn=fn: fn(Tables.of(spark, sf_dir))) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
