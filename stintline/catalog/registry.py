"""Registration of named queries and their oracle statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stintline.sources.views import Views, spelled, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Derived statements the oracles share; names end in _o.
SHARED: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under a name, with its SQL if there is one."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Views(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def oracle_statements() -> dict[str, str]:
    return {name: spelled(with_views(sql, SHARED, "AS MATERIALIZED"), False) for name, sql in ORACLES.items()}


def r6(expr: str, digits: int = 6) -> str:
    """The oracle's side of ``figures.rounded``."""
    return (f"CASE WHEN abs({expr}) < 0.5 * power(10.0, -{digits}) THEN 0.0 "
            f"ELSE round(CAST({expr} AS DOUBLE), {digits}) END")
