"""Registry: name -> (Spark query, SQL oracle or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from suite.views import plain

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its operator name together with its oracle."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            # Log times carry an offset; the oracles read them as UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
            return plain(fn(spark, sf))

        run.__doc__ = fn.__doc__
        REGISTRY[name] = (run, sql)
        return fn

    return register


def load() -> dict[str, tuple[Query, str | None]]:
    from suite import (  # noqa: F401
        q_bits,
        q_live,
        q_logs,
        q_maintenance,
        q_pricing,
        q_reports,
        q_sync,
    )

    return REGISTRY
