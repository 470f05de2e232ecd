"""The usage source of all reports and the session model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.functions.fixed_prices import SYNTHETIC
from meterstone.schemas import COUNTERS, SESSION_KEY

COLUMNS = [
    "session_id",
    "agent_type",
    "usage_date",
    "usage_hour",
    "project_path",
    "model",
    *COUNTERS,
    "cost_micro",
]


def usage_source(usage: DataFrame, sessions: DataFrame) -> DataFrame:
    """Buckets, and sessions without any bucket dated by their start.

    Sessions are few against buckets; both sides of the anti join hold one row
    per session, the bucket side combined before its shuffle. A sessions table
    that carries ``has_buckets`` (kept by the table sink) needs no join at all.
    """
    if "has_buckets" in sessions.columns:
        bare = sessions.filter(~F.col("has_buckets"))
    else:
        bare = sessions.join(usage.select(*SESSION_KEY).distinct(), SESSION_KEY, "left_anti")
    fallback = bare.withColumnsRenamed(
        {"started_date": "usage_date", "started_hour": "usage_hour"}
    )
    return usage.select(*COLUMNS).unionByName(fallback.select(*COLUMNS))


def between(usage: DataFrame, first, last) -> DataFrame:
    """Inclusive date range as literals, so that it reaches the partitions."""
    return usage.filter(F.col("usage_date").between(F.lit(first), F.lit(last)))


def real_model(model: Column) -> Column:
    """NULL unless the model is neither empty nor the placeholder."""
    return F.when(~model.isin("", SYNTHETIC), model)


def preferred_model(session_model: Column, usage_model: Column) -> Column:
    """U4: the session's own model, else the greatest real model of its buckets, else ''."""
    return F.coalesce(real_model(session_model), usage_model, F.lit(""))
