"""Canonical events to usage buckets and sessions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.functions.measures import poisoned_cost
from meterstone.functions.timebucket import local_date, local_hour
from meterstone.operators.log_a import AGENT as AGENT_A
from meterstone.schemas import COUNTERS, MONEY, SESSIONS, USAGE


def sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in COUNTERS]


def hourly(events: DataFrame) -> DataFrame:
    """Events summed per log, local hour and model; partial sums run before the shuffle."""
    return events.groupBy("agent_type", "file_path", "usage_date", "usage_hour", "model").agg(
        *sums(), poisoned_cost(F.col("cost_micro")).alias("cost_micro")
    )


def is_bucket() -> Column:
    """Dated rows are buckets; agent A drops those in which nothing happened."""
    busy = F.coalesce(F.col("cost_micro") != 0, F.lit(False))
    for c in COUNTERS:
        busy = busy | (F.col(c) != 0)
    return F.col("usage_date").isNotNull() & ((F.col("agent_type") != AGENT_A) | busy)


def chosen_files(files: DataFrame) -> DataFrame:
    """Logs with a human turn; of two logs of one session the newest one."""
    candidates = files.filter(F.col("user_turns") > 0)
    names = candidates.columns
    newest = candidates.groupBy("agent_type", "session_id").agg(
        F.max_by(
            F.struct(*[c for c in names if c not in ("agent_type", "session_id")]),
            F.struct("modified", "file_path"),
        ).alias("f")
    )
    return newest.select("agent_type", "session_id", "f.*").select(*names)


def not_older(chosen: DataFrame, sessions: DataFrame) -> DataFrame:
    """S12 across syncs: drop a log if its session already stands on a newer one.

    The log that a session stands on may always replace itself.
    """
    held = sessions.filter(F.col("log_path").isNotNull()).select(
        "agent_type", "session_id", "log_modified", "log_path"
    )
    stamp = F.struct(F.col("modified"), F.col("file_path"))
    stays = (
        F.col("log_path").isNull()
        | (F.col("log_path") == F.col("file_path"))
        | (stamp >= F.struct(F.col("log_modified"), F.col("log_path")))
    )
    joined = chosen.join(held, ["agent_type", "session_id"], "left")
    return joined.filter(stays).select(*chosen.columns)


def usage_buckets(hours: DataFrame, chosen: DataFrame) -> DataFrame:
    """Bucket rows of the chosen logs, stamped with the session's id and project."""
    owner = chosen.select("agent_type", "file_path", "session_id", "project_path")
    return (
        hours.filter(is_bucket())
        .join(owner, ["agent_type", "file_path"])
        .withColumn("cost_is_explicit", F.col("cost_micro").isNotNull())
        .select(*[F.col(f.name).cast(f.dataType) for f in USAGE])
    )


def session_rows(hours: DataFrame, chosen: DataFrame) -> DataFrame:
    """Session totals; cost is NULL as soon as one bucket is unpriced."""
    bucket_cost = F.when(is_bucket(), F.col("cost_micro"))
    open_bucket = is_bucket() & F.col("cost_micro").isNull()
    totals = hours.groupBy("agent_type", "file_path").agg(
        *sums(),
        (F.count_if(is_bucket()) > 0).alias("has_buckets"),
        F.min(F.when(is_bucket(), F.col("usage_date"))).alias("first_usage_date"),
        F.array_sort(F.collect_set(F.when(is_bucket(), F.col("usage_date")))).alias("usage_days"),
        F.when(
            F.count_if(open_bucket) == 0,
            F.coalesce(F.sum(bucket_cost), F.lit(0).cast(MONEY)),
        ).alias("cost_micro"),
    )
    log = chosen.drop("user_turns").withColumns(
        {"log_modified": F.col("modified"), "log_path": F.col("file_path")}
    )
    return complete_sessions(log.join(totals, ["agent_type", "file_path"]))


def complete_sessions(rows: DataFrame) -> DataFrame:
    """Fill in what the sources do not know and derive the date reports prune on."""
    known = set(rows.columns)
    missing = {
        f.name: F.lit("" if f.dataType.simpleString() == "string" else None).cast(f.dataType)
        for f in SESSIONS
        if f.name not in known
    }
    started = F.col("started_at")
    derived = {"started_date": local_date(started), "started_hour": local_hour(started)}
    if "has_buckets" in missing:
        missing["has_buckets"] = F.lit(False)
    return (
        rows.withColumns(missing)
        .withColumns(derived)
        .select(*[F.col(f.name).cast(f.dataType) for f in SESSIONS])
    )


def as_of_day(usage: DataFrame, day: date) -> DataFrame:
    """What every session did on one day. Filtered before the sum, so partitions prune."""
    return (
        usage.filter(F.col("usage_date") == F.lit(day))
        .groupBy("agent_type", "session_id")
        .agg(
            *[F.sum(c).alias(f"today_{c}") for c in COUNTERS],
            poisoned_cost(F.col("cost_micro")).alias("today_cost_micro"),
        )
    )
