"""Merging new rows into stored sessions and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.operators.cube import complete_sessions
from meterstone.schemas import COUNTERS, MONEY, SESSION_KEY, SESSION_TEXT

# What the session table knows about a session's buckets and the log they come from.
STORAGE = ["has_buckets", "first_usage_date", "usage_days", "log_modified", "log_path"]


def merge_sessions(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert by (agent, session); a NULL or absent column keeps the stored value.

    NULL is a value for the cost, so cost has its own flag ``cost_is_set``:
    without it an existing cost stays and a new session starts at zero.
    """
    given = set(changes.columns)
    cost_is_set = F.col("cost_is_set") if "cost_is_set" in given else F.lit("cost_micro" in given)
    new_cost = F.col("cost_micro") if "cost_micro" in given else F.lit(None).cast(MONEY)
    texts = [c for c in SESSION_TEXT if c in given]
    counts = [c for c in COUNTERS if c in given]
    incoming = changes.select(
        *SESSION_KEY,
        F.struct(
            cost_is_set.alias("cost_is_set"),
            new_cost.cast(MONEY).alias("cost_micro"),
            *texts,
            *counts,
            *[c for c in STORAGE if c in given],
        ).alias("n"),
    )
    old = stored.select(
        *SESSION_KEY, F.struct(*SESSION_TEXT, *COUNTERS, "cost_micro", *STORAGE).alias("o")
    )
    merged = old.join(incoming, SESSION_KEY, "full_outer")

    def pick(name: str, default):
        sources = [F.col(f"n.{name}")] if name in given else []
        return F.coalesce(*sources, F.col(f"o.{name}"), F.lit(default)).alias(name)

    cost = (
        F.when(F.coalesce(F.col("n.cost_is_set"), F.lit(False)), F.col("n.cost_micro"))
        .when(F.col("o").isNotNull(), F.col("o.cost_micro"))
        .otherwise(F.lit(0).cast(MONEY))
    )
    return complete_sessions(
        merged.select(
            *SESSION_KEY,
            *[pick(c, "") for c in SESSION_TEXT],
            *[pick(c, 0) for c in COUNTERS],
            cost.alias("cost_micro"),
            pick("has_buckets", False),
            *[pick(c, None) for c in STORAGE if c != "has_buckets"],
        )
    )


def fill_from_index(index: DataFrame, logs: DataFrame) -> DataFrame:
    """One change set from index and log rows.

    What a log says wins, the index fills what logs leave empty, and the
    summary is always the index's. Sessions known to the index alone stay.
    """
    from_log = logs.select(
        *SESSION_KEY,
        F.struct(
            *[c for c in SESSION_TEXT if c != "summary"], *COUNTERS, "cost_micro", *STORAGE
        ).alias("l"),
    )
    text = ["project_path", "git_branch", "started_at", "ended_at"]
    from_index = index.select(
        *SESSION_KEY, F.struct(*text, "summary", "message_count").alias("i")
    )
    both = from_log.join(from_index, SESSION_KEY, "full_outer")
    has_log = F.col("l").isNotNull()

    def filled(name: str):
        return F.coalesce(F.nullif(F.col(f"l.{name}"), F.lit("")), F.col(f"i.{name}")).alias(name)

    return both.select(
        *SESSION_KEY,
        *[filled(c) for c in text],
        *[F.col(f"l.{c}").alias(c) for c in ("model", "first_prompt", "last_prompt")],
        F.col("i.summary").alias("summary"),
        F.coalesce(F.col("l.message_count"), F.col("i.message_count")).alias("message_count"),
        *[F.col(f"l.{c}").alias(c) for c in COUNTERS if c != "message_count"],
        F.col("l.cost_micro").alias("cost_micro"),
        *[F.col(f"l.{c}").alias(c) for c in STORAGE],
        has_log.alias("cost_is_set"),
    )


def replace_usage(stored: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Drop every bucket of the changed sessions, then add their new buckets.

    ``changed`` holds one row per changed session, so a session with many
    buckets is matched, never collected.
    """
    keys = changed.select(*SESSION_KEY).distinct()
    return stored.join(keys, SESSION_KEY, "left_anti").unionByName(fresh.select(*stored.columns))


def newest_per_session(rows: DataFrame, stamp: list[str]) -> DataFrame:
    """Of several rows of one session keep the one with the greatest stamp."""
    names = rows.columns
    rest = [c for c in names if c not in SESSION_KEY]
    newest = rows.groupBy(*SESSION_KEY).agg(
        F.max_by(F.struct(*rest), F.struct(*stamp)).alias("row")
    )
    return newest.select(*SESSION_KEY, "row.*").select(*names)
