"""Live session state against stored reports.

A live row is the newest counters of a session: totals, plus ``today_*``
counters that are NULL when nobody computed them.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.functions import measures as M
from meterstone.functions.pricebook import BUILTIN, PriceBook
from meterstone.functions.timebucket import parse_time
from meterstone.operators.cube import as_of_day
from meterstone.plans.reports import (
    day_session_totals,
    publish,
    roll_up_agents,
    trend_rows,
)
from meterstone.schemas import COUNTERS, MONEY, SESSION_KEY, TOKEN_COLS


def live_snapshot(sessions: DataFrame, usage: DataFrame, day: date) -> DataFrame:
    """L4: session rows with their counters of one day; no activity that day is zero."""
    today = as_of_day(usage, day).drop("today_cost_micro")
    zero = F.lit(0).cast("bigint")
    return (
        sessions.join(today, SESSION_KEY, "left")
        .withColumns({f"today_{c}": F.coalesce(F.col(f"today_{c}"), zero) for c in COUNTERS})
        .withColumn("last_active", F.col("ended_at"))
    )


def recently_active(live: DataFrame, as_of: datetime, seconds: int = 300) -> DataFrame:
    """Sessions with a turn whose last activity is at most ``seconds`` old, newest first."""
    last = parse_time(F.col("last_active"))
    edge = F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))
    return live.filter((last >= edge) & (F.col("user_turns") > 0)).orderBy(
        last.desc(), *SESSION_KEY
    )


def active_count(live: DataFrame) -> DataFrame:
    """Sessions that have a turn or produced output."""
    return live.agg(
        F.count_if((F.col("user_turns") > 0) | (F.col("output_tokens") > 0)).alias("active_count")
    )


def today_counter(name: str) -> Column:
    """The counter of the day, or the total where none was computed."""
    return F.coalesce(F.col(f"today_{name}"), F.col(name))


def live_additions(
    usage: DataFrame, live: DataFrame, day: date, book: PriceBook = BUILTIN
) -> DataFrame:
    """What live sessions add to the stored rows of a day, one row per live session.

    A stored session adds what live is ahead by, if it has output at all; a
    session without stored rows adds everything, unless it did nothing.
    """
    priced = book.with_cost(
        live.withColumns({f"t_{c}": today_counter(c) for c in COUNTERS}),
        "t_cost",
        F.col("model"),
        *[F.col(f"t_{c}") for c in TOKEN_COLS],
        long_context=False,
    )
    now = priced.select(
        *SESSION_KEY,
        F.struct("user_turns", "output_tokens", *[f"t_{c}" for c in COUNTERS], "t_cost").alias(
            "now"
        ),
    )
    then = day_session_totals(usage, day).select(
        *SESSION_KEY, F.struct(*COUNTERS, "cost_micro", "unknown_cost_count").alias("then")
    )
    both = now.join(then, SESSION_KEY, "left")
    stored = F.col("then").isNotNull()
    counts_stored = stored & (F.col("now.output_tokens") > 0)
    counts_new = ~stored & ((F.col("now.user_turns") != 0) | (F.col("now.output_tokens") != 0))
    zero = F.lit(0).cast("bigint")
    nothing = F.lit(0).cast(MONEY)
    cost = F.coalesce(F.col("now.t_cost"), nothing)
    unknown = F.col("now.t_cost").isNull().cast("bigint")
    return both.filter(counts_stored | counts_new).select(
        *SESSION_KEY,
        F.when(stored, zero).otherwise(F.lit(1)).alias("session_count"),
        *[
            F.when(stored, F.greatest(F.col(f"now.t_{c}") - F.col(f"then.{c}"), zero))
            .otherwise(F.col(f"now.t_{c}"))
            .alias(c)
            for c in COUNTERS
        ],
        F.when(
            stored & F.col("now.t_cost").isNotNull(),
            F.greatest(cost - F.col("then.cost_micro"), nothing),
        )
        .when(stored, nothing)
        .otherwise(cost)
        .cast(MONEY)
        .alias("cost_micro"),
        F.when(stored, F.greatest(unknown - F.col("then.unknown_cost_count"), zero))
        .otherwise(unknown)
        .alias("unknown_cost_count"),
    )


MEASURES = ["session_count", *COUNTERS, "cost_micro", "unknown_cost_count"]


def added_up(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(
        *[M.total(c).alias(c) for c in MEASURES if c != "cost_micro"],
        M.known_cost(F.col("cost_micro")).alias("cost_micro"),
    )


def overview_with_live(
    usage: DataFrame, live: DataFrame, day: date, book: PriceBook = BUILTIN
) -> DataFrame:
    """The day's overview, per agent and overall (agent NULL), with live sessions merged in."""
    stored = (
        usage.filter(F.col("usage_date") == F.lit(day))
        .groupBy("agent_type")
        .agg(*M.standard("message_count", "user_turns"))
        .select("agent_type", *MEASURES)
    )
    added = live_additions(usage, live, day, book).select("agent_type", *MEASURES)
    return publish(roll_up_agents(added_up(stored.unionByName(added), "agent_type")))


def trend_with_live(
    usage: DataFrame,
    live: DataFrame,
    day: date,
    days: int = 30,
    book: PriceBook = BUILTIN,
) -> DataFrame:
    """The daily trend with live sessions added to the row of the day, made if absent."""
    stored = trend_rows(usage, day, days).select("usage_date", *MEASURES)
    dated = F.lit(day).alias("usage_date")
    added = live_additions(usage, live, day, book).select(dated, *MEASURES)
    today = usage.sparkSession.range(1).select(
        dated, *[F.lit(0).cast(stored.schema[c].dataType).alias(c) for c in MEASURES]
    )
    rows = added_up(stored.unionByName(added).unionByName(today), "usage_date")
    return publish(rows.orderBy(F.col("usage_date").desc()))
