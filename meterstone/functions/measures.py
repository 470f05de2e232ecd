"""Aggregates and row measures every report shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterstone.schemas import MONEY, TOKEN_COLS


def dollars(micro: Column) -> Column:
    """Publish an exact micro-dollar amount as a double in USD."""
    return micro.cast("double") / F.lit(1_000_000.0)


def micro(usd: Column) -> Column:
    """Take a USD amount into the exact micro-dollar form."""
    return (usd.cast("decimal(24,12)") * F.lit(1_000_000).cast("decimal(7,0)")).cast(MONEY)


def known_cost(cost: Column) -> Column:
    """Sum that skips unpriced rows: what reports add up."""
    return F.coalesce(F.sum(cost), F.lit(0).cast(MONEY))


def poisoned_cost(cost: Column) -> Column:
    """Sum that is NULL as soon as one row is unpriced: what buckets and sessions store."""
    return F.when(F.count_if(cost.isNull()) == 0, known_cost(cost))


def unknown_count(cost: Column) -> Column:
    """How many rows could not be priced."""
    return F.count_if(cost.isNull())


def session_count() -> Column:
    """A session is the pair of agent and id."""
    return F.count_distinct("agent_type", "session_id")


def total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def standard(*counters: str) -> list[Column]:
    """The usual report block: sessions, counters, known cost and unknown rows."""
    cost = F.col("cost_micro")
    return [
        session_count().alias("session_count"),
        *[total(c).alias(c) for c in (*counters, *TOKEN_COLS)],
        known_cost(cost).alias("cost_micro"),
        unknown_count(cost).alias("unknown_cost_count"),
    ]


def all_tokens() -> Column:
    """Input, output and both cache counters."""
    out = F.lit(0).cast("bigint")
    for name in TOKEN_COLS:
        out = out + F.coalesce(F.col(name), F.lit(0))
    return out


def cache_tokens() -> Column:
    return F.coalesce(F.col("cache_read_tokens"), F.lit(0)) + F.coalesce(
        F.col("cache_creation_tokens"), F.lit(0)
    )


def prompt_tokens() -> Column:
    return F.coalesce(F.col("input_tokens"), F.lit(0)) + cache_tokens()


def requests() -> Column:
    """Messages that are not human turns, never negative."""
    return F.greatest(F.col("message_count") - F.col("user_turns"), F.lit(0))


def cache_hit_pct() -> Column:
    """U8: cache reads as a share of the prompt side; NULL if there is none."""
    read = F.coalesce(F.col("cache_read_tokens"), F.lit(0)).cast("double")
    return F.when(prompt_tokens() > 0, F.lit(100.0) * read / prompt_tokens())


def cache_share_pct() -> Column:
    """U8: all cache traffic as a share of the prompt side; NULL if there is none."""
    return F.when(
        prompt_tokens() > 0, F.lit(100.0) * cache_tokens().cast("double") / prompt_tokens()
    )


def cost_signal(cost: str = "cost_micro") -> Column:
    """Rows worth showing: they cost something or could not be priced."""
    return (F.col(cost) > 0) | (F.col("unknown_cost_count") > 0)


def unknown_last(cost: str = "cost_micro") -> Column:
    """Sort flag that puts rows with nothing but unknown cost at the end."""
    only_unknown = (F.col("unknown_cost_count") > 0) & (F.col(cost) == 0)
    return F.when(only_unknown, 1).otherwise(0)
