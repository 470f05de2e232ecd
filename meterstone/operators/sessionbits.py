"""Distinct sessions of any range from stored bitmaps.

Sessions are numbered once, those of one day next to each other. For each day and agent a
bitmap says which numbers occur; a range is the union of its days. Counts stay exact,
since sets are joined and not counts, and no report reads the facts for them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.schemas import SESSION_KEY
from meterstone.session import cut_lineage

#: Partitions of one numbering are this far apart.
SPACE = 1 << 33


def number_sessions(facts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``agent_type, session_id, number`` of the sessions of ``facts`` that ``known`` has not numbered.

    Numbers ascend with the first day, without gaps in a partition of the sort, so that
    the sessions of a day share few bitmaps. They are staged: a number never changes.
    """
    days = facts.groupBy(*SESSION_KEY).agg(F.min("usage_date").alias("first"))
    used = 0
    if known is not None:
        days = days.join(known.select(*SESSION_KEY), SESSION_KEY, "left_anti")
        last = known.agg(F.max("number")).first()[0]
        used = 0 if last is None else (last // SPACE + 1) * SPACE
    order = ["first", *SESSION_KEY]
    sorted_days = days.repartitionByRange(*order).sortWithinPartitions(*order)
    number = (F.monotonically_increasing_id() + F.lit(used)).alias("number")
    return cut_lineage(sorted_days.select(*SESSION_KEY, number))


def session_bits(facts: DataFrame, numbers: DataFrame) -> DataFrame:
    """``usage_date, agent_type, bucket, bits``: one row for at most 32,768 sessions of a day and agent."""
    seen = facts.select(*SESSION_KEY, "usage_date").distinct().join(numbers, SESSION_KEY)
    number = F.col("number")
    return seen.groupBy("usage_date", "agent_type", F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    )


def distinct_sessions(bits: DataFrame, ranges: list[tuple[str, date, date]]) -> DataFrame:
    """``label, agent_type, session_count``: exact distinct sessions of each range (both ends included) and
    agent, and of all agents together (NULL). One pass over ``bits``, whatever the ranges.

    A session belongs to one agent, so counts of agents add up. Ranges without sessions have no rows.
    """
    inside = [
        F.when(F.col("usage_date").between(F.lit(start), F.lit(end)), F.lit(label)) for label, start, end in ranges
    ]
    first, last = min(r[1] for r in ranges), max(r[2] for r in ranges)
    united = (
        bits.where(F.col("usage_date").between(F.lit(first), F.lit(last)))
        .withColumn("label", F.explode(F.array_compact(F.array(*inside))))
        .groupBy("label", "agent_type", "bucket")
        .agg(F.bitmap_or_agg("bits").alias("bits"))
    )
    return (
        united.withColumn("sessions", F.bitmap_count("bits"))
        .rollup("label", "agent_type")
        .agg(F.sum("sessions").alias("session_count"))
        .where("label IS NOT NULL")
    )
