"""Local hour buckets and durations from ISO-8601 text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """Timestamp of an ISO text; texts shorter than a date are not times."""
    return F.when(F.length(text) >= 10, F.try_to_timestamp(text))


def local_date(text: Column) -> Column:
    """Date in the session time zone; a broken time keeps its date part if it has one."""
    return F.coalesce(
        F.to_date(parse_time(text)), F.to_date(F.try_to_timestamp(F.left(text, F.lit(10))))
    )


def local_hour(text: Column) -> Column:
    return F.coalesce(F.hour(parse_time(text)), F.lit(0))


def with_local_bucket(df: DataFrame, text: str) -> DataFrame:
    """Add ``usage_date`` and ``usage_hour`` of a text column, parsing each time once."""
    time = F.col("__time")
    short = F.to_date(F.try_to_timestamp(F.left(text, F.lit(10))))
    return (
        df.withColumn("__time", parse_time(F.col(text)))
        .withColumns(
            {
                "usage_date": F.coalesce(F.to_date(time), short),
                "usage_hour": F.coalesce(F.hour(time), F.lit(0)),
            }
        )
        .drop("__time")
    )


def duration_minutes(started: Column, ended: Column) -> Column:
    """Minutes between two ISO texts, never negative, 0 when either is unreadable."""
    micros = F.unix_micros(parse_time(ended)) - F.unix_micros(parse_time(started))
    return F.coalesce(F.greatest(micros / F.lit(60_000_000.0), F.lit(0.0)), F.lit(0.0))
