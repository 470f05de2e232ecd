"""Named date ranges and calendar spines.

Ranges are worked out from an explicit ``as_of`` day on the driver: they become
date literals in the plan. Spines are as long as the calendar they draw.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels of the days of a week, Monday first.
DAY_LABELS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
# Short month names.
MONTH_LABELS = (
    "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)


@dataclass(frozen=True)
class DateRange:
    label: str
    first: date
    last: date


def monday_of(day: date) -> date:
    return day - timedelta(days=day.weekday())


def month_start(day: date, back: int = 0) -> date:
    """First day of the month ``back`` months before ``day``'s."""
    count = day.year * 12 + day.month - 1 - back
    return date(count // 12, count % 12 + 1, 1)


def month_end(first: date) -> date:
    return month_start(first, -1) - timedelta(days=1)


def named_range(kind: str, as_of: date, offset: int = 0) -> DateRange:
    """``today``, ``week`` or ``month``, ``offset`` units back; the current one ends today."""
    if kind == "today":
        day = as_of - timedelta(days=offset)
        names = {0: "Today", 1: "Yesterday"}
        return DateRange(names.get(offset, f"{MONTH_LABELS[day.month - 1]} {day.day}"), day, day)
    if kind == "week":
        first = monday_of(as_of) - timedelta(weeks=offset)
        last = as_of if offset == 0 else first + timedelta(days=6)
        names = {0: "This week", 1: "Last week"}
        return DateRange(names.get(offset, f"{offset} weeks ago"), first, last)
    if kind == "month":
        first = month_start(as_of, offset)
        last = as_of if offset == 0 else month_end(first)
        names = {0: "This month", 1: "Last month"}
        label = names.get(offset, f"{MONTH_LABELS[first.month - 1]} {first.year}")
        return DateRange(label, first, last)
    raise ValueError(f"unknown range kind: {kind}")


def custom_range(text: str) -> DateRange:
    """R2: ``FROM:TO`` with ISO dates, FROM not after TO."""
    first, mark, last = text.partition(":")
    if not mark:
        raise ValueError("a range looks like 2026-04-01:2026-04-23")
    begin, end = date.fromisoformat(first.strip()), date.fromisoformat(last.strip())
    if begin > end:
        raise ValueError("the start date must not be after the end date")
    return DateRange("Range", begin, end)


def last_days(as_of: date, days: int) -> DateRange:
    """R2: exactly ``days`` dates, today included."""
    if days < 1:
        raise ValueError("at least one day")
    return DateRange("Range", as_of - timedelta(days=days - 1), as_of)


def hour_spine(spark: SparkSession) -> DataFrame:
    return spark.range(24).select(
        F.col("id").cast("int").alias("bucket"),
        F.col("id").cast("int").alias("position"),
        F.lpad(F.col("id").cast("string"), 2, "0").alias("label"),
    )


def week_spine(spark: SparkSession, monday: date) -> DataFrame:
    """Monday to Sunday, days to come included."""
    names = F.array(*[F.lit(n) for n in DAY_LABELS])
    return spark.range(7).select(
        F.date_add(F.lit(monday), F.col("id").cast("int")).alias("bucket"),
        F.col("id").cast("int").alias("position"),
        F.get(names, F.col("id").cast("int")).alias("label"),
    )


def month_weeks_spine(spark: SparkSession, first: date) -> DataFrame:
    """Monday weeks clipped to one month: W1..Wn with their first and last day."""
    last = month_end(first)
    weeks = (last - monday_of(first)).days // 7 + 1
    monday = F.date_add(F.lit(monday_of(first)), (F.col("id") * 7).cast("int"))
    begin = F.greatest(monday, F.lit(first))
    end = F.least(F.date_add(monday, 6), F.lit(last))
    return spark.range(weeks).select(
        monday.alias("bucket"),
        F.col("id").cast("int").alias("position"),
        F.concat(F.lit("W"), (F.col("id") + 1).cast("string")).alias("label"),
        F.concat(
            F.date_format(begin, "MM-dd"), F.lit(" – "), F.date_format(end, "MM-dd")
        ).alias("sublabel"),
    )


def trend_spine(spark: SparkSession, unit: str, as_of: date, count: int) -> DataFrame:
    """The last ``count`` days, weeks or months, oldest first."""
    ids = spark.range(count)
    position = F.col("id").cast("int")
    if unit == "day":
        bucket = F.date_add(F.lit(as_of - timedelta(days=count - 1)), position)
        label = F.date_format(bucket, "MM-dd")
    elif unit == "week":
        oldest = monday_of(as_of) - timedelta(weeks=count - 1)
        bucket = F.date_add(F.lit(oldest), position * 7)
        label = F.date_format(bucket, "MM-dd")
    elif unit == "month":
        bucket = F.add_months(F.lit(month_start(as_of, count - 1)), position)
        label = F.date_format(bucket, "yy-MM")
    else:
        raise ValueError(f"unknown trend unit: {unit}")
    return ids.select(bucket.alias("bucket"), position.alias("position"), label.alias("label"))
