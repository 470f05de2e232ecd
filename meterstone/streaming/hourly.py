"""Continuous hourly usage (L9) and running a stream to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.functions.measures import known_cost, unknown_count
from meterstone.schemas import COUNTERS
from meterstone.session import new_folder


def hourly_usage(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Usage per event-time hour, agent and model, kept up to date.

    ``late`` is how far behind the newest event a row may be; ``late_writer`` keeps
    the rows that this leaves out.
    """
    cost = F.col("cost_micro")
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour"), "agent_type", "model")
        .agg(
            *[F.sum(c).alias(c) for c in COUNTERS],
            known_cost(cost).alias("cost_micro"),
            unknown_count(cost).alias("unknown_cost_count"),
        )
        .select(
            F.to_date("window.start").alias("usage_date"),
            F.hour("window.start").alias("usage_hour"),
            "agent_type",
            "model",
            *COUNTERS,
            "cost_micro",
            "unknown_cost_count",
        )
    )


def late_writer(folder: str, late: str = "1 day") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over the same events: what ``hourly_usage`` drops.

    A row is late if its hour had ended ``late`` before the newest event of the
    batches before it. Late rows go to ``<folder>/late``, where ``with_late`` takes them up;
    the newest event so far goes to ``<folder>/newest``, one row for a batch, of which the
    last one is read. Both are written under the batch number, so a repeated batch
    replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = None
        if number:
            # Batches are numbered without gaps.
            seen = spark.read.parquet(f"{folder}/newest/batch={number - 1}").first().ts
        ended = F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")
        # Event times count in whole milliseconds there.
        bound = F.date_trunc("millisecond", F.lit(seen)) - F.expr(f"INTERVAL {late}")
        missed = batch.filter(F.lit(False) if seen is None else ended <= bound)
        missed.write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        newest = batch.agg(F.greatest(F.max("ts"), F.lit(seen).cast("timestamp")).alias("ts"))
        newest.write.mode("overwrite").parquet(f"{folder}/newest/batch={number}")

    return write


def with_late(hourly: DataFrame, late: DataFrame) -> DataFrame:
    """The hours a stream has kept, with the rows that came too late for it.

    ``hourly`` has the newest version of each hour, ``late`` the rows of ``late_writer``.
    An hour is the sum of both, whichever of them it occurs in. Late rows stay in the table
    they were put in, by batch, so none counts twice, whenever this runs.
    """
    keys = ["usage_date", "usage_hour", "agent_type", "model"]
    cost = F.col("cost_micro")
    missed = late.select(
        F.to_date("ts").alias("usage_date"),
        F.hour("ts").alias("usage_hour"),
        "agent_type",
        "model",
        *COUNTERS,
        "cost_micro",
        cost.isNull().cast("long").alias("unknown_cost_count"),
    )
    counts = [*COUNTERS, "unknown_cost_count"]
    return (
        hourly.select(*keys, *counts, "cost_micro")
        .unionByName(missed)
        .groupBy(*keys)
        .agg(*[F.sum(c).alias(c) for c in counts], known_cost(cost).alias("cost_micro"))
    )


def run_available(stream: DataFrame, write, mode: str, folder: str) -> None:
    """Feed everything available to a ``foreachBatch`` function."""
    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain_updates(stream: DataFrame, name: str, keys: list[str], folder: str | None = None) -> DataFrame:
    """Run an update stream over everything available; the last version of each key stays.

    With the ``folder`` of an earlier run the stream goes on where that one ended.

    Every batch is written under its own number, so a repeated batch replaces
    itself.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    run_available(stream, write, "update", folder)
    rows = spark.read.parquet(f"{folder}/rows")
    rest = [f.name for f in stream.schema if f.name not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return newest.select(*keys, "row.*")
