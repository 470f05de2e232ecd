"""Log sources and their union.

A source turns the changed files below its folder into canonical events and log
attributes. Anything that yields these two frames can be registered.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterstone.functions.pricebook import BUILTIN, PriceBook
from meterstone.operators import log_a, log_b
from meterstone.operators.cube import hourly
from meterstone.schemas import LOG_FILES
from meterstone.session import cut_lineage, small_files
from meterstone.sources.manifest import (
    STAMP,
    changed_files,
    list_files,
    read_changed,
    read_files,
)

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Parsed:
    """Summed events and log attributes of a source, and the file states they come from."""

    hours: DataFrame
    files: DataFrame
    seen: DataFrame


Normaliser = Callable[[DataFrame, date, PriceBook], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class LogSource:
    name: str
    root: str
    glob: str
    normalise: Normaliser
    #: Which files of the listing are logs at all, by their path.
    is_log: Callable[[], Column] = lambda: F.lit(True)


def agent_a(root: str) -> LogSource:
    def normalise(lines: DataFrame, as_of: date, book: PriceBook):
        parsed = cut_lineage(log_a.parse_lines(lines))
        return log_a.events_a(parsed, as_of, book), log_a.files_a(parsed, root)

    return LogSource(log_a.AGENT, root, "*.jsonl", normalise, lambda: log_a.in_project(root))


def agent_b(root: str) -> LogSource:
    def normalise(lines: DataFrame, as_of: date, book: PriceBook):
        parsed = cut_lineage(log_b.parse_lines(lines))
        resolved = cut_lineage(log_b.settled(log_b.resolve_state(parsed)))
        return log_b.events_b(resolved, book), log_b.files_b(resolved)

    return LogSource(log_b.AGENT, root, "rollout-*.jsonl", normalise)


def parse_source(
    spark: SparkSession,
    source: LogSource,
    manifest: DataFrame,
    as_of: date,
    book: PriceBook = BUILTIN,
) -> Parsed:
    """Parse what changed below a source. Runs its jobs, so that a failure shows here."""
    with small_files(spark):
        listing = list_files(spark, source.root, source.glob, book.version).filter(source.is_log())
        seen = cut_lineage(changed_files(listing, manifest).select(*STAMP))
        lines = read_changed(spark, source.root, source.glob, seen)
        events, files = source.normalise(lines, as_of, book)
    read = cut_lineage(files.select(*LOG_FILES.fieldNames()))
    return Parsed(cut_lineage(hourly(events)), read, read_files(seen, read))


def parse_all(
    spark: SparkSession,
    sources: list[LogSource],
    manifest: DataFrame,
    as_of: date,
    book: PriceBook = BUILTIN,
) -> tuple[Parsed | None, dict[str, str]]:
    """The union of all sources; one that fails is reported and left out."""
    failed: dict[str, str] = {}
    whole: Parsed | None = None
    for source in sources:
        try:
            part = parse_source(spark, source, manifest, as_of, book)
        except Exception as error:  # a broken source must not stop the others
            log.warning("source %s failed: %s", source.name, error)
            failed[source.name] = str(error)
            continue
        whole = part if whole is None else Parsed(
            whole.hours.unionByName(part.hours, allowMissingColumns=True),
            whole.files.unionByName(part.files, allowMissingColumns=True),
            whole.seen.unionByName(part.seen),
        )
    return whole, failed
