"""History sync: changed logs into the stored tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.functions.pricebook import PriceBook
from meterstone.operators.cube import chosen_files, not_older, session_rows, usage_buckets
from meterstone.operators.merge import fill_from_index
from meterstone.operators.pricing import reprice_sessions, reprice_usage
from meterstone.schemas import SESSION_KEY
from meterstone.session import cut_lineage, small_broadcasts, work_folder
from meterstone.sources.logs import index_sessions, read_session_index
from meterstone.sources.registry import LogSource, parse_all
from meterstone.sources.tables import TableStore

PRICE_KEY = "price_version"


@dataclass
class SyncResult:
    repriced: bool = False
    failed: dict[str, str] = field(default_factory=dict)


def reprice(store: TableStore, book: PriceBook) -> None:
    """Bring stored costs to the current book.

    Costs that the book leaves as they are stay untouched: only days with a changed bucket are
    written, and only key buckets with a changed session. Days are collected, as
    there are as many as the calendar has.
    """
    cost = F.col("cost_micro")
    usage = reprice_usage(store.usage().withColumn("old_cost", cost), book)
    changed = cut_lineage(usage.filter(~cost.eqNullSafe(F.col("old_cost"))).select(*SESSION_KEY, "usage_date"))
    days = sorted(r[0] for r in changed.select("usage_date").distinct().collect())
    # A session's cost is the sum of all its buckets, whichever of them changed.
    keys = changed.select(*SESSION_KEY).distinct()
    theirs = usage.drop("old_cost").join(keys, SESSION_KEY, "left_semi")
    stored = store.sessions()
    with_buckets = stored.filter("has_buckets").join(keys, SESSION_KEY, "left_semi")
    asked = with_buckets.unionByName(stored.filter("NOT has_buckets"))
    priced = reprice_sessions(asked.withColumn("old_cost", cost), theirs, book)
    moved = priced.filter(~cost.eqNullSafe(F.col("old_cost")))
    changes = cut_lineage(moved.select(*SESSION_KEY, "cost_micro", F.lit(True).alias("cost_is_set")))
    if days or not changes.isEmpty():
        store.rewrite_days(usage.drop("old_cost"), days, changes)


def sync_history(
    store: TableStore,
    sources: list[LogSource],
    as_of: date,
    book: PriceBook | None = None,
    index_root: str | None = None,
) -> SyncResult:
    """Read what changed, replace the buckets of the changed sessions and merge their rows.

    Manifest entries carry the price version: after a price change every log is
    new again and its requests are priced one by one. Without a ``book`` the one
    of the store, with its edits, is used. Usage and sessions change as one; what an
    interrupted sync has left is finished or dropped first.
    """
    with small_broadcasts(store.spark):
        return _sync(store, sources, as_of, book, index_root)


def _sync(store: TableStore, sources: list[LogSource], as_of: date, book: PriceBook | None, index_root: str | None) -> SyncResult:
    book = store.price_book() if book is None else book
    spark = store.spark
    work_folder(spark)  # without one nothing is begun
    store.recover()
    result = SyncResult()
    if store.setting(PRICE_KEY) not in (None, book.version):
        reprice(store, book)
        result.repriced = True
    manifest = store.manifest()
    parsed, result.failed = parse_all(spark, sources, manifest, as_of, book)
    index = None
    if index_root is not None:
        index = index_sessions(read_session_index(spark, index_root))
    if parsed is not None:
        chosen = cut_lineage(not_older(chosen_files(parsed.files), store.sessions()))
        fresh = cut_lineage(usage_buckets(parsed.hours, chosen))
        rows = session_rows(parsed.hours, chosen)
        if index is not None:
            changes = fill_from_index(only_new(index, store, rows), rows)
        else:
            changes = rows.withColumn("cost_is_set", F.lit(True))
        store.commit(chosen, fresh, cut_lineage(changes))
        store.put_manifest(parsed.seen)
    store.put_setting(PRICE_KEY, book.version)
    return result


def only_new(index: DataFrame, store: TableStore, rows: DataFrame) -> DataFrame:
    """What the index may still say: everything about sessions without a log, of the others
    stored earlier only the summary."""
    key = ["agent_type", "session_id"]
    logged = (
        store.sessions()
        .filter(F.col("user_turns") > 0)
        .select(*key)
        .join(rows.select(*key), key, "left_anti")
        .withColumn("logged", F.lit(True))
    )
    known = F.col("logged").isNotNull()
    held = {
        c: F.when(~known, F.col(c))
        for c in ("project_path", "git_branch", "started_at", "ended_at", "message_count")
    }
    return index.join(logged, key, "left").withColumns(held).drop("logged")
