"""Message snapshots as a stream of signed changes (L1, L2).

Input contract: every event is one immutable record with its session and a sequence number.

The newest snapshot of every message is keyed state of Spark's own: a map in RocksDB from page to some
tens of messages, of which a batch reads and writes the pages its messages are on and no others. Messages end after a time.
Snapshots that replace another one take it back. The sum of the changes per bucket is
what the batch operator computes, so a sink only has to add up.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meterstone.functions.measures import poisoned_cost
from meterstone.functions.pricebook import BUILTIN, PriceBook
from meterstone.functions.timebucket import with_local_bucket
from meterstone.operators import log_a
from meterstone.schemas import TOKEN_COLS
from meterstone.session import new_folder
from meterstone.sources.logs import session_id_a
from meterstone.streaming.hourly import run_available

PLACE = ["usage_date", "usage_hour", "model"]
KEY = ["agent_type", "session_id", "msg_id"]
LONG_WRITES = "cache_1h_tokens"
COUNTS = [*TOKEN_COLS, LONG_WRITES]
VALUES = ["seq", *PLACE, *COUNTS]
# Days pass through Python as numbers: dates would be made one by one.
VALUE_TYPES = "seq long, usage_date int, usage_hour int, model string, " + ", ".join(f"{c} long" for c in COUNTS)
CHANGES = "sign long, " + ", ".join(f"{c} string" for c in KEY) + ", " + VALUE_TYPES

#: Messages are dealt over so many maps by a hash, so that a busy session is on all executors.
SLOTS = 256
#: Messages of a page, about: a call for state costs as much as reading so many of them.
PAGE = 64
#: A message not seen for so long is over; a snapshot that still comes counts as a new message.
KEPT_MS = 7 * 24 * 3600 * 1000

#: What keyed state needs: RocksDB with a changelog, and no empty batches that would only wait for the clock.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Settings of streams with keyed state, for those that start inside."""
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class NewestSnapshot(StatefulProcessor):
    """Per slot a map: page -> its messages, each with its newest snapshot, its cell and when it was put.

    The lowest bits of a message's cell, a hash, say on which page it is. Before pages hold more
    than ``PAGE`` messages each they are split, so neither a page nor what a message costs grows with the state.
    """

    def __init__(self, kept_ms: int | None):
        self.kept_ms = kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("newest", "page int", "messages binary", self.kept_ms)
        # How many pages there are, a power of two, and how many messages those of the last batch had.
        self.size = handle.getValueState("size", "pages int, mean double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = last_of_batch(rows)
        pages, mean = self.size.get() if self.size.exists() else (1, 0.0)
        more = pages
        while mean * pages + len(batch) > PAGE * more:
            more *= 2
        named: dict[int, list] = {}
        for name, (cell, new) in batch.items():
            named.setdefault(cell & (pages - 1), []).append((name, cell, new))
        now, out, seen, count = timerValues.getCurrentProcessingTimeInMs(), [], 0, 0
        for page in named if more == pages else range(pages):
            there = self.held.containsKey((page,))
            messages = self.live(pickle.loads(self.held.getValue((page,))[0]), now) if there else {}
            told = len(out)
            for name, cell, new in named.get(page, ()):
                old = messages.get(name)
                if old is not None and old[2][0] >= new[0]:
                    continue
                out.append((1, *name, *new))
                if old is not None:
                    out.append((-1, *name, *old[2]))
                messages[name] = (cell, now, new)
            parts: dict[int, dict] = {page: messages}
            if more > pages:
                parts = {page: {}}
                for name, message in messages.items():
                    parts.setdefault(message[0] & (more - 1), {})[name] = message
            if more > pages or len(out) > told:
                self.put(parts, there)
            seen, count = seen + more // pages, count + len(messages)
        self.size.update((more, count / seen))
        if out:
            yield pd.DataFrame(out, columns=["sign", *KEY, *VALUES])

    def live(self, messages: dict, now: int) -> dict:
        """Those of a page that have not ended; the page itself ends when its last one has."""
        if self.kept_ms is None:
            return messages
        return {name: message for name, message in messages.items() if now < message[1] + self.kept_ms}

    def put(self, parts: dict[int, dict], there: bool) -> None:
        for page, messages in parts.items():
            if messages:
                self.held.updateValue((page,), (pickle.dumps(messages, 5),))
            elif there:
                self.held.removeKey((page,))

    def close(self) -> None:
        pass


def last_of_batch(rows: Iterator[pd.DataFrame]) -> dict[tuple, tuple]:
    """Message -> cell and last snapshot: no other of a batch meets the state."""
    batch: dict[tuple, tuple] = {}
    for part in rows:
        last = part.sort_values("seq", ascending=False, kind="stable").drop_duplicates(KEY)
        names, values = last[KEY].itertuples(index=False, name=None), last[VALUES].itertuples(index=False, name=None)
        for name, cell, value in zip(names, last["cell"].tolist(), values, strict=True):
            if name not in batch or value[0] > batch[name][1][0]:
                batch[name] = cell, value
    return batch


def whole_snapshots(rows: DataFrame) -> DataFrame:
    """The columns the state holds; missing counts are zero, missing names empty."""
    long_writes = F.col(LONG_WRITES) if LONG_WRITES in rows.columns else F.lit(0)
    counts = {c: F.col(c) for c in TOKEN_COLS} | {LONG_WRITES: long_writes}
    return rows.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in KEY],
        F.col("seq").cast("long").alias("seq"),
        F.col("usage_date").cast("date").alias("usage_date"),
        F.coalesce(F.col("usage_hour").cast("int"), F.lit(0)).alias("usage_hour"),
        F.coalesce("model", F.lit("")).alias("model"),
        *[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(name) for name, c in counts.items()],
    )


def snapshot_changes(snapshots: DataFrame, kept_ms: int | None = KEPT_MS, slots: int = SLOTS) -> DataFrame:
    """L2: the stream of ``snapshots`` as a stream of signed usage rows, ``sign`` 1 or -1.

    Rows need ``agent_type, session_id, msg_id, seq``, the bucket (a day; rows without one take no part) and the tokens;
    1h cache writes may be given. Of a message the snapshot of highest ``seq`` counts,
    in whatever batches and order they come. ``slots`` must stay what it was
    when a stream is started again; the stream must start inside ``keyed_state``.
    """
    rows = whole_snapshots(snapshots).where("usage_date IS NOT NULL AND seq IS NOT NULL")
    slot = F.pmod(F.xxhash64(*KEY), F.lit(slots)).alias("slot")
    changes = (
        rows.withColumn("usage_date", F.unix_date("usage_date"))
        .select(slot, F.hash(*KEY).alias("cell"), "*")
        .groupBy("slot")
        .transformWithStateInPandas(
            NewestSnapshot(kept_ms), CHANGES, "Update", "ProcessingTime" if kept_ms else "None"
        )
    )
    return changes.withColumn("usage_date", F.date_from_unix_date("usage_date"))


def write_changes(changes: DataFrame, folder: str) -> None:
    """Run ``changes`` over everything available, into ``<folder>/changes``, one table for
    each batch; called again with the same folder, go on where it ended. A repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.drop("msg_id", "seq").write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    with keyed_state(changes.sparkSession):
        run_available(changes, write, "update", folder)


def drain_snapshots(snapshots: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Run a stream of snapshots over everything available; all its changes so far."""
    spark = snapshots.sparkSession
    folder = folder or new_folder(spark, "snapshots")
    write_changes(snapshot_changes(snapshots, **options), folder)
    return spark.read.parquet(f"{folder}/changes").drop("batch")


def line_snapshots(lines: DataFrame, root: str) -> DataFrame:
    """Snapshots of the replies among agent-A ``lines`` of ``sources.tail``, as ``snapshot_changes`` takes them.

    A reply without id is a message of its own, named by its place. Replies without a day or
    without usage are left out; one without a model is booked on ``''``. The place in the
    file is the sequence number.
    """
    no = F.lit(None)
    parsed = log_a.parse_lines(
        lines.select("file_path", no.cast("timestamp").alias("modified"), F.col("head").alias("chunk"), "pos", "value")
    )
    replies = parsed.where((F.col("kind") == "reply") & F.col("has_usage") & log_a.in_project(root))
    named = F.when(F.col("msg_id") != "", F.col("msg_id"))
    placed = F.concat_ws("@", F.col("chunk").cast("string"), F.col("pos").cast("string"))
    return with_local_bucket(replies, "ts_text").select(
        F.lit(log_a.AGENT).alias("agent_type"),
        session_id_a(root, F.col("file_path")).alias("session_id"),
        F.coalesce(named, placed).alias("msg_id"),
        F.col("pos").alias("seq"),
        "usage_date",
        "usage_hour",
        F.coalesce("msg_model", F.lit("")).alias("model"),
        *COUNTS,
    )


def summed_changes(changes: DataFrame, book: PriceBook = BUILTIN) -> DataFrame:
    """Buckets from accumulated snapshot changes: a taken-back row is priced like the row it
    takes back, so the pair cancels out."""
    priced = book.with_cost(
        changes, "cost_micro", F.col("model"), *[F.col(c) for c in COUNTS]
    )
    # A pair of added and taken-back rows cancels before the poison test sees it.
    net = priced.groupBy(
        "agent_type", "session_id", *PLACE, *COUNTS, "cost_micro"
    ).agg(F.sum("sign").alias("net"))
    return (
        net.filter(F.col("net") != 0)
        .groupBy("agent_type", "session_id", *PLACE)
        .agg(
            *[F.sum(F.col("net") * F.col(c)).alias(c) for c in TOKEN_COLS],
            poisoned_cost((F.col("cost_micro") * F.col("net")).cast("decimal(38,6)")).alias(
                "cost_micro"
            ),
        )
    )
