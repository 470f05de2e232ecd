"""The stored tables (S10, S11): sessions, usage, file manifest and settings, as parquet.

``usage`` is partitioned by day, ``sessions`` by a hash of the key. A sync
rewrites the days and key buckets it touches and no others, in both tables or in none
(``intents``).
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterstone.functions.pricebook import PriceBook, as_price, as_prices
from meterstone.operators.merge import merge_sessions, replace_usage
from meterstone.operators.pricing import PRICE_COLS, book_from_rules, current_rules
from meterstone.schemas import PRICE, SESSION_KEY, SESSIONS, USAGE
from meterstone.sources.intents import Intents
from meterstone.sources.manifest import MANIFEST

SETTINGS = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]
)
PRICE_EDITS = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("threshold", T.LongType()),
        T.StructField("op", T.StringType()),
        *[T.StructField(c, PRICE) for c in (*PRICE_COLS, "write_1h")],
    ]
)
STORED_SESSIONS = T.StructType([*SESSIONS.fields, T.StructField("key_bucket", T.IntegerType())])


class TableStore:
    """Sessions and usage below one folder of a shared file system."""

    def __init__(self, spark: SparkSession, root: str, key_buckets: int = 64) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.key_buckets = key_buckets
        self.intents = Intents(spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.path(name))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def usage(self) -> DataFrame:
        return self._read("usage", USAGE)

    def sessions(self) -> DataFrame:
        return self._read("sessions", STORED_SESSIONS).drop(
            "key_bucket"
        )

    def _newest(self, name: str, schema: T.StructType, key: str) -> DataFrame:
        """Tables that only grow: of each key the row of the last version counts."""
        rows = self._read(name, T.StructType([*schema.fields, T.StructField("version", T.LongType())]))
        rest = [f.name for f in schema if f.name != key]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("row"))
        return newest.select(key, "row.*").select(*schema.fieldNames())

    def _append(self, name: str, schema: T.StructType, rows: DataFrame) -> None:
        """One commit: a crash leaves the old version whole."""
        versions = self._read(name, T.StructType([*schema.fields, T.StructField("version", T.LongType())]))
        last = versions.agg(F.max("version")).first()[0] or 0
        named = rows.select(*schema.fieldNames(), F.lit(last + 1).cast("bigint").alias("version"))
        named.write.mode("append").parquet(self.path(name))

    def manifest(self) -> DataFrame:
        return self._newest("manifest", MANIFEST, "file_path")

    def put_manifest(self, seen: DataFrame) -> None:
        """Note the files that were read, in the state they had."""
        self._append("manifest", MANIFEST, seen)

    def setting(self, key: str) -> str | None:
        row = self._newest("settings", SETTINGS, "key").filter(F.col("key") == key).first()
        return row.value if row else None

    def put_setting(self, key: str, value: str) -> None:
        if self.setting(key) != value:
            self._append("settings", SETTINGS, self.spark.createDataFrame([(key, value)], SETTINGS))

    def edit_prices(self, edits: list[dict]) -> None:
        """Add edits of the price rules, in order; they hold from the next sync on.

        An edit names ``kind`` (model, tier, cache, disable or all) and ``op`` (set or
        remove), and what the kind needs of ``model``, ``threshold``, ``prices`` (four)
        and ``write_1h``.
        """
        last = self._read("price_edits", PRICE_EDITS).agg(F.max("version")).first()[0] or 0
        rows = []
        for version, edit in enumerate(edits, last + 1):
            # Mistakes show here and not in a later sync.
            prices = as_prices(edit["prices"]) if "prices" in edit else (None,) * 4
            write = as_price(edit["write_1h"]) if "write_1h" in edit else None
            rows.append(
                (version, edit["kind"], edit.get("model"), edit.get("threshold"), edit["op"], *prices, write)
            )
        self.spark.createDataFrame(rows, PRICE_EDITS).write.mode("append").parquet(self.path("price_edits"))

    def price_book(self) -> PriceBook:
        """The book with the edits made so far."""
        return book_from_rules(current_rules(self._read("price_edits", PRICE_EDITS)))

    def key_bucket(self):
        return F.pmod(F.hash(*SESSION_KEY), F.lit(self.key_buckets))

    # ── writes ───────────────────────────────────────────────────────────

    def _stage_days(self, rows: DataFrame, intent: str) -> None:
        """Write the days that occur in ``rows``; file sizes are left to adaptive rebalancing."""
        rows.hint("rebalance", "usage_date").write.partitionBy("usage_date").parquet(f"{intent}/usage")

    def _stage_sessions(self, rows: DataFrame, intent: str) -> None:
        keyed = rows.withColumn("key_bucket", self.key_bucket()).hint("rebalance", "key_bucket")
        keyed.write.partitionBy("key_bucket").parquet(f"{intent}/sessions")

    def _days_of(self, changed: DataFrame, fresh: DataFrame) -> set[date]:
        """Days with old or new buckets of the changed sessions.

        The session table knows the days of a session; where a row does not, the days are
        looked for in the usage table, from the first one on. Days are collected as
        literals: there are as many as the calendar has.
        """
        keys = changed.select(*SESSION_KEY).distinct()
        held = self.sessions().filter("has_buckets").join(keys, SESSION_KEY, "left_semi")
        named = held.select(F.explode("usage_days").alias("usage_date"))
        new = fresh.select("usage_date").unionByName(named).distinct()
        days: set[date] = {r[0] for r in new.collect()}
        unknown = held.filter(F.col("usage_days").isNull())
        since = unknown.agg(
            F.count("*").alias("rows"),
            F.min("first_usage_date").alias("first"),
            F.count_if(F.col("first_usage_date").isNull()).alias("undated"),
        ).first()
        if since.rows:
            old = self.usage()
            if not since.undated:
                old = old.filter(F.col("usage_date") >= F.lit(since.first))
            mine = old.join(unknown.select(*SESSION_KEY), SESSION_KEY, "left_semi")
            days |= {r[0] for r in mine.select("usage_date").distinct().collect()}
        return days

    def replace_usage(self, changed: DataFrame, fresh: DataFrame) -> None:
        """Swap the buckets of the changed sessions; only days with some are rewritten."""
        self.commit(changed, fresh)

    def merge_sessions(self, changes: DataFrame) -> None:
        """Upsert sessions; only key buckets with changes are rewritten."""
        self.commit(changes=changes)

    def commit(
        self,
        changed: DataFrame | None = None,
        fresh: DataFrame | None = None,
        changes: DataFrame | None = None,
    ) -> None:
        """S11 and S10 as one: the ``fresh`` buckets of the ``changed`` sessions, and ``changes`` of session
        rows. After a crash ``recover`` finds all of it or nothing."""
        intent, emptied = self.intents.begin(), []
        if changed is not None:
            days = self._days_of(changed, fresh)
            touched = self.usage().filter(F.col("usage_date").isin(sorted(days)))
            if days:
                self._stage_days(replace_usage(touched, changed, fresh), intent)
            left = set(self.intents.staged(intent, "usage"))
            emptied = sorted({f"usage_date={d}" for d in days} - left)
        if changes is not None:
            self._stage_merged(changes, intent)
        self.intents.commit(intent, {"usage": emptied})

    def _stage_merged(self, changes: DataFrame, intent: str) -> None:
        buckets = [r[0] for r in changes.select(self.key_bucket().alias("b")).distinct().collect()]
        if buckets:
            stored = self._read("sessions", STORED_SESSIONS)
            touched = stored.filter(F.col("key_bucket").isin(buckets)).drop("key_bucket")
            self._stage_sessions(merge_sessions(touched, changes), intent)

    def rewrite_days(self, usage: DataFrame, days: list[date], changes: DataFrame) -> None:
        """Replace ``days`` by their rows in ``usage`` and merge ``changes`` of session rows, as one."""
        intent = self.intents.begin()
        if days:
            self._stage_days(usage.filter(F.col("usage_date").isin(days)), intent)
        self._stage_merged(changes, intent)
        self.intents.commit(intent, {})

    def recover(self) -> list[str]:
        """Finish or drop what an interrupted commit has left."""
        return self.intents.recover()
