"""The given tables in the shapes the engine reads.

``events`` becomes a request log, usage buckets, sessions and JSON log lines;
``conversations`` becomes a turn log. Everything runs over whole tables.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterstone.functions.measures import poisoned_cost
from meterstone.functions.pricebook import BUILTIN, PriceBook
from meterstone.operators.chunked import chunk_of, running
from meterstone.operators.usage import COLUMNS, usage_source
from meterstone.schemas import COUNTERS, TOKEN_COLS

AS_OF = date(2024, 1, 30)
NOON = datetime(2024, 1, 30, 12, 0)
FIRST, LAST = date(2024, 1, 5), date(2024, 1, 28)

# A user book that touches every kind of rule.
OWN_BOOK = PriceBook.of(
    models={"gpt-5.4-pro": (30, 180, 0, 0), "claude-opus-4-7": (4, 20, 0.4, 5)},
    tiers={
        "claude-opus": [(100_000, (6, 30, 0.6, 7)), (300_000, (8, 40, 0.8, 9))],
        "gpt-5.4": [(400_000, (7, 25, 0.7, 0))],
    },
    write_1h={"claude": 9},
    disabled=["gpt-5.4"],
)

# Model names that exercise every matching rule, picked by event.
MODEL_NAMES = (
    "claude-sonnet-4-6", "claude-sonnet-4-20250514", "claude-opus-4-1-20250805", "claude-opus-4x",
    "claude-4.5-sonnet-thinking", "codex-auto-review", "gpt-5.4-mini-2026", "gpt-5.4", "gpt-5.4-pro",
    "gpt-5.40", "gpt-5-pro-x", "gpt-5.2-chat-latest-b", "gemini-2.5-flash-lite-001",
    "gemini-2.5-pro-exp", "<synthetic>", "", "mystery-1", "gpt-5.5-2026",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, whole numbers as bigint, decimals as double."""
    out = {}
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind in ("date", "timestamp", "timestamp_ntz"):
            out[f.name] = F.col(f.name).cast("string")
        elif kind in ("int", "smallint", "tinyint"):
            out[f.name] = F.col(f.name).cast("bigint")
        elif kind.startswith("decimal"):
            out[f.name] = F.col(f.name).cast("double")
    return df.withColumns(out) if out else df


def requests(spark: SparkSession, sf: str, book: PriceBook = BUILTIN) -> DataFrame:
    """One priced request per event."""
    return requests_of(table(spark, sf, "events"), book)


def requests_of(events: DataFrame, book: PriceBook = BUILTIN) -> DataFrame:
    e, user = F.col("event_id"), F.col("user_id")
    kind = F.col("event_type")
    rows = events.select(
        "event_id",
        "user_id",
        "ts",
        F.concat(F.lit("u"), user.cast("string"), F.lit("-"), (e % 3).cast("string")).alias(
            "session_id"
        ),
        F.when(user % 2 == 0, "claude_code").otherwise("codex").alias("agent_type"),
        F.when(kind == "view", "claude-sonnet-4-20250514")
        .when(kind == "click", "gpt-5.4")
        .when(kind == "purchase", "gpt-5.4-pro")
        .when(kind == "signup", "claude-opus-4-7")
        .otherwise("<synthetic>")
        .alias("model"),
        F.when(user % 7 == 0, "")
        .otherwise(F.concat(F.lit("/p/"), (user % 7).cast("string")))
        .alias("project_path"),
        F.lit(1).cast("bigint").alias("message_count"),
        F.when(e % 4 == 0, 1).otherwise(0).cast("bigint").alias("user_turns"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("input_tokens"),
        (F.get_json_object("props", "$.k").cast("bigint") * 10).alias("output_tokens"),
        ((e % 50) * 100).alias("cache_read_tokens"),
        ((e % 11) * 10).alias("cache_creation_tokens"),
        F.to_date("ts").alias("usage_date"),
        F.hour("ts").alias("usage_hour"),
    )
    return book.with_cost(rows, "cost_micro", F.col("model"), *[F.col(c) for c in TOKEN_COLS])


def stamp(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


BUCKET = ["session_id", "agent_type", "usage_date", "usage_hour", "project_path", "model"]


def all_buckets(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*BUCKET).agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        poisoned_cost(F.col("cost_micro")).alias("cost_micro"),
    )


def buckets(rows: DataFrame) -> DataFrame:
    """Usage buckets; the sessions of every tenth user have none yet."""
    return all_buckets(rows.filter(F.col("user_id") % 10 != 3))


def sessions(rows: DataFrame) -> DataFrame:
    """Session rows; every third user's session does not know its model, another third's only
    the placeholder."""
    user = F.col("user_id")
    return (
        rows.groupBy("session_id", "agent_type", "user_id", "project_path")
        .agg(
            F.max_by("model", "event_id").alias("last_model"),
            *[F.sum(c).alias(c) for c in COUNTERS],
            poisoned_cost(F.col("cost_micro")).alias("cost_micro"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
        .select(
            "session_id",
            "agent_type",
            "user_id",
            "project_path",
            F.when(user % 5 == 0, "main").otherwise("").alias("git_branch"),
            F.when(user % 3 == 0, "")
            .when(user % 3 == 1, "<synthetic>")
            .otherwise(F.col("last_model"))
            .alias("model"),
            *COUNTERS,
            "cost_micro",
            stamp(F.col("first_ts")).alias("started_at"),
            stamp(F.col("last_ts")).alias("ended_at"),
            F.concat(F.lit("first "), F.col("session_id")).alias("first_prompt"),
            F.concat(F.lit("last "), F.col("session_id")).alias("last_prompt"),
            F.lit("").alias("summary"),
            F.to_date("first_ts").alias("started_date"),
            F.hour("first_ts").alias("started_hour"),
        )
    )


def stored_sessions(rows: DataFrame) -> DataFrame:
    """Session rows as the session table holds them."""
    held = F.col("user_id") % 10 != 3
    first = F.when(held, F.col("started_date"))
    return (
        sessions(rows)
        .withColumns(
            {
                "has_buckets": held,
                "first_usage_date": first,
                "usage_days": F.lit(None).cast("array<date>"),
                "log_modified": F.lit(None).cast("timestamp"),
                "log_path": F.lit(None).cast("string"),
            }
        )
        .drop("user_id")
    )


def source(spark: SparkSession, sf: str, book: PriceBook = BUILTIN) -> DataFrame:
    """The usage source every report reads, with sessions as the session table holds them."""
    rows = requests(spark, sf, book)
    return usage_source(buckets(rows), stored_sessions(rows)).select(*COLUMNS)


# ── JSON logs ────────────────────────────────────────────────────────────


def log_frame(rows: DataFrame, slot: int, slots: int, content) -> DataFrame:
    return rows.select(
        F.concat(F.lit("/logs/proj/"), F.col("session_id"), F.lit(".jsonl")).alias("file_path"),
        F.to_timestamp(F.lit("2024-02-01 00:00:00")).alias("modified"),
        chunk_of(F.col("event_id")).alias("chunk"),
        (F.col("event_id") * slots + slot).alias("pos"),
        F.to_json(content).alias("value"),
    )


def week_id():
    week = F.to_date(F.date_trunc("week", "ts")).cast("string")
    return F.concat(F.col("session_id"), F.lit("-"), week)


def lines_a(rows: DataFrame) -> DataFrame:
    """Agent-A log lines: a human turn for every fourth event and a reply for each.

    All replies of one session and week carry one message id, so that only the
    last snapshot of the week counts.
    """
    mine = rows.filter(F.col("agent_type") == "claude_code")
    turn = F.struct(
        F.lit("user").alias("type"),
        stamp(F.col("ts")).alias("timestamp"),
        F.lit("main").alias("gitBranch"),
        F.col("project_path").alias("cwd"),
        F.struct(
            F.concat(F.lit("<b>ask</b> "), F.col("event_id").cast("string")).alias("content")
        ).alias("message"),
    )
    half = F.floor(F.col("cache_creation_tokens") / 2)
    reply = F.struct(
        F.lit("assistant").alias("type"),
        stamp(F.col("ts")).alias("timestamp"),
        F.col("project_path").alias("cwd"),
        F.struct(
            week_id().alias("id"),
            "model",
            F.struct(
                "input_tokens",
                "output_tokens",
                F.col("cache_read_tokens").alias("cache_read_input_tokens"),
                F.col("cache_creation_tokens").alias("cache_creation_input_tokens"),
                F.struct(half.alias("ephemeral_1h_input_tokens")).alias("cache_creation"),
            ).alias("usage"),
        ).alias("message"),
    )
    turns = log_frame(mine.filter(F.col("event_id") % 4 == 0), 0, 2, turn)
    return turns.unionByName(log_frame(mine, 1, 2, reply))


def lines_b(rows: DataFrame) -> DataFrame:
    """Agent-B log lines with cumulative counters, gaps in them, and forked sessions.

    Every fifth user's sessions are forks whose first three events are replay:
    their first turn context comes with the fourth.
    """
    mine = rows.filter(F.col("agent_type") == "codex").withColumns(
        {
            "chunk": chunk_of(F.col("event_id")),
            "one": F.lit(1).cast("bigint"),
            "raw": F.col("input_tokens") + F.col("cache_read_tokens"),
        }
    )
    counted = running(
        mine,
        ["session_id"],
        "chunk",
        "event_id",
        total=["one", "raw", "cache_read_tokens", "output_tokens"],
    ).withColumn("forked", F.col("user_id") % 5 == 0)
    event = F.col("event_id")
    time = stamp(F.col("ts")).alias("timestamp")
    meta = F.struct(
        F.lit("session_meta").alias("type"),
        time,
        F.struct(
            F.col("session_id").alias("id"),
            F.col("project_path").alias("cwd"),
            F.when(F.col("forked"), "parent").alias("forked_from_id"),
        ).alias("payload"),
    )
    context = F.struct(
        F.lit("turn_context").alias("type"),
        time,
        F.struct(F.when(F.col("model") != "<synthetic>", F.col("model")).alias("model")).alias(
            "payload"
        ),
    )
    said = F.when(event % 4 == 0, "user_message").otherwise("agent_message")
    message = F.struct(
        F.lit("event_msg").alias("type"),
        time,
        F.struct(
            said.alias("type"),
            F.concat(F.lit("  ask "), event.cast("string"), F.lit("\n")).alias("message"),
        ).alias("payload"),
    )
    total = F.struct(
        F.when(event % 5 != 0, F.col("raw_run")).alias("input_tokens"),
        F.when(event % 7 != 0, F.col("cache_read_tokens_run")).alias("cached_input_tokens"),
        F.col("output_tokens_run").alias("output_tokens"),
    )
    request = F.when(
        event % 3 == 0,
        F.struct(
            F.col("raw").alias("input_tokens"),
            F.col("cache_read_tokens").alias("cached_input_tokens"),
            "output_tokens",
        ),
    )
    report = F.struct(
        F.lit("event_msg").alias("type"),
        time,
        F.struct(
            F.lit("token_count").alias("type"),
            F.struct(
                total.alias("total_token_usage"), request.alias("last_token_usage")
            ).alias("info"),
        ).alias("payload"),
    )
    live = ~F.col("forked") | (F.col("one_run") > 3)
    every = F.array(
        *[
            F.struct(F.lit(slot).alias("slot"), F.when(keep, F.to_json(part)).alias("value"))
            for slot, keep, part in (
                (0, F.col("one_run") == 1, meta),
                (1, live, context),
                (2, F.lit(True), message),
                (3, F.lit(True), report),
            )
        ]
    )
    return (
        counted.select("session_id", "event_id", "chunk", F.inline(every))
        .filter(F.col("value").isNotNull())
        .select(
            F.concat(F.lit("/logs/2024/rollout-"), F.col("session_id"), F.lit(".jsonl")).alias(
                "file_path"
            ),
            F.to_timestamp(F.lit("2024-02-01 00:00:00")).alias("modified"),
            "chunk",
            (event * 4 + F.col("slot")).alias("pos"),
            "value",
        )
    )


def turn_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The turn log as agent-A lines: user and assistant turns; system turns are other entries."""
    role = F.col("role")
    entry = F.struct(
        role.alias("type"),
        F.struct(
            F.col("text").alias("content"),
            F.when(role == "assistant", F.concat_ws("-", F.col("conv_id"), F.col("turn"))).alias(
                "id"
            ),
        ).alias("message"),
    )
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("/logs/proj/c"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias(
            "file_path"
        ),
        F.to_timestamp(F.lit("2024-02-01 00:00:00")).alias("modified"),
        chunk_of(F.col("turn")).alias("chunk"),
        F.col("turn").alias("pos"),
        F.to_json(entry).alias("value"),
    )
