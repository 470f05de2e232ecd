"""Table layouts shared by sources, operators and sinks.

Costs are kept as exact decimals in micro-dollars (tokens times USD per million
tokens), so that sums do not depend on the order in which Spark adds rows.
``NULL`` means "cannot be priced", ``0`` means free.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(38, 6)
PRICE = T.DecimalType(12, 6)
TOKENS = T.DecimalType(20, 0)

COUNTERS = [
    "message_count",
    "user_turns",
    "input_tokens",
    "output_tokens",
    "cache_read_tokens",
    "cache_creation_tokens",
]
TOKEN_COLS = COUNTERS[2:]
SESSION_KEY = ["agent_type", "session_id"]
BUCKET_KEY = [*SESSION_KEY, "usage_date", "usage_hour", "model"]

SESSION_TEXT = [
    "project_path",
    "git_branch",
    "model",
    "started_at",
    "ended_at",
    "first_prompt",
    "last_prompt",
    "summary",
]

# Looked-up prices: whole micro-dollars per million tokens.
PRICES_TYPE = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in ("input", "output", "cache_read", "cache_write")
    ]
)

USAGE = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("agent_type", T.StringType()),
        T.StructField("usage_date", T.DateType()),
        T.StructField("usage_hour", T.IntegerType()),
        T.StructField("project_path", T.StringType()),
        T.StructField("model", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in COUNTERS],
        T.StructField("cost_micro", MONEY),
        T.StructField("cost_is_explicit", T.BooleanType()),
    ]
)

SESSIONS = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("agent_type", T.StringType()),
        T.StructField("project_path", T.StringType()),
        T.StructField("git_branch", T.StringType()),
        T.StructField("model", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in COUNTERS],
        T.StructField("cost_micro", MONEY),
        T.StructField("started_at", T.StringType()),
        T.StructField("ended_at", T.StringType()),
        T.StructField("first_prompt", T.StringType()),
        T.StructField("last_prompt", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("started_date", T.DateType()),
        T.StructField("started_hour", T.IntegerType()),
        T.StructField("has_buckets", T.BooleanType()),
        T.StructField("first_usage_date", T.DateType()),
        T.StructField("usage_days", T.ArrayType(T.DateType())),
        T.StructField("log_modified", T.TimestampType()),
        T.StructField("log_path", T.StringType()),
    ]
)

# One canonical event: a priced request, a counted message or a human turn.
EVENTS = T.StructType(
    [
        T.StructField("agent_type", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("ts_text", T.StringType()),
        T.StructField("usage_date", T.DateType()),
        T.StructField("usage_hour", T.IntegerType()),
        T.StructField("model", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in COUNTERS],
        T.StructField("cost_micro", MONEY),
    ]
)

# Per-log attributes, one row per log file.
LOG_FILES = T.StructType(
    [
        T.StructField("agent_type", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("project_path", T.StringType()),
        T.StructField("git_branch", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("user_turns", T.LongType()),
        T.StructField("started_at", T.StringType()),
        T.StructField("ended_at", T.StringType()),
        T.StructField("first_prompt", T.StringType()),
        T.StructField("last_prompt", T.StringType()),
    ]
)

INDEX_ENTRIES = T.StructType(
    [
        T.StructField("sessionId", T.StringType()),
        T.StructField("projectPath", T.StringType()),
        T.StructField("gitBranch", T.StringType()),
        T.StructField("messageCount", T.LongType()),
        T.StructField("created", T.StringType()),
        T.StructField("modified", T.StringType()),
        T.StructField("summary", T.StringType()),
    ]
)
