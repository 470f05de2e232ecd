"""Agent-A logs to canonical events.

Input: lines ``(file_path, modified, chunk, pos, value)``. Each JSON line is
parsed once into a narrow row; the text of tool results never leaves the scan
stage. Callers that need both events and file attributes keep the parsed rows
(``session.cut_lineage``): they are a small part of the log.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterstone.functions.fixed_prices import SYNTHETIC
from meterstone.functions.jsonline import is_number_or_flag, whole_number, with_object
from meterstone.functions.pricebook import BUILTIN, PriceBook
from meterstone.functions.text import clean_prompt, nonempty
from meterstone.functions.timebucket import with_local_bucket
from meterstone.operators.chunked import running
from meterstone.schemas import EVENTS
from meterstone.sources.logs import below, project_dir, session_id_a

AGENT = "claude_code"

ENTRY = (
    "struct<type:string,timestamp:string,cwd:string,gitBranch:string,"
    "message:struct<id:string,model:string,content:string,usage:string>>"
)
# Counts come as numbers of any form, or as text.
USAGE = "map<string,string>"
CWD_LINES = 11


def in_project(root: str) -> Column:
    """Logs lie in a project folder; files directly below the root are none."""
    return F.instr(below(root, F.col("file_path")), "/") > 0


def content_items(value: Column, content: Column) -> Column:
    """Items of ``message.content`` when it is an array, NULL when it is text.

    Text that merely looks like an array must not count as one, so the line is
    read again with an array type, which text does not satisfy.
    """
    as_array = F.from_json(value, "struct<message:struct<content:array<string>>>")
    return F.when(content.startswith("["), as_array["message"]["content"])


def is_object(value: Column, content: Column) -> Column:
    """True when ``message.content`` is a single JSON object."""
    as_map = F.from_json(value, "struct<message:struct<content:map<string,string>>>")
    return content.startswith("{") & as_map["message"]["content"].isNotNull()


def parse_lines(lines: DataFrame) -> DataFrame:
    """One narrow row per line.

    Blank and broken lines parse to nothing: they keep their place in the file,
    are of kind ``other`` and carry no value any operator would pick up.
    """
    entry = F.col("e")
    content = F.coalesce(entry["message"]["content"], F.lit(""))
    user = entry["type"] == "user"
    assistant = entry["type"] == "assistant"
    tool_result = F.coalesce(
        F.exists("items", lambda i: F.get_json_object(i, "$.type") == "tool_result"),
        F.lit(False),
    )
    usage_text = F.coalesce(entry["message"]["usage"], F.lit(""))
    usage = F.col("u")
    parsed = with_object(lines, ENTRY, "e").withColumns(
        {
            "items": F.when(user, content_items(F.col("value"), content)),
            "u": F.when(
                assistant & usage_text.startswith("{") & (usage_text != "{}"),
                F.from_json(usage_text, USAGE),
            ),
        }
    )
    is_text = (
        F.col("items").isNull()
        & ~is_object(F.col("value"), content)
        & ~is_number_or_flag(F.col("value"), "message.content", content)
    )
    turn = user & ~tool_result

    def counter(c: Column) -> Column:
        return F.coalesce(whole_number(c), F.lit(0).cast("bigint"))

    long_writes = F.from_json(usage["cache_creation"], USAGE)

    return parsed.select(
        "file_path",
        "modified",
        "chunk",
        "pos",
        F.coalesce(entry["timestamp"], F.lit("")).alias("ts_text"),
        F.when(turn, "turn").when(assistant, "reply").otherwise("other").alias("kind"),
        nonempty(F.when(user, entry["gitBranch"])).alias("git_branch"),
        nonempty(entry["cwd"]).alias("cwd"),
        nonempty(F.when(turn & is_text, clean_prompt(content))).alias("prompt"),
        F.when(assistant, F.coalesce(entry["message"]["id"], F.lit(""))).alias("msg_id"),
        nonempty(F.when(assistant, entry["message"]["model"])).alias("msg_model"),
        usage.isNotNull().alias("has_usage"),
        counter(usage["input_tokens"]).alias("input_tokens"),
        counter(usage["output_tokens"]).alias("output_tokens"),
        counter(usage["cache_read_input_tokens"]).alias("cache_read_tokens"),
        counter(usage["cache_creation_input_tokens"]).alias("cache_creation_tokens"),
        counter(long_writes["ephemeral_1h_input_tokens"]).alias("cache_1h_tokens"),
    )


def with_bucket_model(rows: DataFrame) -> DataFrame:
    """The model a row is booked on.

    The current model is the newest real model so far, else the placeholder if
    it was seen, else empty. A reply keeps its own model, even the placeholder.
    """
    marked = rows.withColumns(
        {
            "real_model": F.when(F.col("msg_model") != SYNTHETIC, F.col("msg_model")),
            "placeholder": F.when(F.col("msg_model") == SYNTHETIC, F.lit(SYNTHETIC)),
        }
    )
    filled = running(marked, ["file_path"], "chunk", "pos", last=["real_model", "placeholder"])
    current = F.coalesce("real_model_run", "placeholder_run", F.lit(""))
    return filled.withColumns(
        {"model": F.coalesce(F.col("msg_model"), current), "current_model": current}
    ).drop("real_model", "placeholder", "real_model_run", "placeholder_run")


def surviving_events(rows: DataFrame) -> DataFrame:
    """One count and at most one usage row per message id.

    The count sits where the id was seen last, the usage is the last snapshot.
    Both are plain aggregates, so a heavily repeated id is combined before the
    shuffle. Turns and replies without id stand for themselves.
    """
    order = F.struct("chunk", "pos")
    place = ["ts_text", "usage_date", "usage_hour", "model"]
    tokens = [
        "input_tokens",
        "output_tokens",
        "cache_read_tokens",
        "cache_creation_tokens",
        "cache_1h_tokens",
    ]
    alone = (F.col("kind") == "turn") | (F.col("msg_id") == "")
    grouped = (
        rows.filter(F.col("kind").isin("turn", "reply"))
        .withColumns(
            {
                "self_chunk": F.when(alone, F.col("chunk")),
                "self_pos": F.when(alone, F.col("pos")),
            }
        )
        .groupBy("file_path", "kind", "msg_id", "self_chunk", "self_pos")
        .agg(
            F.max_by(F.struct(*place), order).alias("seen"),
            F.max_by(F.struct(*place, *tokens), F.when(F.col("has_usage"), order)).alias("used"),
        )
    )
    zero = F.lit(0).cast("bigint")
    turn = F.col("kind") == "turn"
    counted = F.struct(
        *[F.col(f"seen.{c}").alias(c) for c in place],
        F.lit(1).cast("bigint").alias("message_count"),
        F.when(turn, 1).otherwise(0).cast("bigint").alias("user_turns"),
        *[zero.alias(c) for c in tokens],
    )
    usage = F.struct(
        *[F.col(f"used.{c}").alias(c) for c in place],
        zero.alias("message_count"),
        zero.alias("user_turns"),
        *[F.coalesce(F.col(f"used.{c}"), zero).alias(c) for c in tokens],
    )
    both = F.when(F.col("used").isNull(), F.array(counted)).otherwise(F.array(counted, usage))
    return grouped.select("file_path", F.inline(both))


def events_a(parsed: DataFrame, as_of: date, book: PriceBook = BUILTIN) -> DataFrame:
    """Canonical events of parsed agent-A lines. ``as_of`` is the day of replies without a time."""
    reply = F.col("kind") == "reply"
    undated = F.col("usage_date").isNull()
    booked = with_bucket_model(parsed.filter(F.col("kind") != "other"))
    rows = with_local_bucket(booked, "ts_text").withColumns(
        {
            "usage_hour": F.when(reply & undated, F.lit(0)).otherwise(F.col("usage_hour")),
            "usage_date": F.when(reply & undated, F.lit(as_of)).otherwise(F.col("usage_date")),
        }
    )
    priced = book.with_cost(
        surviving_events(rows),
        "cost_micro",
        F.col("model"),
        F.col("input_tokens"),
        F.col("output_tokens"),
        F.col("cache_read_tokens"),
        F.col("cache_creation_tokens"),
        F.col("cache_1h_tokens"),
    )
    return priced.withColumn("agent_type", F.lit(AGENT)).select(*EVENTS.fieldNames())


def files_a(parsed: DataFrame, root: str) -> DataFrame:
    """What one log says about its session; aggregates only, no window."""
    order = F.struct("chunk", "pos")
    dated = F.when(F.col("ts_text") != "", order)
    real = F.when(F.col("msg_model") != SYNTHETIC, order)
    attributes = parsed.groupBy("file_path").agg(
        F.max("modified").alias("modified"),
        F.count_if(F.col("kind") == "turn").alias("user_turns"),
        F.min_by("ts_text", dated).alias("started_at"),
        F.max_by("ts_text", dated).alias("ended_at"),
        F.min_by("git_branch", F.when(F.col("git_branch").isNotNull(), order)).alias("git_branch"),
        F.min_by("prompt", F.when(F.col("prompt").isNotNull(), order)).alias("first_prompt"),
        F.max_by("prompt", F.when(F.col("prompt").isNotNull(), order)).alias("last_prompt"),
        F.max_by("msg_model", real).alias("real_model"),
        F.max(F.when(F.col("msg_model") == SYNTHETIC, F.lit(SYNTHETIC))).alias("placeholder"),
        F.min(F.when(F.col("cwd").isNotNull(), F.struct("chunk", "pos", "cwd"))).alias("cwd_at"),
        F.min(order).alias("first_line"),
    )
    # The working directory counts only on the first lines. Positions of one
    # split are consecutive, so the distance to its first line is the line number.
    near = (F.col("cwd_at.chunk") == F.col("first_line.chunk")) & (
        F.col("cwd_at.pos") - F.col("first_line.pos") < CWD_LINES
    )
    path = F.col("file_path")
    return attributes.select(
        F.lit(AGENT).alias("agent_type"),
        "file_path",
        session_id_a(root, path).alias("session_id"),
        "modified",
        F.coalesce(F.when(near, F.col("cwd_at.cwd")), project_dir(root, path)).alias(
            "project_path"
        ),
        F.coalesce("git_branch", F.lit("")).alias("git_branch"),
        F.coalesce("real_model", "placeholder", F.lit("")).alias("model"),
        "user_turns",
        F.coalesce("started_at", F.lit("")).alias("started_at"),
        F.coalesce("ended_at", F.lit("")).alias("ended_at"),
        F.coalesce("first_prompt", F.lit("")).alias("first_prompt"),
        F.coalesce("last_prompt", F.lit("")).alias("last_prompt"),
    )
