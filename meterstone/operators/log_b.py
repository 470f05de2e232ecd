"""Agent-B logs to canonical events.

Token counts in these logs are cumulative, a forked log first replays its
parent, and both need state in file order. The state is resolved per chunk with
one small carry row per (file, chunk), so no task holds a whole log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterstone.functions.jsonline import is_number_or_flag, whole_number, with_object
from meterstone.functions.pricebook import BUILTIN, PriceBook, constant
from meterstone.functions.text import clean_message, nonempty
from meterstone.functions.timebucket import with_local_bucket
from meterstone.schemas import EVENTS, LOG_FILES, MONEY
from meterstone.sources.logs import file_stem

AGENT = "codex"

ENTRY = (
    "struct<type:string,timestamp:string,payload:struct<"
    "id:string,cwd:string,forked_from_id:string,source:string,git:struct<branch:string>,"
    "model:string,type:string,message:string,"
    "info:struct<total_token_usage:map<string,string>,last_token_usage:map<string,string>>>>"
)
# Cumulative counters of a token report, by the name they get here.
READINGS = {
    "raw": "input_tokens",
    "cached": "cached_input_tokens",
    "out": "output_tokens",
    "create": "cache_creation_input_tokens",
}
COUNTERS = list(READINGS)


def parse_lines(lines: DataFrame) -> DataFrame:
    """One narrow row per line; broken lines stay as rows without any value."""
    e = F.col("e")
    payload = e["payload"]
    meta = e["type"] == "session_meta"
    context = e["type"] == "turn_context"
    message = e["type"] == "event_msg"
    tokens = message & (payload["type"] == "token_count")
    user = message & (payload["type"] == "user_message")
    kind = (
        F.when(meta, "meta")
        .when(context, "context")
        .when(user, "user")
        .when(message & (payload["type"] == "agent_message"), "agent")
        .when(tokens, "tokens")
        .otherwise("other")
    )
    subagent = F.coalesce(F.get_json_object(payload["source"], "$.subagent"), F.lit(""))
    forked = (F.coalesce(payload["forked_from_id"], F.lit("")) != "") | ~subagent.isin(
        "", "false", "0", "{}", "[]"
    )
    total = payload["info"]["total_token_usage"]
    # A message may be any JSON value; only text is a prompt. Text that looks like
    # an array or object is told apart by reading the line with that type.
    as_array = F.from_json("value", "struct<payload:struct<message:array<string>>>")
    as_map = F.from_json("value", "struct<payload:struct<message:map<string,string>>>")
    said = F.coalesce(payload["message"], F.lit(""))
    is_text = (
        F.when(said.startswith("["), as_array["payload"]["message"].isNull())
        .when(said.startswith("{"), as_map["payload"]["message"].isNull())
        .otherwise(~is_number_or_flag(F.col("value"), "payload.message", said))
    )
    parsed = with_object(lines, ENTRY, "e").select(
        "file_path",
        "modified",
        "chunk",
        "pos",
        F.coalesce(e["timestamp"], F.lit("")).alias("ts_text"),
        kind.alias("kind"),
        nonempty(F.when(meta, payload["id"])).alias("meta_id"),
        nonempty(F.when(meta, payload["cwd"])).alias("meta_cwd"),
        nonempty(F.when(meta, payload["git"]["branch"])).alias("meta_branch"),
        F.when(meta, forked).alias("meta_forked"),
        nonempty(F.when(context, payload["model"])).alias("ctx_model"),
        nonempty(F.when(user & is_text, clean_message(payload["message"]))).alias("prompt"),
        *[F.when(tokens, whole_number(total[source])).alias(name) for name, source in READINGS.items()],
        F.when(tokens, payload["info"]["last_token_usage"]).alias("request"),
    )
    return with_local_bucket(parsed, "ts_text")


def state_in_chunk(rows: DataFrame) -> DataFrame:
    """What is known at every row from its own chunk."""
    here = W.partitionBy("file_path", "chunk").orderBy("pos")
    upto = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = here.rowsBetween(W.unboundedPreceding, -1)
    is_context = F.col("kind") == "context"

    # A log takes its identity, and with it the fork flag, from the first meta
    # line that has an id; until there is one, the newest meta line decides.
    flagged = rows.withColumn(
        "id_forked", F.when(F.col("meta_id").isNotNull(), F.col("meta_forked"))
    )
    return flagged.withColumns(
        {
            **{f"{c}_here": F.last(c, True).over(upto) for c in COUNTERS},
            **{f"{c}_before": F.last(c, True).over(before) for c in COUNTERS},
            "model_here": F.last("ctx_model", True).over(upto),
            "id_forked_here": F.first("id_forked", True).over(upto),
            "any_forked_here": F.last("meta_forked", True).over(upto),
            "context_here": F.max(is_context).over(upto),
            "context_before": F.coalesce(F.max(is_context).over(before), F.lit(False)),
        }
    )


def chunk_ends(rows: DataFrame) -> DataFrame:
    """What each chunk of a log leaves behind: one small row per chunk, with its last place as ``end_pos``."""
    local = state_in_chunk(rows)
    is_context = F.col("kind") == "context"
    state = [*[f"{c}_here" for c in COUNTERS], "id_forked_here", "any_forked_here"]
    first_context = F.when(is_context & ~F.col("context_before"), F.struct("pos", *state))
    return local.groupBy("file_path", "chunk").agg(
        *[F.max_by(c, "pos").alias(c) for c in state],
        F.max_by("model_here", "pos").alias("model_here"),
        F.max("context_here").alias("has_context"),
        F.max(first_context).alias("at_context"),
        F.min_by("meta_id", F.when(F.col("meta_id").isNotNull(), F.col("pos"))).alias("id_here"),
        F.max("pos").alias("end_pos"),
    )


def carried_state(ends: DataFrame) -> DataFrame:
    """What each chunk of a log starts with, and ``base``, the fork baseline of the log, from its ``chunk_ends``.

    The baseline of a forked log is what the replayed part had counted when the
    first turn context ended it. A counter the fork has not reported yet thus
    stands at reading minus baseline = 0.
    """
    file = W.partitionBy("file_path").orderBy("chunk")
    earlier = file.rowsBetween(W.unboundedPreceding, -1)
    whole = file.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carried = ends.withColumns(
        {
            **{f"{c}_carry": F.last(f"{c}_here", True).over(earlier) for c in COUNTERS},
            "model_carry": F.last("model_here", True).over(earlier),
            "id_forked_carry": F.first("id_forked_here", True).over(earlier),
            "any_forked_carry": F.last("any_forked_here", True).over(earlier),
            "context_carry": F.coalesce(F.max("has_context").over(earlier), F.lit(False)),
        }
    )
    forked_at_context = F.coalesce(
        F.col("id_forked_carry"),
        F.col("at_context.id_forked_here"),
        F.col("at_context.any_forked_here"),
        F.col("any_forked_carry"),
        F.lit(False),
    )
    baseline = F.struct(
        *[
            F.when(
                forked_at_context,
                F.coalesce(F.col(f"at_context.{c}_here"), F.col(f"{c}_carry"), F.lit(0)),
            )
            .otherwise(F.lit(0))
            .cast("bigint")
            .alias(c)
            for c in COUNTERS
        ]
    )
    opens = F.col("at_context").isNotNull() & ~F.col("context_carry")
    return (
        carried.withColumn("base_here", F.when(opens, baseline))
        .withColumn("base", F.first("base_here", True).over(whole))
        .select(
            "file_path",
            "chunk",
            *[f"{c}_carry" for c in COUNTERS],
            "model_carry",
            "id_forked_carry",
            "any_forked_carry",
            "context_carry",
            "base",
        )
    )


def resolve_state(rows: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Current model, replay flag and counters before and after every row.

    Adds ``model``, ``replay`` and for each counter ``<c>_now`` and ``<c>_prev``:
    the newest reading less the fork baseline, floored at zero. ``base`` is the
    baseline of the log, NULL before its first turn context. ``carried`` is the
    ``carried_state`` of the rows, where the caller keeps it.
    """
    carry = carried_state(chunk_ends(rows)) if carried is None else carried
    joined = state_in_chunk(rows).join(carry, ["file_path", "chunk"], "left")
    seen_context = F.col("context_carry") | F.col("context_here")
    forked = F.coalesce(
        "id_forked_carry", "id_forked_here", "any_forked_here", "any_forked_carry", F.lit(False)
    )

    def counted(c: str, side: str) -> Column:
        base = F.when(seen_context, F.col(f"base.{c}")).otherwise(F.lit(0))
        reading = F.coalesce(F.col(f"{c}_{side}"), F.col(f"{c}_carry"), F.lit(0))
        return F.greatest(reading - F.coalesce(base, F.lit(0)), F.lit(0))

    return joined.select(
        *rows.columns,
        F.coalesce("model_here", "model_carry", F.lit("")).alias("model"),
        (forked & ~seen_context).alias("replay"),
        *[counted(c, "here").alias(f"{c}_now") for c in COUNTERS],
        *[counted(c, "before").alias(f"{c}_prev") for c in COUNTERS],
        "base",
    )


def settled(resolved: DataFrame) -> DataFrame:
    """Resolved rows without what only their state was made of: all that events and files need, for callers that keep it."""
    return resolved.drop(*COUNTERS, "base", "meta_forked")


def fresh_input(side: str) -> Column:
    """Input without its cached part."""
    return F.greatest(F.col(f"raw_{side}") - F.col(f"cached_{side}"), F.lit(0))


STEPS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"]


def with_step_cost(df: DataFrame, book: PriceBook) -> DataFrame:
    """Price the single request a token report describes, else the step of the counters.

    Only a described request has a size that request-size rates can apply to. A
    step that nowhere goes up is free even if the model has no price.
    """
    request = F.col("request")

    def part(key: str) -> Column:
        return F.coalesce(F.try_element_at(request, F.lit(key)).try_cast("bigint"), F.lit(0))

    telling = constant(["input_tokens", "output_tokens", "cached_input_tokens"], "array<string>")
    known = F.arrays_overlap(F.map_keys(request), telling)
    described = F.col("described")
    cached = part("cached_input_tokens")
    counts = {
        "input_tokens": F.greatest(part("input_tokens") - cached, F.lit(0)),
        "output_tokens": part("output_tokens"),
        "cache_read_tokens": cached,
        "cache_creation_tokens": part("cache_creation_input_tokens"),
    }
    basis = df.withColumn("described", F.coalesce(known, F.lit(False))).withColumns(
        {f"priced_{c}": F.when(described, counts[c]).otherwise(F.col(c)) for c in STEPS}
    )
    priced = book.with_cost(
        basis,
        "basis_cost",
        F.col("model"),
        *[F.col(f"priced_{c}") for c in STEPS],
        long_context=described,
    )
    idle = F.lit(True)
    for c in STEPS:
        idle = idle & (F.col(c) <= 0)
    cost = F.coalesce(F.col("basis_cost"), F.when(idle, F.lit(0).cast(MONEY)))
    return priced.withColumn("cost_micro", cost)


def events_b(resolved: DataFrame, book: PriceBook = BUILTIN) -> DataFrame:
    """Canonical events: turns, messages and the non-zero steps of the counters."""
    tokens = F.col("kind") == "tokens"
    turn = F.col("kind") == "user"
    steps = {
        "input_tokens": fresh_input("now") - fresh_input("prev"),
        "output_tokens": F.col("out_now") - F.col("out_prev"),
        "cache_read_tokens": F.col("cached_now") - F.col("cached_prev"),
        "cache_creation_tokens": F.col("create_now") - F.col("create_prev"),
    }
    zero = F.lit(0).cast("bigint")
    stepped = resolved.filter(
        ~F.col("replay") & F.col("kind").isin("user", "agent", "tokens")
    ).withColumns({c: F.when(tokens, steps[c]).otherwise(zero) for c in STEPS})
    moved = F.lit(False)
    for c in STEPS:
        moved = moved | (F.col(c) != 0)
    return (
        with_step_cost(stepped.filter(~tokens | moved), book)
        .withColumns(
            {
                "agent_type": F.lit(AGENT),
                "message_count": F.when(tokens, zero).otherwise(F.lit(1)),
                "user_turns": F.when(turn, F.lit(1)).otherwise(zero),
            }
        )
        .select(*EVENTS.fieldNames())
    )


def files_b(resolved: DataFrame) -> DataFrame:
    """What one log says about its session."""
    order = F.struct("chunk", "pos")

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)

    dated = F.when(F.col("ts_text") != "", order)
    spoken = F.when(~F.col("replay") & F.col("prompt").isNotNull(), order)
    attributes = resolved.groupBy("file_path").agg(
        F.max("modified").alias("modified"),
        F.count_if((F.col("kind") == "user") & ~F.col("replay")).alias("user_turns"),
        F.min_by("ts_text", dated).alias("started_at"),
        F.max_by("ts_text", dated).alias("ended_at"),
        F.min_by("prompt", spoken).alias("first_prompt"),
        F.max_by("prompt", spoken).alias("last_prompt"),
        first("meta_id"),
        first("meta_cwd"),
        first("meta_branch"),
        last("ctx_model"),
    )
    renamed = attributes.withColumns(
        {
            "agent_type": F.lit(AGENT),
            "session_id": F.coalesce(F.col("meta_id"), file_stem(F.col("file_path"))),
            "project_path": F.col("meta_cwd"),
            "git_branch": F.col("meta_branch"),
            "model": F.col("ctx_model"),
        }
    )
    text = [f.name for f in LOG_FILES if f.dataType.simpleString() == "string"]
    return renamed.fillna("", text).select(*LOG_FILES.fieldNames())
