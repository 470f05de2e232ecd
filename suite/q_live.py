"""Live and streaming queries (L)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meterstone.functions.measures import dollars, poisoned_cost
from meterstone.operators import live as live_ops
from meterstone.operators import log_b
from meterstone.schemas import COUNTERS, TOKEN_COLS
from meterstone.streaming.changes import drain_snapshots, summed_changes
from meterstone.session import cut_lineage, new_folder
from meterstone.sources.logs import file_stem
from meterstone.sources.tail import tail_lines
from meterstone.streaming.hourly import drain_updates, hourly_usage, late_writer, run_available, with_late
from meterstone.streaming.steps import drain_steps
from suite.logfiles import write_files
from suite.q_logs import LOGS_A, LOGS_B
from suite.queries import query
from suite.sqlbase import BASE, KNOWN, POISON, REQUESTS, SESSIONS, TOKENS, UNKNOWN, sums, tokens, usd
from suite.views import (
    AS_OF,
    NOON,
    all_buckets,
    lines_a,
    lines_b,
    requests,
    sessions,
    week_id,
)

KEYS = ["agent_type", "session_id"]


def live_rows(spark, sf):
    """Session state at noon; nobody computed day counters for every sixth user."""
    seen = requests(spark, sf).filter(F.col("ts") <= F.lit(NOON))
    rows = live_ops.live_snapshot(sessions(seen), all_buckets(seen), AS_OF)
    absent = F.col("user_id") % 6 == 0
    return rows.withColumns(
        {f"today_{c}": F.when(~absent, F.col(f"today_{c}")) for c in COUNTERS}
    )


def stored_rows(spark, sf):
    """Usage synced at ten."""
    return all_buckets(
        requests(spark, sf).filter(F.col("ts") <= F.to_timestamp(F.lit("2024-01-30 10:00:00")))
    )


TODAY = "usage_date = DATE '2024-01-30'"
LIVE = f"""{REQUESTS},
seen AS (SELECT * FROM req WHERE ts <= TIMESTAMP '2024-01-30 12:00:00'),
lv AS (
  SELECT agent_type, session_id, user_id,
    CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN '<synthetic>'
      ELSE arg_max(model, event_id) END AS model,
    {sums()}, max(ts) AS last_ts,
    {', '.join(f'''CAST(CASE WHEN user_id % 6 = 0 THEN sum({c}) ELSE
      coalesce(sum({c}) FILTER (WHERE {TODAY}), 0) END AS BIGINT) AS t_{c}''' for c in COUNTERS)}
  FROM seen GROUP BY agent_type, session_id, user_id
),
st0 AS (SELECT agent_type, session_id, usage_date, usage_hour, project_path, model, {sums()},
  {POISON} AS cost_micro FROM req WHERE ts <= TIMESTAMP '2024-01-30 10:00:00' GROUP BY ALL),
st AS (SELECT agent_type, session_id, {sums()}, {KNOWN} AS c, {UNKNOWN} AS n_unknown
  FROM st0 WHERE {TODAY} GROUP BY agent_type, session_id)"""


@query(
    "l04_snapshot",
    f"""WITH {LIVE} SELECT agent_type, session_id, {', '.join(COUNTERS)},
    {', '.join(f'CASE WHEN user_id % 6 <> 0 THEN t_{c} END AS today_{c}' for c in COUNTERS)} FROM lv""",
)
def snapshot_query(spark, sf):
    return live_rows(spark, sf).select(*KEYS, *COUNTERS, *[f"today_{c}" for c in COUNTERS])


@query(
    "l05_active",
    f"""WITH {LIVE} SELECT agent_type, session_id, strftime(last_ts, '%Y-%m-%dT%H:%M:%SZ')
    AS last_active FROM lv WHERE date_trunc('second', last_ts) >= TIMESTAMP '2024-01-30 12:00:00'
      - INTERVAL 3600 SECONDS AND user_turns > 0""",
)
def active_query(spark, sf):
    """L5 with a window of an hour, so that the small tables have active sessions."""
    rows = live_ops.recently_active(live_rows(spark, sf), NOON, seconds=3600)
    return rows.select(*KEYS, "last_active")


@query(
    "l06_active_count",
    f"WITH {LIVE} SELECT CAST(count(*) FILTER (WHERE user_turns > 0 OR output_tokens > 0) AS BIGINT) "
    f"AS active_count FROM lv",
)
def active_count_query(spark, sf):
    return live_ops.active_count(live_rows(spark, sf))


def live_cost() -> str:
    names = [f"t_{c}" for c in TOKENS]
    parts = " + ".join(
        f"{tokens(n)} * CAST(rt.{k} AS DECIMAL(12,6))" for n, k in zip(names, "iorw", strict=True)
    )
    idle = " AND ".join(f"{n} <= 0" for n in names)
    return f"CASE WHEN {idle} THEN CAST(0 AS DECIMAL(38,6)) ELSE CAST({parts} AS DECIMAL(38,6)) END"


ADDED = f"""{LIVE},
now AS (SELECT lv.*, {live_cost()} AS t_cost FROM lv LEFT JOIN rates rt ON rt.model = lv.model),
added AS (
  SELECT n.agent_type, CASE WHEN st.session_id IS NULL THEN 1 ELSE 0 END AS session_count,
    {', '.join(f'''CASE WHEN st.session_id IS NULL THEN t_{c}
      ELSE greatest(t_{c} - st.{c}, 0) END AS {c}''' for c in COUNTERS)},
    CASE WHEN t_cost IS NULL THEN 0 WHEN st.session_id IS NULL THEN t_cost
      ELSE greatest(t_cost - st.c, CAST(0 AS DECIMAL(38,6))) END AS cost_micro,
    CASE WHEN st.session_id IS NULL THEN CASE WHEN t_cost IS NULL THEN 1 ELSE 0 END
      ELSE greatest(CASE WHEN t_cost IS NULL THEN 1 ELSE 0 END - st.n_unknown, 0) END AS n_unknown
  FROM now n LEFT JOIN st USING (agent_type, session_id)
  WHERE CASE WHEN st.session_id IS NULL THEN n.user_turns <> 0 OR n.output_tokens <> 0
    ELSE n.output_tokens > 0 END
)"""
SUMMED = (
    "CAST(sum(session_count) AS BIGINT) AS session_count, "
    + sums()
    + f", {usd('sum(cost_micro)')} AS estimated_cost_usd, CAST(sum(n_unknown) AS BIGINT) "
    + "AS unknown_cost_count"
)


def stored_sql(keys: str, where: str) -> str:
    return (
        f"SELECT {keys}, {SESSIONS} AS session_count, {sums()}, {KNOWN} AS cost_micro, "
        f"{UNKNOWN} AS n_unknown FROM st0 WHERE {where} GROUP BY {keys}"
    )


@query(
    "l07_merge_overview",
    f"""WITH {ADDED} SELECT agent_type, {SUMMED} FROM ({stored_sql('agent_type', TODAY)}
    UNION ALL BY NAME SELECT * FROM added) GROUP BY GROUPING SETS ((agent_type), ())""",
)
def overview_query(spark, sf):
    return live_ops.overview_with_live(stored_rows(spark, sf), live_rows(spark, sf), AS_OF)


@query(
    "l08_merge_trend",
    f"""WITH {ADDED} SELECT CAST(usage_date AS VARCHAR) AS usage_date, {SUMMED} FROM (
    {stored_sql('usage_date', "usage_date >= DATE '2024-01-20'")} UNION ALL BY NAME
    SELECT DATE '2024-01-30' AS usage_date, * EXCLUDE (agent_type) FROM added) x
    GROUP BY x.usage_date""",
)
def trend_query(spark, sf):
    return live_ops.trend_with_live(
        stored_rows(spark, sf), live_rows(spark, sf), AS_OF, days=10
    )


# ── Streams ──────────────────────────────────────────────────────────────


def fed(rows, order: str, drain, batches: int = 4):
    """What ``drain(stream, folder)`` gives after so many runs, before each of which a part of
    the rows, in the order of a column, has been added to the stream by as many tasks as there are."""
    spark = rows.sparkSession
    base = new_folder(spark, "stream")
    held = cut_lineage(rows)
    low, high = held.agg(F.min(order), F.max(order)).first()
    step = (high - low) // batches + 1
    for k in range(batches):
        part = held.filter(F.col(order).between(low + k * step, low + (k + 1) * step - 1))
        # By the order itself: dealing rows out in turn would sort them all first.
        part.repartition(spark.sparkContext.defaultParallelism, order).write.mode("append").parquet(f"{base}/in")
        out = drain(spark.readStream.schema(held.schema).parquet(f"{base}/in"), f"{base}/out")
    return out


@query(
    "l01_tail",
    f"""WITH {BASE}, l AS (
      SELECT session_id, ts, event_id, unnest(CASE WHEN event_id % 4 = 0 THEN [0, 1] ELSE [1] END) AS slot
      FROM ev WHERE agent_type = 'claude_code')
    SELECT session_id, CASE slot WHEN 0 THEN 'user' ELSE 'assistant' END AS type,
      strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, CAST(1 AS BIGINT) AS times,
      CAST(row_number() OVER (PARTITION BY session_id ORDER BY event_id, slot) AS BIGINT) AS line FROM l""",
)
def tail_query(spark, sf):
    """L1: log files that grow twice, with a line half written at each end, read by three runs of
    one stream; every line, its place and how often it was read."""
    base = new_folder(spark, "tail")
    lines = cut_lineage(lines_a(requests(spark, sf)))
    name = F.concat(F.lit("proj/"), F.substring_index("file_path", "/", -1))
    lines = lines.select(name.alias("file"), "pos", "value")
    low, high = lines.agg(F.min("pos"), F.max("pos")).first()
    for part in (1, 2, 3):
        end = low + (high - low) * part // 3
        unfinished = lines.filter(F.col("pos") > end).groupBy("file").agg(F.min("pos").alias("next"))
        now = lines.join(unfinished, "file", "left").filter(
            (F.col("pos") <= end) | (F.col("pos") == F.col("next"))
        )
        write_files(now.withColumn("whole", F.col("pos") <= end), f"{base}/logs")
        stream = tail_lines(spark, f"{base}/logs", pieceBytes=str(1 << 16))

        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{base}/lines/batch={number}")

        run_available(stream, write, "append", base)
    told = F.from_json("value", "type string, timestamp string")
    keys = ["file_path", "pos", "type", "at"]
    read = (
        spark.read.parquet(f"{base}/lines")
        .select("file_path", "pos", told["type"].alias("type"), told["timestamp"].alias("at"))
        .groupBy(*keys)
        .agg(F.count("*").alias("times"))
    )
    order = Window.partitionBy("file_path").orderBy("pos")
    return read.select(
        file_stem(F.col("file_path")).alias("session_id"),
        "type",
        "at",
        "times",
        F.row_number().over(order).cast("bigint").alias("line"),
    )


@query(
    "l02_stream_snapshot",
    f"""WITH {LOGS_A.replace("WHERE agent_type = 'claude_code'", "")},
    last AS (SELECT * EXCLUDE (cost_micro, i, o, r, w), {{cost}} AS cost_micro FROM a1
      LEFT JOIN rates rt2(rm, i, o, r, w, lim, li, lo, lr, lw) ON rm = model WHERE rn = 1)
    SELECT agent_type, session_id, CAST(usage_date AS VARCHAR) AS usage_date,
      CAST(usage_hour AS BIGINT) AS usage_hour, model, {sums(TOKENS)}, {usd(POISON)} AS cost_usd
    FROM last GROUP BY agent_type, session_id, last.usage_date, last.usage_hour, model""".replace(
        "* EXCLUDE (cost_micro, i, o, r, w)", "a1.* EXCLUDE (cost_micro)"
    ).replace(
        "{cost}",
        "CASE WHEN input_tokens <= 0 AND output_tokens <= 0 AND cache_read_tokens <= 0 AND "
        "cache_creation_tokens <= 0 THEN CAST(0 AS DECIMAL(38,6)) ELSE CAST("
        + " + ".join(
            f"{tokens(c)} * CAST(CASE WHEN input_tokens + cache_read_tokens + cache_creation_tokens "
            f"> lim THEN l{k} ELSE {k} END AS DECIMAL(12,6))"
            for c, k in zip(TOKENS, "iorw", strict=True)
        )
        + " AS DECIMAL(38,6)) END",
    ),
)
def stream_snapshot_query(spark, sf):
    """L2: snapshots as a stream of several batches; the sum of its changes against the
    last snapshots."""
    rows = requests(spark, sf).select(
        *KEYS,
        week_id().alias("msg_id"),
        F.col("event_id").alias("seq"),
        "usage_date",
        "usage_hour",
        "model",
        *TOKEN_COLS,
    )
    changes = fed(rows, "seq", lambda stream, folder: drain_snapshots(stream, folder, slots=32))
    return summed_changes(changes).withColumn("cost_usd", dollars(F.col("cost_micro"))).drop(
        "cost_micro"
    )


@query(
    "l03_stream_delta",
    f"""WITH {LOGS_B} SELECT agent_type, session_id, CAST(usage_date AS VARCHAR) AS usage_date,
    CAST(usage_hour AS BIGINT) AS usage_hour, model, {sums()}, {usd(POISON)} AS cost_usd
    FROM eb GROUP BY agent_type, session_id, eb.usage_date, eb.usage_hour, model""",
)
def stream_delta_query(spark, sf):
    """L3: parsed agent-B rows as a stream of several batches; its steps summed per bucket."""
    rows = log_b.parse_lines(lines_b(requests(spark, sf)))
    steps = fed(rows, "pos", lambda stream, folder: drain_steps(stream, folder=folder, gather=2))
    session = F.regexp_extract("file_path", r"rollout-([^/]+)\.jsonl$", 1)
    keys = ["agent_type", session.alias("session_id"), "usage_date", "usage_hour", "model"]
    return (
        steps.groupBy(*keys)
        .agg(
            *[F.sum(c).alias(c) for c in COUNTERS],
            poisoned_cost(F.col("cost_micro")).alias("cost_micro"),
        )
        .withColumn("cost_usd", dollars(F.col("cost_micro")))
        .drop("cost_micro")
    )


@query(
    "l09_stream_hourly",
    f"""WITH {REQUESTS} SELECT CAST(usage_date AS VARCHAR) AS usage_date, CAST(usage_hour AS BIGINT)
    AS usage_hour, agent_type, model, {sums()}, {UNKNOWN} AS unknown_cost_count,
    {usd(KNOWN)} AS estimated_cost_usd FROM req GROUP BY req.usage_date, req.usage_hour, agent_type,
    model""",
)
def stream_hourly_query(spark, sf):
    """Hourly usage kept by a watermarked aggregation, over several runs; rows held back to the last
    one come too late for it and are added from their own table."""
    rows = requests(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    held_back = (F.col("event_id") % 29 == 0).cast("bigint") * F.lit(1 << 40)
    keys = ["usage_date", "usage_hour", "agent_type", "model"]
    place = F.row_number().over(Window.partitionBy(F.pmod("event_id", F.lit(64))).orderBy(held_back, "event_id"))

    def drain(stream, folder):
        run_available(stream, late_writer(folder), "append", f"{folder}/late_query")
        latest = drain_updates(hourly_usage(stream), "hourly", keys, f"{folder}/hourly")
        return with_late(latest, spark.read.parquet(f"{folder}/late"))

    total = fed(rows.withColumn("place", place), "place", drain)
    return total.withColumn("estimated_cost_usd", dollars(F.col("cost_micro"))).drop("cost_micro")
