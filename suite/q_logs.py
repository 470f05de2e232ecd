"""Log normalisation queries (S5-S8, N): tables written as JSON log lines and read back.

The oracles compute the same numbers from the tables, without any log.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from meterstone.functions.measures import dollars
from meterstone.functions.text import WHITESPACE, clean_message, clean_prompt
from meterstone.functions.timebucket import duration_minutes
from meterstone.operators import log_a, log_b
from meterstone.operators.cube import (
    as_of_day,
    chosen_files,
    hourly,
    session_rows,
    usage_buckets,
)
from meterstone.operators.merge import STORAGE
from meterstone.schemas import COUNTERS
from meterstone.session import cut_lineage
from suite.queries import query
from suite.sqlbase import BASE, POISON, RATES, TOKENS, cost, price, sums, tokens, usd
from suite.views import AS_OF, lines_a, lines_b, requests, table, turn_lines

ROOT = "/logs"


def session_of(path):
    return F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)


# ── Turn log ─────────────────────────────────────────────────────────────


def trimmed(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def clean_sql(x: str) -> str:
    """N3 in SQL."""
    clean = trimmed(f"regexp_replace({x}, '<[^>]+>', '', 'g')")
    return f"""left(CASE WHEN starts_with({clean}, 'Caveat:') OR starts_with({clean}, 'login') THEN
      coalesce(list_filter(list_transform(string_split({clean}, chr(10)), lambda l: {trimmed('l')}),
        lambda l: length(l) > 2 AND NOT starts_with(l, 'Caveat:') AND NOT starts_with(l, 'login')
          AND NOT starts_with(l, 'init'))[1], '') ELSE {clean} END, 80)"""


@query(
    "n02_turns",
    """SELECT concat('c', conv_id) AS session, CAST(count(*) FILTER (WHERE role = 'user') AS BIGINT)
    AS user_turns, CAST(count(*) FILTER (WHERE role IN ('user', 'assistant')) AS BIGINT)
    AS message_count FROM conversations GROUP BY conv_id""",
)
def turns_query(spark, sf):
    """Human turns and messages per conversation."""
    rows = log_a.parse_lines(turn_lines(spark, sf))
    return rows.groupBy(session_of(F.col("file_path")).alias("session")).agg(
        F.count_if(F.col("kind") == "turn").alias("user_turns"),
        F.count_if(F.col("kind").isin("turn", "reply")).alias("message_count"),
    )


@query(
    "n05_prompts",
    f"""SELECT concat('c', conv_id) AS session, coalesce(arg_min(p, turn) FILTER (WHERE p <> ''), '')
    AS first_prompt, coalesce(arg_max(p, turn) FILTER (WHERE p <> ''), '') AS last_prompt,
    CAST(count(*) AS BIGINT) AS user_turns
    FROM (SELECT conv_id, turn, {clean_sql('text')} AS p FROM conversations WHERE role = 'user')
    GROUP BY conv_id""",
)
def prompts_query(spark, sf):
    """First and last prompt of every conversation that has a human turn."""
    files = chosen_files(log_a.files_a(log_a.parse_lines(turn_lines(spark, sf)), ROOT))
    return files.select(
        F.col("session_id").alias("session"), "first_prompt", "last_prompt", "user_turns"
    )


NOISY = """CASE doc_id % 4 WHEN 0 THEN concat('<tag a=1>', 'Caveat: ', text) WHEN 1
  THEN concat('login', chr(10), ' init', chr(10), text) ELSE text END"""


def noisy(text):
    kind = F.col("doc_id") % 4
    return (
        F.when(kind == 0, F.concat(F.lit("<tag a=1>Caveat: "), text))
        .when(kind == 1, F.concat(F.lit("login\n init\n"), text))
        .otherwise(text)
    )


@query(
    "n03_prompt_clean",
    f"SELECT doc_id, {clean_sql('t')} AS prompt, left({trimmed('t')}, 80) AS message "
    f"FROM (SELECT doc_id, {NOISY} AS t FROM documents)",
)
def clean_query(spark, sf):
    """N3, N4 over whole texts."""
    text = noisy(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", clean_prompt(text).alias("prompt"), clean_message(text).alias("message")
    )


@query(
    "n21_duration",
    f"""WITH {BASE} SELECT session_id,
    greatest((epoch_us(date_trunc('second', max(ts))) - epoch_us(date_trunc('second', min(ts))))
      / 60000000.0::DOUBLE, 0.0) AS minutes FROM ev GROUP BY session_id""",
)
def duration_query(spark, sf):
    from suite.views import sessions

    return sessions(requests(spark, sf)).select(
        "session_id", duration_minutes(F.col("started_at"), F.col("ended_at")).alias("minutes")
    )


# ── Agent A ──────────────────────────────────────────────────────────────


def cost_1h(long_write: str) -> str:
    """Request cost with a 1h share of the cache writes at twice the input rate in force."""
    i, o, r, w = TOKENS
    over = f"{i} + {r} + {w} > rt.lim"

    def rate(k: str) -> str:
        return price(f"CASE WHEN {over} THEN rt.l{k} ELSE rt.{k} END")

    return (
        f"CASE WHEN {i} <= 0 AND {o} <= 0 AND {r} <= 0 AND {w} <= 0 THEN CAST(0 AS DECIMAL(38,6)) ELSE "
        f"CAST({tokens(i)} * {rate('i')} + {tokens(o)} * {rate('o')} + {tokens(r)} * {rate('r')} + "
        f"{tokens(f'({w} - {long_write})')} * {rate('w')} + {tokens(long_write)} * 2 * {rate('i')} "
        f"AS DECIMAL(38,6)) END"
    )


HALF = "CAST(floor(cache_creation_tokens / 2) AS BIGINT)"
LOGS_A = f"""{BASE}, {RATES},
a0 AS (
  SELECT ev.*, {cost_1h(HALF)} AS cost_micro,
    concat(session_id, '-', CAST(date_trunc('week', ts) AS DATE)) AS msg_id,
    coalesce(last_value(nullif(ev.model, '<synthetic>') IGNORE NULLS) OVER before,
      CASE WHEN count(*) OVER before > 0 THEN '<synthetic>' END, '') AS current_model
  FROM ev LEFT JOIN rates rt ON rt.model = ev.model WHERE agent_type = 'claude_code'
  WINDOW before AS (PARTITION BY session_id ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
a1 AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY event_id DESC) AS rn FROM a0),
ea AS (
  SELECT agent_type, session_id, ts, usage_date, usage_hour, current_model AS model,
    1 AS message_count, 1 AS user_turns, 0 AS input_tokens, 0 AS output_tokens,
    0 AS cache_read_tokens, 0 AS cache_creation_tokens, CAST(0 AS DECIMAL(38,6)) AS cost_micro
  FROM a1 WHERE event_id % 4 = 0
  UNION ALL
  SELECT agent_type, session_id, ts, usage_date, usage_hour, model, 1, 0, input_tokens,
    output_tokens, cache_read_tokens, cache_creation_tokens, cost_micro FROM a1 WHERE rn = 1
)"""

LOGS_B = f"""{BASE}, {RATES},
b0 AS (
  SELECT *, row_number() OVER w AS ln, user_id % 5 = 0 AS forked,
    sum(input_tokens + cache_read_tokens) OVER w AS craw, sum(cache_read_tokens) OVER w AS cc,
    sum(output_tokens) OVER w AS cout
  FROM ev WHERE agent_type = 'codex' WINDOW w AS (PARTITION BY session_id ORDER BY event_id)
),
b1 AS (
  SELECT *, forked AND ln <= 3 AS replay,
    coalesce(last_value(CASE WHEN event_id % 5 <> 0 THEN craw END IGNORE NULLS) OVER w, 0) AS rawf,
    coalesce(last_value(CASE WHEN event_id % 7 <> 0 THEN cc END IGNORE NULLS) OVER w, 0) AS ccf,
    coalesce(last_value(CASE WHEN NOT forked OR ln > 3 THEN nullif(model, '<synthetic>') END
      IGNORE NULLS) OVER w, '') AS now_model
  FROM b0 WINDOW w AS (PARTITION BY session_id ORDER BY event_id)
),
b2 AS (
  SELECT *, CASE WHEN forked THEN coalesce(max(rawf) FILTER (WHERE ln = 3) OVER s, 0) ELSE 0 END AS braw,
    CASE WHEN forked THEN coalesce(max(ccf) FILTER (WHERE ln = 3) OVER s, 0) ELSE 0 END AS bcc,
    CASE WHEN forked THEN coalesce(max(cout) FILTER (WHERE ln = 3) OVER s, 0) ELSE 0 END AS bout,
    lag(rawf, 1, 0) OVER w AS rawp, lag(ccf, 1, 0) OVER w AS ccp, lag(cout, 1, 0) OVER w AS coutp
  FROM b1 WINDOW s AS (PARTITION BY session_id), w AS (PARTITION BY session_id ORDER BY event_id)
),
b3 AS (
  SELECT *, greatest(greatest(rawf - braw, 0) - greatest(ccf - bcc, 0), 0)
      - greatest(greatest(rawp - braw, 0) - greatest(ccp - bcc, 0), 0) AS d_in,
    greatest(cout - bout, 0) - greatest(coutp - bout, 0) AS d_out,
    greatest(ccf - bcc, 0) - greatest(ccp - bcc, 0) AS d_read, 0 AS d_write, 0 AS no_write
  FROM b2 WHERE NOT replay
),
b4 AS (
  SELECT b3.*, coalesce(CASE WHEN event_id % 3 = 0 THEN
      {cost(('input_tokens', 'output_tokens', 'cache_read_tokens', 'no_write'))} END,
    {cost(('d_in', 'd_out', 'd_read', 'd_write'), 'FALSE')}) AS cost_micro
  FROM b3 LEFT JOIN rates rt ON rt.model = b3.now_model
),
eb AS (
  SELECT agent_type, session_id, ts, usage_date, usage_hour, now_model AS model, 1 AS message_count,
    CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS user_turns, 0 AS input_tokens,
    0 AS output_tokens, 0 AS cache_read_tokens, 0 AS cache_creation_tokens,
    CAST(0 AS DECIMAL(38,6)) AS cost_micro
  FROM b4
  UNION ALL
  SELECT agent_type, session_id, ts, usage_date, usage_hour, now_model, 0, 0, d_in, d_out, d_read,
    0, cost_micro
  FROM b4 WHERE d_in <> 0 OR d_out <> 0 OR d_read <> 0
)"""

BOTH = f"""{LOGS_A}, {LOGS_B.split(RATES + ',')[1]},
ab AS (SELECT * FROM ea UNION ALL SELECT * FROM eb),
hum AS (SELECT agent_type, session_id FROM ab GROUP BY ALL HAVING sum(user_turns) > 0),
hb AS (
  SELECT agent_type, session_id, usage_date, usage_hour, model, {sums()}, {POISON} AS cost_micro
  FROM ab JOIN hum USING (agent_type, session_id) GROUP BY ALL
),
dirs AS (
  SELECT DISTINCT agent_type, session_id, CASE WHEN project_path <> '' THEN project_path
    WHEN agent_type = 'claude_code' THEN '/logs/proj' ELSE '' END AS project_path FROM ev
)"""


@query(
    "s05_line_hygiene",
    f"""WITH {LOGS_A} SELECT session_id, CAST(count(*) FILTER (WHERE event_id % 7 <> 0) AS BIGINT)
    AS replies, CAST(coalesce(sum(output_tokens) FILTER (WHERE event_id % 7 <> 0), 0) AS BIGINT)
    AS output_tokens FROM a0 GROUP BY session_id""",
)
def hygiene_query(spark, sf):
    """Logs with a blank line behind every reply and every seventh reply cut short; all
    lines once more with something behind them, which makes them no lines at all."""
    lines = lines_a(requests(spark, sf))
    cut = (F.floor(F.col("pos") / 2) % 7 == 0) & (F.col("pos") % 2 == 1)
    broken = lines.withColumn(
        "value", F.when(cut, F.left("value", F.length("value") - 5)).otherwise(F.col("value"))
    )
    blank = lines.withColumn("value", F.lit("   "))
    value = F.col("value")
    tail = (
        F.when(F.col("pos") % 3 == 0, F.concat(value, F.lit(" garbage")))
        .when(F.col("pos") % 3 == 1, F.concat(value, value))
        .otherwise(F.concat(value, F.lit("] {}")))
    )
    longer = lines.withColumn("value", tail)
    rows = log_a.parse_lines(broken.unionByName(blank).unionByName(longer))
    return rows.groupBy(session_of(F.col("file_path")).alias("session_id")).agg(
        F.count_if(F.col("kind") == "reply").alias("replies"),
        F.sum("output_tokens").alias("output_tokens"),
    )


@query(
    "n06_model_ffill",
    f"WITH {LOGS_A} SELECT session_id, event_id, current_model AS model FROM a0 WHERE event_id % 4 = 0",
)
def model_query(spark, sf):
    """The model every human turn is booked on."""
    rows = log_a.with_bucket_model(log_a.parse_lines(lines_a(requests(spark, sf))))
    return rows.filter(F.col("kind") == "turn").select(
        session_of(F.col("file_path")).alias("session_id"),
        F.floor(F.col("pos") / 2).alias("event_id"),
        "model",
    )


def events_of_a(spark, sf):
    return log_a.events_a(cut_lineage(log_a.parse_lines(lines_a(requests(spark, sf)))), AS_OF)


@query(
    "n09_msg_count",
    f"""WITH {LOGS_A} SELECT session_id, CAST(usage_date AS VARCHAR) AS usage_date,
    CAST(usage_hour AS BIGINT) AS usage_hour, model, CAST(sum(message_count) AS BIGINT) AS messages,
    CAST(sum(user_turns) AS BIGINT) AS user_turns FROM ea GROUP BY ALL""",
)
def message_query(spark, sf):
    """Messages where their id was seen last."""
    return (
        events_of_a(spark, sf)
        .groupBy(
            session_of(F.col("file_path")).alias("session_id"), "usage_date", "usage_hour", "model"
        )
        .agg(F.sum("message_count").alias("messages"), F.sum("user_turns").alias("user_turns"))
    )


@query(
    "n10_last_snapshot",
    f"""WITH {LOGS_A} SELECT session_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, model,
    {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in TOKENS)}, {usd('cost_micro')} AS cost_usd
    FROM a1 WHERE rn = 1""",
)
def snapshot_query(spark, sf):
    """The surviving usage snapshot of every message id, with its 1h cache writes.

    A third of the lines write their counts as text, a third with a decimal point."""
    lines = lines_a(requests(spark, sf))
    form = F.floor(F.col("pos") / 2) % 3
    counts = r'(_tokens":)(\d+)'
    written = (
        F.when(form == 0, F.regexp_replace("value", counts, '$1"$2"'))
        .when(form == 1, F.regexp_replace("value", counts, "$1$2.0"))
        .otherwise(F.col("value"))
    )
    parsed = cut_lineage(log_a.parse_lines(lines.withColumn("value", written)))
    used = log_a.events_a(parsed, AS_OF).filter(F.col("message_count") == 0)
    return used.select(
        session_of(F.col("file_path")).alias("session_id"),
        F.col("ts_text").alias("at"),
        "model",
        *TOKENS,
        dollars(F.col("cost_micro")).alias("cost_usd"),
    )


# ── Agent B ──────────────────────────────────────────────────────────────


def state_of_b(spark, sf):
    return log_b.resolve_state(cut_lineage(log_b.parse_lines(lines_b(requests(spark, sf)))))


def session_of_b(path):
    return F.regexp_extract(path, r"rollout-([^/]+)\.jsonl$", 1)


@query(
    "n12_fork",
    f"""WITH {LOGS_B} SELECT session_id, event_id, replay, CASE WHEN replay THEN cout
    ELSE greatest(cout - bout, 0) END AS output_so_far FROM b2""".replace(
        "CASE WHEN replay THEN cout\n    ELSE greatest(cout - bout, 0) END",
        "CAST(CASE WHEN replay THEN cout ELSE greatest(cout - bout, 0) END AS BIGINT)",
    ),
)
def fork_query(spark, sf):
    """Replayed reports of forked logs, and what the fork itself has counted."""
    return (
        state_of_b(spark, sf)
        .filter(F.col("kind") == "tokens")
        .select(
            session_of_b(F.col("file_path")).alias("session_id"),
            F.floor(F.col("pos") / 4).alias("event_id"),
            "replay",
            F.col("out_now").alias("output_so_far"),
        )
    )


@query(
    "n13_n14_cumulative_delta",
    f"""WITH {LOGS_B} SELECT session_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, model,
    CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens,
    CAST(cache_read_tokens AS BIGINT) AS cache_read_tokens, {usd('cost_micro')} AS cost_usd
    FROM eb WHERE message_count = 0""",
)
def delta_query(spark, sf):
    """Steps of the cumulative counters and their cost."""
    events = log_b.events_b(state_of_b(spark, sf))
    return events.filter(F.col("message_count") == 0).select(
        session_of_b(F.col("file_path")).alias("session_id"),
        F.col("ts_text").alias("at"),
        "model",
        "input_tokens",
        "output_tokens",
        "cache_read_tokens",
        dollars(F.col("cost_micro")).alias("cost_usd"),
    )


# ── Buckets and sessions ─────────────────────────────────────────────────


def normalised(spark, sf):
    """Hours and chosen logs of both agents, as the history sync gets them."""
    rows = requests(spark, sf)
    parsed = cut_lineage(log_a.parse_lines(lines_a(rows)))
    parsed_b = cut_lineage(log_b.parse_lines(lines_b(rows)))
    resolved = cut_lineage(log_b.settled(log_b.resolve_state(parsed_b)))
    events = log_a.events_a(parsed, AS_OF).unionByName(log_b.events_b(resolved))
    files = log_a.files_a(parsed, ROOT).unionByName(log_b.files_b(resolved))
    return hourly(events), chosen_files(files)


BUSY = " OR ".join(f"{c} <> 0" for c in COUNTERS) + " OR coalesce(cost_micro, 0) <> 0"


@query(
    "n16_buckets",
    f"""WITH {BOTH} SELECT agent_type, session_id, CAST(usage_date AS VARCHAR) AS usage_date,
    CAST(usage_hour AS BIGINT) AS usage_hour, project_path, model, {', '.join(COUNTERS)},
    {usd('cost_micro')} AS cost_usd FROM hb JOIN dirs USING (agent_type, session_id)
    WHERE agent_type = 'codex' OR {BUSY}""",
)
def bucket_query(spark, sf):
    """Usage buckets of both agents, from their logs."""
    buckets = usage_buckets(*normalised(spark, sf))
    return buckets.withColumn("cost_usd", dollars(F.col("cost_micro"))).drop(
        "cost_micro", "cost_is_explicit"
    )


@query(
    "n19_sessions",
    f"""WITH {BOTH},
    life AS (SELECT agent_type, session_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS started_at,
      strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS ended_at,
      coalesce(arg_max(model, event_id) FILTER (WHERE model <> '<synthetic>'), '<synthetic>') AS last_a
      FROM ev GROUP BY ALL),
    said AS (SELECT session_id, min(event_id) AS f, max(event_id) AS l FROM a0 WHERE event_id % 4 = 0
      GROUP BY ALL UNION ALL SELECT session_id, min(event_id), max(event_id) FROM b4
      WHERE event_id % 4 = 0 GROUP BY ALL),
    lastb AS (SELECT session_id, arg_max(now_model, event_id) AS m FROM b4 GROUP BY ALL)
    SELECT agent_type, session_id, project_path,
      CASE WHEN agent_type = 'codex' THEN '' ELSE 'main' END AS git_branch,
      CASE WHEN agent_type = 'codex' THEN coalesce(m, '') ELSE last_a END AS model, {sums()},
      {usd(POISON)} AS cost_usd, started_at, ended_at, concat('ask ', f) AS first_prompt,
      concat('ask ', l) AS last_prompt
    FROM hb JOIN dirs USING (agent_type, session_id) JOIN life USING (agent_type, session_id)
      JOIN said USING (session_id) LEFT JOIN lastb USING (session_id)
    GROUP BY agent_type, session_id, project_path, last_a, m, started_at, ended_at, f, l""",
)
def session_query(spark, sf):
    """Session rows of both agents, from their logs."""
    rows = session_rows(*normalised(spark, sf))
    return rows.withColumn("cost_usd", dollars(F.col("cost_micro"))).drop(
        "cost_micro", "summary", "started_date", "started_hour", *STORAGE
    )


@query(
    "n20_asof_day",
    f"""WITH {BOTH} SELECT agent_type, session_id, {', '.join(
        f'CAST(sum({c}) AS BIGINT) AS today_{c}' for c in COUNTERS)},
    {usd(POISON)} AS today_cost_usd FROM hb
    WHERE usage_date = DATE '2024-01-29' AND (agent_type = 'codex' OR {BUSY})
    GROUP BY agent_type, session_id""",
)
def asof_query(spark, sf):
    """What every session did on one day of its life."""
    from datetime import date

    usage = usage_buckets(*normalised(spark, sf))
    rows = as_of_day(usage, date(2024, 1, 29))
    return rows.withColumn("today_cost_usd", dollars(F.col("today_cost_micro"))).drop(
        "today_cost_micro"
    )
