"""Shared SQL of the oracles: the same views, written independently in DuckDB SQL."""

from __future__ import annotations

COUNTERS = (
    "message_count", "user_turns", "input_tokens", "output_tokens",
    "cache_read_tokens", "cache_creation_tokens",
)
TOKENS = COUNTERS[2:]

BASE = """
ev AS (
  SELECT event_id, user_id, ts,
    concat('u', user_id, '-', event_id % 3) AS session_id,
    CASE WHEN user_id % 2 = 0 THEN 'claude_code' ELSE 'codex' END AS agent_type,
    CASE event_type WHEN 'view' THEN 'claude-sonnet-4-20250514' WHEN 'click' THEN 'gpt-5.4'
      WHEN 'purchase' THEN 'gpt-5.4-pro' WHEN 'signup' THEN 'claude-opus-4-7'
      ELSE '<synthetic>' END AS model,
    CASE WHEN user_id % 7 = 0 THEN '' ELSE concat('/p/', user_id % 7) END AS project_path,
    1 AS message_count,
    CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS user_turns,
    CAST(floor(value * 1000) AS BIGINT) AS input_tokens,
    CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS output_tokens,
    (event_id % 50) * 100 AS cache_read_tokens,
    (event_id % 11) * 10 AS cache_creation_tokens,
    CAST(ts AS DATE) AS usage_date, CAST(hour(ts) AS INT) AS usage_hour
  FROM events
)"""

# model, base in/out/read/write, threshold, long in/out/read/write
RATES = """
rates(model, i, o, r, w, lim, li, lo, lr, lw) AS (VALUES
  ('claude-sonnet-4-20250514', 3.0, 15.0, 0.3, 3.75, 200000, 6.0, 22.5, 0.6, 7.5),
  ('gpt-5.4', 2.5, 15.0, 0.25, 0.0, 272000, 5.0, 22.5, 0.5, 0.0),
  ('claude-opus-4-7', 5.0, 25.0, 0.5, 6.25, NULL, NULL, NULL, NULL, NULL),
  ('<synthetic>', 0.0, 0.0, 0.0, 0.0, NULL, NULL, NULL, NULL, NULL)
)"""


def price(column: str) -> str:
    return f"CAST({column} AS DECIMAL(12,6))"


def tokens(column: str) -> str:
    return f"CAST({column} AS DECIMAL(20,0))"


def cost(names: tuple[str, str, str, str], long_context: str = "TRUE", rates: str = "rt") -> str:
    """Cost of four counters with the joined rate row; NULL without a rate, 0 without usage."""
    i, o, r, w = names
    over = f"({long_context}) AND {i} >= 0 AND {r} >= 0 AND {w} >= 0 AND {i} + {r} + {w} > {rates}.lim"

    def rate(k: str) -> str:
        return price(f"CASE WHEN {over} THEN {rates}.l{k} ELSE {rates}.{k} END")

    amount = " + ".join(f"{tokens(c)} * {rate(k)}" for c, k in ((i, "i"), (o, "o"), (r, "r"), (w, "w")))
    idle = " AND ".join(f"{c} <= 0" for c in names)
    return (
        f"CASE WHEN {idle} THEN CAST(0 AS DECIMAL(38,6)) ELSE CAST({amount} AS DECIMAL(38,6)) END"
    )


def usd(expression: str) -> str:
    return f"CAST(CAST({expression} AS VARCHAR) AS DOUBLE) / 1000000.0"


def sums(names=COUNTERS, prefix: str = "") -> str:
    return ", ".join(f"CAST(sum({prefix}{c}) AS BIGINT) AS {c}" for c in names)


def zsums(names=TOKENS, prefix: str = "") -> str:
    return ", ".join(f"CAST(coalesce(sum({prefix}{c}), 0) AS BIGINT) AS {c}" for c in names)


POISON = (
    "CASE WHEN count(*) FILTER (WHERE cost_micro IS NULL) = 0 "
    "THEN coalesce(sum(cost_micro), CAST(0 AS DECIMAL(38,6))) END"
)
KNOWN = "coalesce(sum(cost_micro), CAST(0 AS DECIMAL(38,6)))"
UNKNOWN = "CAST(count(*) FILTER (WHERE cost_micro IS NULL) AS BIGINT)"
SESSIONS = "CAST(count(DISTINCT agent_type || ':' || session_id) AS BIGINT)"

REQUESTS = f"""{BASE}, {RATES},
req AS (
  SELECT ev.*, {cost(TOKENS)} AS cost_micro
  FROM ev LEFT JOIN rates rt ON rt.model = ev.model
)"""

STORES = f"""{REQUESTS},
sess AS (
  SELECT session_id, agent_type, user_id, project_path,
    CASE WHEN user_id % 5 = 0 THEN 'main' ELSE '' END AS git_branch,
    CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN '<synthetic>'
      ELSE arg_max(model, event_id) END AS model,
    {sums()}, {POISON} AS cost_micro,
    strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS started_at,
    strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS ended_at,
    concat('first ', session_id) AS first_prompt, concat('last ', session_id) AS last_prompt,
    CAST(min(ts) AS DATE) AS usage_date, CAST(hour(min(ts)) AS INT) AS usage_hour
  FROM req GROUP BY session_id, agent_type, user_id, project_path
),
bk AS (
  SELECT session_id, agent_type, usage_date, usage_hour, project_path, model,
    {sums()}, {POISON} AS cost_micro
  FROM req WHERE user_id % 10 <> 3
  GROUP BY session_id, agent_type, usage_date, usage_hour, project_path, model
),
src AS (
  SELECT session_id, agent_type, usage_date, usage_hour, project_path, model,
    {", ".join(COUNTERS)}, cost_micro FROM bk
  UNION ALL
  SELECT session_id, agent_type, usage_date, usage_hour, project_path, model,
    {", ".join(COUNTERS)}, cost_micro FROM sess s
  WHERE NOT EXISTS (SELECT 1 FROM bk WHERE bk.session_id = s.session_id
                    AND bk.agent_type = s.agent_type)
)"""

LABEL = """CASE WHEN {m} = '' THEN '(unknown)'
  WHEN {m} IN (SELECT model FROM rates) THEN {m} ELSE 'Unknown' END"""


def label(column: str) -> str:
    return LABEL.format(m=column)


def rng(first: str, last: str) -> str:
    return f"usage_date BETWEEN DATE '{first}' AND DATE '{last}'"
