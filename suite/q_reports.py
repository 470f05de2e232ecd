"""Usage source and report queries (U, R)."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterstone.functions import measures as M
from meterstone.operators.calendar import custom_range, last_days
from meterstone.operators.usage import preferred_model, real_model, usage_source
from meterstone.plans import reports as R
from meterstone.schemas import COUNTERS, SESSION_KEY
from suite.queries import query
from suite.sqlbase import (
    KNOWN,
    SESSIONS,
    STORES,
    TOKENS,
    UNKNOWN,
    label,
    rng,
    sums,
    usd,
    zsums,
)
from suite.views import AS_OF, FIRST, LAST, buckets, requests, sessions, source
from suite.views import COLUMNS as SOURCE_COLUMNS

SPAN = rng(str(FIRST), str(LAST))
COST = f"{usd(KNOWN)} AS estimated_cost_usd, {UNKNOWN} AS unknown_cost_count"


def standard(*counters: str) -> str:
    return f"{SESSIONS} AS session_count, {zsums((*counters, *TOKENS))}, {COST}"


def sql(body: str) -> str:
    return f"WITH {STORES}\n{body}"


@query(
    "u01_usage_source",
    sql(
        f"SELECT session_id, agent_type, CAST(usage_date AS VARCHAR) AS usage_date, "
        f"CAST(usage_hour AS BIGINT) AS usage_hour, project_path, model, {', '.join(COUNTERS)}, "
        f"{usd('cost_micro')} AS estimated_cost_usd FROM src"
    ).replace("message_count, user_turns, input", "CAST(message_count AS BIGINT) AS message_count, "
              "CAST(user_turns AS BIGINT) AS user_turns, input"),
)
def usage_source_query(spark, sf):
    """U1 with its anti join: these sessions carry no flag."""
    rows = requests(spark, sf)
    return R.publish(usage_source(buckets(rows), sessions(rows)).select(*SOURCE_COLUMNS))


@query(
    "u04_session_model",
    sql(
        "SELECT s.agent_type, s.session_id, coalesce(nullif(CASE WHEN s.model = '<synthetic>' "
        "THEN '' ELSE s.model END, ''), max(CASE WHEN u.model NOT IN ('', '<synthetic>') "
        "THEN u.model END), '') AS model FROM sess s LEFT JOIN bk u ON u.session_id = s.session_id "
        "AND u.agent_type = s.agent_type GROUP BY s.agent_type, s.session_id, s.model"
    ),
)
def session_model_query(spark, sf):
    rows = requests(spark, sf)
    used = (
        buckets(rows)
        .groupBy(*SESSION_KEY)
        .agg(F.max(real_model(F.col("model"))).alias("usage_model"))
    )
    return (
        sessions(rows)
        .join(used, SESSION_KEY, "left")
        .select(
            *SESSION_KEY,
            preferred_model(F.col("model"), F.col("usage_model")).alias("model"),
        )
    )


@query("r03_totals", sql(f"SELECT {standard('message_count', 'user_turns')} FROM src WHERE {SPAN}"))
def totals_query(spark, sf):
    return R.totals(source(spark, sf), FIRST, LAST)


@query(
    "r04_by_agent",
    sql(f"SELECT agent_type, {standard('user_turns')} FROM src WHERE {SPAN} GROUP BY agent_type"),
)
def by_agent_query(spark, sf):
    return R.by_agent(source(spark, sf), FIRST, LAST)


@query(
    "r05_by_agent_model",
    sql(
        f"SELECT agent_type, model AS raw_model, {standard()}, {label('model')} AS model "
        f"FROM src WHERE {SPAN} GROUP BY agent_type, src.model"
    ),
)
def by_agent_model_query(spark, sf):
    return R.by_agent_model(source(spark, sf), FIRST, LAST)


@query(
    "r06_by_project",
    sql(
        f"SELECT CASE WHEN project_path = '' THEN '(unspecified)' ELSE project_path END "
        f"AS project_path, {standard('user_turns')} FROM src WHERE {SPAN} GROUP BY src.project_path "
        f"ORDER BY {KNOWN} DESC, {UNKNOWN} DESC, src.project_path LIMIT 4"
    ),
)
def by_project_query(spark, sf):
    return R.by_project(source(spark, sf), FIRST, LAST, limit=4)


@query(
    "r07_time_model",
    sql(
        f"SELECT CAST(usage_date AS VARCHAR) AS usage_date, CAST(usage_hour AS BIGINT) AS usage_hour, "
        f"agent_type, model AS raw_model, {label('model')} AS model, {standard('user_turns')} "
        f"FROM src WHERE {SPAN} GROUP BY src.usage_date, src.usage_hour, agent_type, src.model "
        f"HAVING {KNOWN} > 0 OR {UNKNOWN} > 0 ORDER BY {KNOWN} DESC, {UNKNOWN} DESC, "
        f"src.usage_date, src.usage_hour, agent_type, src.model LIMIT 10"
    ),
)
def time_model_query(spark, sf):
    return R.by_time_model(source(spark, sf), FIRST, LAST, limit=10)


@query(
    "r08_top_sessions",
    sql(
        f"""SELECT t.agent_type, t.session_id, coalesce(nullif(s.project_path, ''), t.up, '')
        AS project_path, coalesce(s.first_prompt, '') AS first_prompt,
        coalesce(s.started_at, '') AS started_at, coalesce(s.ended_at, '') AS ended_at,
        coalesce(nullif(nullif(s.model, '<synthetic>'), ''), t.um, '') AS raw_model,
        {label("coalesce(nullif(nullif(s.model, '<synthetic>'), ''), t.um, '')")} AS model,
        coalesce(t.billed, '') AS raw_models,
        CASE WHEN t.n_unknown > 0 AND t.billed IS NULL THEN 'Unknown'
          ELSE coalesce(t.shown, '') END AS models,
        {', '.join('t.' + c for c in COUNTERS)}, {usd('t.c')} AS estimated_cost_usd,
        t.n_unknown AS unknown_cost_count
        FROM (SELECT agent_type, session_id, {sums()}, {KNOWN} AS c, {UNKNOWN} AS n_unknown,
            max(nullif(project_path, '')) AS up,
            max(CASE WHEN model NOT IN ('', '<synthetic>') THEN model END) AS um,
            string_agg(DISTINCT CASE WHEN (coalesce(cost_micro, 0) > 0 OR cost_micro IS NULL)
              AND model NOT IN ('', '<synthetic>') THEN model END, ',' ORDER BY
              CASE WHEN (coalesce(cost_micro, 0) > 0 OR cost_micro IS NULL)
              AND model NOT IN ('', '<synthetic>') THEN model END) AS billed,
            replace(string_agg(DISTINCT CASE WHEN (coalesce(cost_micro, 0) > 0 OR cost_micro IS NULL)
              AND model NOT IN ('', '<synthetic>') THEN model END, ',' ORDER BY
              CASE WHEN (coalesce(cost_micro, 0) > 0 OR cost_micro IS NULL)
              AND model NOT IN ('', '<synthetic>') THEN model END), 'gpt-5.4-pro', 'Unknown') AS shown
          FROM src WHERE {SPAN} GROUP BY agent_type, session_id
          HAVING {KNOWN} > 0 OR {UNKNOWN} > 0
          ORDER BY {KNOWN} DESC, {UNKNOWN} DESC, agent_type, session_id LIMIT 10) t
        LEFT JOIN sess s ON s.session_id = t.session_id AND s.agent_type = t.agent_type"""
    ),
)
def top_sessions_query(spark, sf):
    rows = requests(spark, sf)
    return R.top_sessions(source(spark, sf), sessions(rows), FIRST, LAST, limit=10)


@query(
    "r09_daily",
    sql(
        f"SELECT CAST(usage_date AS VARCHAR) AS usage_date, {standard()} FROM src WHERE {SPAN} "
        f"GROUP BY src.usage_date"
    ),
)
def daily_query(spark, sf):
    return R.daily(source(spark, sf), FIRST, LAST)


DAY = rng(str(AS_OF), str(AS_OF))


@query(
    "r10_overview",
    sql(
        f"SELECT agent_type, {standard('message_count', 'user_turns')} FROM src WHERE {DAY} "
        f"GROUP BY GROUPING SETS ((agent_type), ())"
    ),
)
def overview_query(spark, sf):
    return R.day_overview(source(spark, sf), AS_OF)


@query(
    "r11_trend_daily",
    sql(
        f"SELECT CAST(usage_date AS VARCHAR) AS usage_date, {standard('user_turns', 'message_count')} "
        f"FROM src WHERE usage_date >= DATE '{AS_OF}' - 14 GROUP BY src.usage_date"
    ),
)
def trend_daily_query(spark, sf):
    return R.daily_trend(source(spark, sf), AS_OF, days=14)


@query(
    "r12_model_breakdown",
    sql(
        f"SELECT model AS raw_model, {zsums()}, {COST}, {label('model')} AS model FROM src "
        f"WHERE usage_date >= DATE '{AS_OF}' - 14 AND model <> '' GROUP BY src.model"
    ),
)
def model_breakdown_query(spark, sf):
    return R.model_breakdown(source(spark, sf), AS_OF, days=14)


@query(
    "r13_today_sessions",
    sql(
        f"""SELECT t.agent_type, t.session_id,
        coalesce(nullif(s.project_path, ''), t.up, '') AS project_path,
        coalesce(s.git_branch, '') AS git_branch, coalesce(s.started_at, '') AS started_at,
        coalesce(s.ended_at, '') AS ended_at, coalesce(s.first_prompt, '') AS first_prompt,
        coalesce(s.last_prompt, '') AS last_prompt,
        coalesce(nullif(nullif(s.model, '<synthetic>'), ''), t.um, '') AS raw_model,
        {label("coalesce(nullif(nullif(s.model, '<synthetic>'), ''), t.um, '')")} AS model,
        {', '.join('t.' + c for c in COUNTERS)}, {usd('t.c')} AS estimated_cost_usd,
        t.n_unknown AS unknown_cost_count
        FROM (SELECT agent_type, session_id, {sums()}, {KNOWN} AS c, {UNKNOWN} AS n_unknown,
            max(nullif(project_path, '')) AS up,
            max(CASE WHEN model NOT IN ('', '<synthetic>') THEN model END) AS um
          FROM src WHERE {DAY} GROUP BY agent_type, session_id) t
        LEFT JOIN sess s ON s.session_id = t.session_id AND s.agent_type = t.agent_type"""
    ),
)
def today_sessions_query(spark, sf):
    rows = requests(spark, sf)
    return R.day_sessions(source(spark, sf), sessions(rows), AS_OF)


@query(
    "r14_top_projects",
    sql(
        f"SELECT project_path, CAST(count(*) AS BIGINT) AS session_count, "
        f"CAST(sum(message_count) AS BIGINT) AS total_messages, {usd('sum(cost_micro)')} AS total_cost "
        f"FROM sess WHERE project_path <> '' GROUP BY project_path "
        f"ORDER BY total_messages DESC, project_path LIMIT 5"
    ),
)
def top_projects_query(spark, sf):
    return R.top_projects(sessions(requests(spark, sf)), limit=5)


# ── Calendars ────────────────────────────────────────────────────────────

TOKEN_SUM = "CAST(coalesce(sum(" + " + ".join(TOKENS) + "), 0) AS BIGINT)"
FACTS = (
    f"{KNOWN} AS c, {UNKNOWN} AS n_unknown, {TOKEN_SUM} AS tokens, {SESSIONS} AS session_count"
)
FILLED = (
    f"{usd('coalesce(f.c, CAST(0 AS DECIMAL(38,6)))')} AS cost, "
    "CAST(coalesce(f.n_unknown, 0) AS BIGINT) AS unknown_cost_count, "
    "CAST(coalesce(f.tokens, 0) AS BIGINT) AS tokens, "
    "CAST(coalesce(f.session_count, 0) AS BIGINT) AS session_count"
)

HEAT_DAY = (
    f"SELECT CAST(h.h AS BIGINT) AS position, lpad(CAST(h.h AS VARCHAR), 2, '0') AS label, {FILLED} "
    f"FROM range(24) h(h) LEFT JOIN (SELECT usage_hour, {FACTS} FROM src WHERE {DAY} "
    f"GROUP BY usage_hour) f ON f.usage_hour = h.h"
)
HEAT_WEEK = (
    f"SELECT CAST(d.i AS BIGINT) AS position, "
    f"['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][d.i + 1] AS label, {FILLED} FROM range(7) d(i) "
    f"LEFT JOIN (SELECT usage_date, {FACTS} FROM src GROUP BY usage_date) f "
    f"ON f.usage_date = DATE '2024-01-29' + CAST(d.i AS INT)"
)
HEAT_MONTH = f"""SELECT CAST(row_number() OVER (ORDER BY m.mon) - 1 AS BIGINT) AS position,
  concat('W', row_number() OVER (ORDER BY m.mon)) AS label,
  concat(strftime(m.a, '%m-%d'), ' – ', strftime(m.b, '%m-%d')) AS sublabel, {FILLED}
  FROM (SELECT CAST(date_trunc('week', d) AS DATE) AS mon, min(d) AS a, max(d) AS b
        FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31',
              INTERVAL 1 DAY)) AS DATE) AS d) GROUP BY 1) m
  LEFT JOIN (SELECT CAST(date_trunc('week', usage_date) AS DATE) AS mon, {FACTS} FROM src
        WHERE usage_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY 1) f USING (mon)"""


@query("r15_heat_day", sql(HEAT_DAY))
def heat_day_query(spark, sf):
    return R.heatmap(source(spark, sf), "today", AS_OF)


@query("r16_heat_week", sql(HEAT_WEEK))
def heat_week_query(spark, sf):
    return R.heatmap(source(spark, sf), "week", AS_OF)


@query("r17_heat_month", sql(HEAT_MONTH))
def heat_month_query(spark, sf):
    return R.heatmap(source(spark, sf), "month", AS_OF)


def trend_sql(unit: str, spine: str, count: int, fmt: str) -> str:
    return sql(
        f"SELECT CAST(p.i AS BIGINT) AS position, strftime(p.b, '{fmt}') AS label, "
        f"{usd('coalesce(f.c, CAST(0 AS DECIMAL(38,6)))')} AS cost "
        f"FROM (SELECT i, CAST({spine} AS DATE) AS b FROM range({count}) r(i)) p "
        f"LEFT JOIN (SELECT CAST(date_trunc('{unit}', usage_date) AS DATE) AS b, {KNOWN} AS c "
        f"FROM src GROUP BY 1) f ON f.b = p.b"
    )


@query(
    "r18_trend_hour",
    sql(
        f"SELECT CAST(h.h AS BIGINT) AS position, lpad(CAST(h.h AS VARCHAR), 2, '0') AS label, "
        f"{usd('coalesce(f.c, CAST(0 AS DECIMAL(38,6)))')} AS cost FROM range(24) h(h) LEFT JOIN "
        f"(SELECT usage_hour, {KNOWN} AS c FROM src WHERE {DAY} GROUP BY usage_hour) f "
        f"ON f.usage_hour = h.h"
    ),
)
def trend_hour_query(spark, sf):
    return R.trend(source(spark, sf), "hour", AS_OF)


@query("r18_trend_day", trend_sql("day", "DATE '2024-01-01' + CAST(i AS INT)", 30, "%m-%d"))
def trend_day_query(spark, sf):
    return R.trend(source(spark, sf), "day", AS_OF, 30)


@query(
    "r18_trend_week", trend_sql("week", "DATE '2023-11-13' + CAST(i * 7 AS INT)", 12, "%m-%d")
)
def trend_week_query(spark, sf):
    return R.trend(source(spark, sf), "week", AS_OF, 12)


@query(
    "r18_trend_month",
    trend_sql("month", "DATE '2023-02-01' + to_months(CAST(i AS INT))", 12, "%y-%m"),
)
def trend_month_query(spark, sf):
    return R.trend(source(spark, sf), "month", AS_OF, 12)


# ── Comparisons ──────────────────────────────────────────────────────────

SPANS = """spans(period, back, a, b) AS (VALUES
  ('today', 0, DATE '2024-01-30', DATE '2024-01-30'), ('today', 1, DATE '2024-01-29', DATE '2024-01-29'),
  ('week', 0, DATE '2024-01-29', DATE '2024-01-30'), ('week', 1, DATE '2024-01-22', DATE '2024-01-28'),
  ('month', 0, DATE '2024-01-01', DATE '2024-01-30'), ('month', 1, DATE '2023-12-01', DATE '2023-12-31'))"""
PERIOD_ROWS = f"""{STORES}, {SPANS},
per AS (
  SELECT period, back, a, b, {SESSIONS} AS session_count, {zsums(COUNTERS)},
    {usd(KNOWN)} AS usd, CAST(count(*) FILTER (WHERE session_id IS NOT NULL AND cost_micro IS NULL)
    AS BIGINT) AS n_unknown
  FROM spans LEFT JOIN {{src}} ON usage_date BETWEEN a AND b GROUP BY period, back, a, b
),
cmp AS (
  SELECT n.*, p.usd AS prev_usd, p.n_unknown AS prev_unknown FROM per n JOIN per p USING (period)
  WHERE n.back = 0 AND p.back = 1
)"""
KIND = """CASE WHEN n_unknown > 0 OR prev_unknown > 0 THEN NULL
  WHEN prev_usd <= 0 AND usd <= 0 THEN NULL WHEN prev_usd <= 0 THEN 'new'
  WHEN abs(usd - prev_usd) < 0.01 OR abs(usd / prev_usd - 1.0) < 0.01 THEN 'flat'
  WHEN usd > prev_usd AND usd / prev_usd >= 10 THEN 'up_10x'
  WHEN usd > prev_usd THEN 'up' ELSE 'down' END"""
DELTA = (
    f"{KIND} AS delta_kind, CASE WHEN {KIND} IN ('up', 'down') "
    f"THEN (usd / prev_usd - 1.0) * 100.0 END AS delta_pct"
)
# Over all buckets a period with an unpriced one has no comparable cost; over the
# priced ones alone every period has.
SCOPES = """scoped AS (SELECT 'all' AS scope, * FROM src
  UNION ALL SELECT 'priced', * FROM src WHERE cost_micro IS NOT NULL)"""
DAYS = """spans(day, period, back, a, b) AS (
  SELECT '2024-01-30', * FROM spans1 UNION ALL SELECT '2024-01-01', * FROM spans2)"""
SPANS1 = SPANS.replace("spans(", "spans1(")
SPANS2 = """spans2(period, back, a, b) AS (VALUES
  ('today', 0, DATE '2024-01-01', DATE '2024-01-01'), ('today', 1, DATE '2023-12-31', DATE '2023-12-31'),
  ('week', 0, DATE '2024-01-01', DATE '2024-01-01'), ('week', 1, DATE '2023-12-25', DATE '2023-12-31'),
  ('month', 0, DATE '2024-01-01', DATE '2024-01-01'), ('month', 1, DATE '2023-12-01', DATE '2023-12-31'))"""


def period_sql(source_sql: str, body: str) -> str:
    return f"WITH {PERIOD_ROWS.format(src=source_sql)}\n{body}"


@query(
    "r19_delta",
    f"""WITH {STORES}, {SCOPES}, {SPANS1}, {SPANS2}, {DAYS},
    per AS (
      SELECT s.scope, day, period, back, {usd(KNOWN)} AS usd,
        CAST(count(*) FILTER (WHERE session_id IS NOT NULL AND cost_micro IS NULL) AS BIGINT) AS n_unknown
      FROM (VALUES ('all'), ('priced')) s(scope) CROSS JOIN spans
        LEFT JOIN scoped ON scoped.scope = s.scope AND usage_date BETWEEN a AND b
      GROUP BY s.scope, day, period, back
    ),
    cmp AS (
      SELECT n.*, p.usd AS prev_usd, p.n_unknown AS prev_unknown
      FROM per n JOIN per p USING (scope, day, period) WHERE n.back = 0 AND p.back = 1
    )
    SELECT scope, day, period, usd AS estimated_cost_usd, prev_usd AS prev_cost_usd,
      prev_unknown AS prev_unknown_count, n_unknown AS unknown_cost_count, {DELTA} FROM cmp""",
)
def delta_query(spark, sf):
    """Over all buckets and over the priced ones, late in the data and on its first day."""
    every = source(spark, sf)
    known = every.filter(F.col("cost_micro").isNotNull())
    parts = [
        R.period_delta(rows, kind, day).select(
            F.lit(scope).alias("scope"), F.lit(str(day)).alias("day"), "*"
        )
        for scope, rows in (("all", every), ("priced", known))
        for day in (AS_OF, date(2024, 1, 1))
        for kind in ("today", "week", "month")
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "r20_periods",
    period_sql(
        "src",
        f"SELECT period, CAST(a AS VARCHAR) AS first_day, CAST(b AS VARCHAR) AS last_day, "
        f"session_count, user_turns, greatest(message_count - user_turns, 0) AS requests, "
        f"{' + '.join(TOKENS)} AS tokens, CAST(CASE WHEN input_tokens + cache_read_tokens + "
        f"cache_creation_tokens > 0 THEN round_even(100.0::DOUBLE * CAST(cache_read_tokens + "
        f"cache_creation_tokens AS DOUBLE) / (input_tokens + cache_read_tokens + "
        f"cache_creation_tokens), 0) END AS BIGINT) AS cache_share, usd AS estimated_cost_usd, "
        f"n_unknown AS unknown_cost_count, prev_usd AS prev_cost_usd, {DELTA} FROM cmp",
    ),
)
def periods_query(spark, sf):
    return R.summary(source(spark, sf), AS_OF)


# ── Derived views ────────────────────────────────────────────────────────

MODELS = f"""{STORES},
am AS (
  SELECT agent_type, model AS raw_model, {KNOWN} AS c, {UNKNOWN} AS n_unknown, {TOKEN_SUM} AS tokens,
    CAST(sum(input_tokens) AS BIGINT) AS input, CAST(sum(output_tokens) AS BIGINT) AS output,
    CAST(sum(cache_read_tokens + cache_creation_tokens) AS BIGINT) AS cache
  FROM src WHERE {SPAN} GROUP BY agent_type, model HAVING {KNOWN} > 0 OR {UNKNOWN} > 0
)"""


@query(
    "r21_nested",
    f"""WITH {MODELS}
    SELECT agent_type, {usd('g.c')} AS agent_cost, g.tokens AS agent_tokens,
      CAST(row_number() OVER (PARTITION BY agent_type ORDER BY am.c DESC, raw_model) - 1 AS BIGINT)
        AS place, raw_model, {label('raw_model')} AS model, {usd('am.c')} AS cost,
      n_unknown AS unknown_cost_count, am.tokens, input, output, cache
    FROM am JOIN (SELECT agent_type, sum(c) AS c, CAST(sum(tokens) AS BIGINT) AS tokens
      FROM am GROUP BY agent_type) g USING (agent_type)""",
)
def nested_query(spark, sf):
    """The nested rows, flattened so that they can be compared."""
    groups = R.nested_breakdown(source(spark, sf), FIRST, LAST)
    return groups.select(
        "agent_type",
        F.col("estimated_cost_usd").alias("agent_cost"),
        F.col("tokens").alias("agent_tokens"),
        F.posexplode("models").alias("place", "m"),
    ).select("agent_type", "agent_cost", "agent_tokens", "place", "m.*")


@query(
    "r22_fold",
    f"""WITH {MODELS},
    rk AS (SELECT *, n_unknown > 0 AS unk, row_number() OVER (PARTITION BY agent_type, n_unknown > 0
      ORDER BY c DESC, raw_model) > 1 AND n_unknown = 0 AS folded FROM am)
    SELECT agent_type, folded, CASE WHEN NOT folded THEN raw_model END AS raw_model,
      CAST(count(*) AS BIGINT) AS model_count, {usd('sum(c)')} AS estimated_cost_usd,
      CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(input) AS BIGINT) AS input,
      CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache) AS BIGINT) AS cache,
      CAST(sum(n_unknown) AS BIGINT) AS unknown_cost_count,
      CASE WHEN folded THEN concat('+', count(*), ' more models')
        ELSE max({label('raw_model')}) END AS model
    FROM rk GROUP BY agent_type, unk, folded, CASE WHEN NOT folded THEN raw_model END""",
)
def fold_query(spark, sf):
    return R.folded_models(source(spark, sf), FIRST, LAST, top=1)


@query(
    "r23_peak",
    sql(
        f"SELECT * FROM ({HEAT_DAY}) x ORDER BY cost DESC, "
        f"CASE WHEN cost <= 0 AND unknown_cost_count > 0 THEN 0 ELSE 1 END, position LIMIT 1"
    ),
)
def peak_query(spark, sf):
    return R.peak_bucket(R.heatmap(source(spark, sf), "today", AS_OF))


@query(
    "r24_intensity",
    sql(
        f"SELECT *, CAST(least(round_even(cost / CASE WHEN max(cost) OVER () > 0 THEN max(cost) "
        f"OVER () ELSE 1.0 END * 8, 0), 8) AS BIGINT) AS level FROM ({HEAT_DAY}) x"
    ),
)
def intensity_query(spark, sf):
    return R.with_intensity(R.heatmap(source(spark, sf), "today", AS_OF), levels=9)


@query(
    "r25_ratio",
    sql(
        f"SELECT *, cost / CASE WHEN max(cost) OVER () > 0 THEN max(cost) OVER () ELSE 1e-9 END "
        f"AS ratio FROM ({HEAT_MONTH}) x WHERE cost > 0 OR unknown_cost_count > 0"
    ),
)
def ratio_query(spark, sf):
    return R.active_periods(R.heatmap(source(spark, sf), "month", AS_OF))


@query(
    "u08_cache_hit",
    sql(
        f"""SELECT *, CASE WHEN p > 0 THEN 100.0::DOUBLE * CAST(cache_read_tokens AS DOUBLE) / p END
        AS cache_hit_pct, CASE WHEN p > 0 THEN 100.0::DOUBLE * CAST(cache_read_tokens
        + cache_creation_tokens AS DOUBLE) / p END AS cache_share_pct
        FROM (SELECT agent_type, {standard('user_turns')}, CAST(coalesce(sum(input_tokens
          + cache_read_tokens + cache_creation_tokens), 0) AS BIGINT) AS p
          FROM src WHERE {SPAN} GROUP BY agent_type)"""
    ),
)
def cache_hit_query(spark, sf):
    rows = R.cache_rates(R.by_agent(source(spark, sf), FIRST, LAST))
    p = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    return rows.withColumn("p", p)


@query(
    "u09_share",
    sql(
        f"""SELECT 'priced' AS scope, *, CASE WHEN sum(estimated_cost_usd)
        OVER () > 0 THEN 100.0::DOUBLE * estimated_cost_usd / (SELECT {usd(KNOWN)} FROM src
        WHERE {SPAN} AND cost_micro IS NOT NULL) END AS share_pct
        FROM (SELECT agent_type, {standard('user_turns')} FROM src
          WHERE {SPAN} AND cost_micro IS NOT NULL GROUP BY agent_type)
        UNION ALL
        SELECT 'all', *, CASE WHEN max(unknown_cost_count) OVER () = 0 AND sum(estimated_cost_usd)
        OVER () > 0 THEN 100.0::DOUBLE * estimated_cost_usd / (SELECT {usd(KNOWN)} FROM src
        WHERE {SPAN}) END FROM (SELECT agent_type, {standard('user_turns')} FROM src
          WHERE {SPAN} GROUP BY agent_type)"""
    ),
)
def share_query(spark, sf):
    """Over the priced buckets, and over all: with an unknown cost there is no share."""
    every = source(spark, sf)
    scopes = {"priced": every.filter(F.col("cost_micro").isNotNull()), "all": every}
    parts = [
        R.with_share(R.by_agent(rows, FIRST, LAST), R.totals(rows, FIRST, LAST)).select(
            F.lit(scope).alias("scope"), "*"
        )
        for scope, rows in scopes.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "u11_order",
    sql(
        f"""SELECT agent_type, raw_model, CAST(row_number() OVER (ORDER BY agent_type, c DESC, n DESC,
        raw_model) AS BIGINT) AS place, CAST(CASE WHEN n > 0 AND c = 0 THEN 1 ELSE 0 END AS BIGINT)
        AS unknown_last FROM (SELECT agent_type, model AS raw_model, {KNOWN} AS c, {UNKNOWN} AS n
          FROM src WHERE {SPAN} GROUP BY agent_type, src.model)"""
    ),
)
def order_query(spark, sf):
    """U11 and the order of R5: the place of every row as the report gives it."""
    rows = R.by_agent_model(source(spark, sf), FIRST, LAST).withColumn(
        "at", F.monotonically_increasing_id()
    )
    return rows.select(
        "agent_type",
        "raw_model",
        F.row_number().over(Window.orderBy("at")).alias("place"),
        M.unknown_last("estimated_cost_usd").alias("unknown_last"),
    )


@query(
    "r02_custom_range",
    sql(
        f"SELECT 'from_to' AS part, {standard('message_count', 'user_turns')} FROM src WHERE "
        f"{rng('2024-01-10', '2024-01-20')} UNION ALL SELECT 'last_7', "
        f"{standard('message_count', 'user_turns')} FROM src WHERE {rng('2024-01-24', '2024-01-30')}"
    ),
)
def custom_range_query(spark, sf):
    """R2: totals of a stated range and of the last seven days."""
    spans = {"from_to": custom_range("2024-01-10: 2024-01-20"), "last_7": last_days(AS_OF, 7)}
    rows = source(spark, sf)
    parts = [
        R.totals(rows, span.first, span.last).select(F.lit(part).alias("part"), "*")
        for part, span in spans.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "r24_blank",
    sql(
        f"SELECT *, CASE WHEN cost > 0 THEN CAST(least(round_even(cost / CASE WHEN max(cost) OVER () > 0 "
        f"THEN max(cost) OVER () ELSE 1.0 END * 4, 0), 4) AS BIGINT) END AS level FROM ({HEAT_DAY}) x"
    ),
)
def blank_query(spark, sf):
    """R24 with no shade where nothing was spent."""
    heat = R.heatmap(source(spark, sf), "today", AS_OF)
    return R.with_intensity(heat, levels=5, blank_zero=True)


@query("r26_report", sql(f"SELECT 'totals' AS part, '' AS name, {standard()} FROM src WHERE "
    f"{rng('2024-01-01', '2024-01-30')} UNION ALL SELECT 'agent', agent_type, {standard()} FROM src "
    f"WHERE {rng('2024-01-01', '2024-01-30')} GROUP BY agent_type UNION ALL SELECT * FROM (SELECT "
    f"'project', CASE WHEN project_path = '' THEN '(unspecified)' ELSE project_path END, {standard()} "
    f"FROM src WHERE {rng('2024-01-01', '2024-01-30')} GROUP BY src.project_path ORDER BY {KNOWN} DESC, "
    f"{UNKNOWN} DESC, src.project_path LIMIT 3) UNION ALL SELECT 'previous', '', {standard()} FROM src "
    f"WHERE {rng('2023-12-01', '2023-12-31')}"))  # fmt: skip
def report_query(spark, sf):
    """The parts of the full month report, stacked."""
    report = R.full_report(source(spark, sf), AS_OF, "month", limit=3)
    shared = [
        "session_count", *TOKENS, "estimated_cost_usd", "unknown_cost_count",
    ]
    parts = [
        ("totals", report.totals, F.lit("")),
        ("agent", report.by_agent, F.col("agent_type")),
        ("project", report.by_project, F.col("project_path")),
        ("previous", report.previous, F.lit("")),
    ]
    out = None
    for part, frame, name in parts:
        rows = frame.select(F.lit(part).alias("part"), name.alias("name"), *shared)
        out = rows if out is None else out.unionByName(rows)
    return out
