"""Maintenance queries (S9-S12, P15): merging, replacing and repricing stored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterstone.functions.measures import dollars
from meterstone.operators.merge import fill_from_index, merge_sessions, newest_per_session
from meterstone.operators.merge import replace_usage as swap_usage
from meterstone.operators.pricing import reprice_sessions, reprice_usage

from meterstone.sources.manifest import changed_files, update_manifest
from suite.queries import query
from suite.sqlbase import BASE, POISON, STORES, TOKENS, tokens, usd
from suite.views import OWN_BOOK, buckets, requests, stored_sessions

KEYS = ["agent_type", "session_id"]


@query(
    "s09_changed_files",
    f"""WITH {BASE},
    files AS (SELECT session_id, count(*) AS size, max(event_id) AS version FROM ev GROUP BY session_id),
    known AS (SELECT session_id, count(*) AS size, max(event_id) AS version FROM ev
      WHERE usage_date <= DATE '2024-01-29' GROUP BY session_id)
    SELECT f.session_id AS file_path, f.size, k.session_id IS NULL AS is_new FROM files f
    LEFT JOIN known k USING (session_id) WHERE k.size IS NULL OR k.size <> f.size
      OR k.version <> f.version""",
)
def changed_query(spark, sf):
    """Logs that grew or appeared on the last day, against the manifest of the day before."""

    def listing(rows):
        return rows.groupBy(F.col("session_id").alias("file_path")).agg(
            F.count("*").alias("size"),
            F.timestamp_seconds(F.max("event_id")).alias("modified"),
            F.lit("v1").alias("price_version"),
        )

    rows = requests(spark, sf)
    now = listing(rows)
    known = listing(rows.filter(F.col("usage_date") <= F.to_date(F.lit("2024-01-29"))))
    changed = changed_files(now, known)
    # The manifest afterwards knows every file, so nothing is left to do.
    after = update_manifest(known, changed)
    pending = changed_files(now, after).select("file_path", F.lit(True).alias("pending"))
    old = known.select("file_path", F.lit(True).alias("old"))
    return (
        changed.join(pending, "file_path", "left_anti")
        .join(old, "file_path", "left")
        .select("file_path", "size", F.col("old").isNull().alias("is_new"))
    )


@query(
    "s10_session_merge",
    f"""WITH {STORES}
    SELECT agent_type, session_id, CASE WHEN user_id % 4 = 0 THEN concat(project_path, '/new')
      ELSE project_path END AS project_path, git_branch, CAST(CASE WHEN user_id % 4 = 0 THEN 0
      ELSE message_count END AS BIGINT) AS message_count, input_tokens,
      {usd("CASE WHEN user_id % 8 = 0 THEN NULL ELSE cost_micro END")} AS cost_usd, first_prompt
    FROM sess
    UNION ALL SELECT agent_type, concat(session_id, '-x'), concat(project_path, '/new'), '', 0, 0,
      CASE WHEN user_id % 8 = 0 THEN NULL ELSE 0.0 END, '' FROM sess WHERE user_id % 4 = 0""",
)
def merge_query(spark, sf):
    """Updates of some columns of known sessions, and the same for unknown ones."""
    stored = stored_sessions(requests(spark, sf))
    user = F.regexp_extract("session_id", r"^u(\d+)-", 1).cast("bigint")
    known = stored.filter(user % 4 == 0).select(
        *KEYS,
        F.concat("project_path", F.lit("/new")).alias("project_path"),
        F.lit(0).cast("bigint").alias("message_count"),
        F.lit(None).cast("decimal(38,6)").alias("cost_micro"),
        (user % 8 == 0).alias("cost_is_set"),
    )
    unknown = known.withColumn("session_id", F.concat("session_id", F.lit("-x")))
    merged = merge_sessions(stored, known.unionByName(unknown))
    return merged.select(
        *KEYS, "project_path", "git_branch", "message_count", "input_tokens",
        dollars(F.col("cost_micro")).alias("cost_usd"), "first_prompt",
    )


@query(
    "s14_index_merge",
    f"""WITH {STORES}
    SELECT agent_type, session_id, coalesce(nullif(project_path, ''), '/index') AS project_path,
      CASE WHEN git_branch = '' THEN 'side' ELSE git_branch END AS git_branch,
      CAST(message_count AS BIGINT) AS message_count, concat('about ', session_id) AS summary
    FROM sess WHERE user_id % 3 <> 0
    UNION ALL SELECT agent_type, session_id, '/index', 'side', 7, concat('about ', session_id)
    FROM sess WHERE user_id % 3 = 0""",
)
def index_query(spark, sf):
    """Index entries for all sessions, logs for two thirds of them."""
    stored = stored_sessions(requests(spark, sf))
    user = F.regexp_extract("session_id", r"^u(\d+)-", 1).cast("bigint")
    index = stored.select(
        *KEYS,
        F.lit("/index").alias("project_path"),
        F.lit("side").alias("git_branch"),
        "started_at",
        "ended_at",
        F.concat(F.lit("about "), F.col("session_id")).alias("summary"),
        F.lit(7).cast("bigint").alias("message_count"),
    )
    rows = fill_from_index(index, stored.filter(user % 3 != 0))
    return rows.select(*KEYS, "project_path", "git_branch", "message_count", "summary")


@query(
    "s11_replace_usage",
    f"""WITH {STORES}
    SELECT agent_type, session_id, CAST(usage_date AS VARCHAR) AS usage_date,
      CAST(usage_hour AS BIGINT) AS usage_hour, model, CAST(input_tokens AS BIGINT) AS input_tokens
    FROM bk WHERE split_part(session_id, '-', 2) <> '1'
    UNION ALL SELECT agent_type, session_id, '2024-02-01', 0, model, CAST(sum(input_tokens) AS BIGINT)
    FROM bk WHERE split_part(session_id, '-', 2) = '1' GROUP BY agent_type, session_id, model""",
)
def replace_query(spark, sf):
    """A third of the sessions get one new bucket per model in place of all they had."""
    stored = buckets(requests(spark, sf)).select(
        *KEYS, "usage_date", "usage_hour", "model", "input_tokens"
    )
    mine = stored.filter(F.col("session_id").endswith("-1"))
    fresh = (
        mine.groupBy(*KEYS, "model")
        .agg(F.sum("input_tokens").alias("input_tokens"))
        .withColumns({"usage_date": F.to_date(F.lit("2024-02-01")), "usage_hour": F.lit(0)})
    )
    return swap_usage(stored, mine.select(*KEYS).distinct(), fresh)


@query(
    "s12_one_file",
    f"""WITH {BASE},
    f AS (SELECT concat('u', user_id) AS session_id, agent_type, concat('/l/', session_id) AS file_path,
      max(event_id) // 7 AS modified FROM ev GROUP BY ALL)
    SELECT agent_type, session_id, arg_max(file_path, struct_pack(m := modified, p := file_path))
      AS file_path, max(modified) AS modified FROM f GROUP BY agent_type, session_id""",
)
def one_file_query(spark, sf):
    """Three logs claim each user's session; the newest wins, then the greatest path."""
    files = (
        requests(spark, sf)
        .groupBy(
            "agent_type",
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
            F.concat(F.lit("/l/"), F.col("session_id")).alias("file_path"),
        )
        .agg(F.floor(F.max("event_id") / 7).alias("modified"))
        .withColumnRenamed("user", "session_id")
    )
    return newest_per_session(files, ["modified", "file_path"])


# Base rates of the other book: no request-size rates for stored sums.
AGAIN = """again(model, i, o, r, w) AS (VALUES ('claude-sonnet-4-20250514', 3.0, 15.0, 0.3, 3.75),
  ('gpt-5.4', 2.5, 15.0, 0.25, 0.0), ('gpt-5.4-pro', 30.0, 180.0, 0.0, 0.0),
  ('claude-opus-4-7', 4.0, 20.0, 0.4, 5.0), ('<synthetic>', 0.0, 0.0, 0.0, 0.0))"""


def again(prefix: str) -> str:
    parts = " + ".join(
        f"{tokens(prefix + c)} * CAST(ag.{k} AS DECIMAL(12,6))"
        for c, k in zip(TOKENS, "iorw", strict=True)
    )
    idle = " AND ".join(f"{prefix}{c} <= 0" for c in TOKENS)
    return f"CASE WHEN {idle} THEN CAST(0 AS DECIMAL(38,6)) ELSE CAST({parts} AS DECIMAL(38,6)) END"


REPRICED = f"""{STORES}, {AGAIN},
nb AS (SELECT bk.* EXCLUDE (cost_micro), CASE WHEN bk.usage_hour % 2 = 0 AND bk.cost_micro IS NOT NULL
    THEN bk.cost_micro ELSE {again('bk.')} END AS cost_micro
  FROM bk LEFT JOIN again ag ON ag.model = bk.model)"""


def stored_usage(rows):
    """Buckets of even hours carry a cost of their own."""
    explicit = (F.col("usage_hour") % 2 == 0) & F.col("cost_micro").isNotNull()
    return buckets(rows).withColumn("cost_is_explicit", explicit)


@query(
    "p15_reprice",
    f"""WITH {REPRICED} SELECT agent_type, session_id, CAST(usage_date AS VARCHAR) AS usage_date,
    CAST(usage_hour AS BIGINT) AS usage_hour, project_path, model, {usd('cost_micro')} AS cost_usd
    FROM nb""",
)
def reprice_query(spark, sf):
    """Buckets under another book; explicit costs stay."""
    rows = reprice_usage(stored_usage(requests(spark, sf)), OWN_BOOK)
    return rows.select(
        *KEYS, "usage_date", "usage_hour", "project_path", "model",
        dollars(F.col("cost_micro")).alias("cost_usd"),
    )


@query(
    "p15_reprice_sessions",
    f"""WITH {REPRICED},
    sb AS (SELECT agent_type, session_id, {POISON} AS c FROM nb GROUP BY agent_type, session_id)
    SELECT s.agent_type, s.session_id, {usd(f'''CASE WHEN sb.session_id IS NOT NULL THEN sb.c
      ELSE {again('s.')} END''')} AS cost_usd
    FROM sess s LEFT JOIN sb ON sb.session_id = s.session_id AND sb.agent_type = s.agent_type
    LEFT JOIN again ag ON ag.model = s.model""",
)
def reprice_sessions_query(spark, sf):
    """Sessions follow their repriced buckets."""
    rows = requests(spark, sf)
    usage = reprice_usage(stored_usage(rows), OWN_BOOK)
    out = reprice_sessions(stored_sessions(rows), usage, OWN_BOOK)
    return out.select(*KEYS, dollars(F.col("cost_micro")).alias("cost_usd"))


