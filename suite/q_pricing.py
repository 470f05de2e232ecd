"""Price rule queries (P): the rules applied to the models and requests of the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterstone.functions.measures import dollars
from meterstone.functions.pricebook import BUILTIN, PRICES_TYPE, canonical, in_dollars
from meterstone.operators.pricing import (
    PRICE_COLS,
    current_rules,
    model_dimension,
    price_list,
    tier_list,
)
from suite.queries import query
from suite.sqlbase import BASE, REQUESTS, TOKENS, cost, usd
from suite.views import MODEL_NAMES, OWN_BOOK, requests, table

FIELDS = PRICES_TYPE.fieldNames()


def named_models(spark, sf):
    """Every event with one of the model names that exercise the matching rules."""
    names = F.array(*[F.lit(n) for n in MODEL_NAMES])
    index = (F.col("event_id") % len(MODEL_NAMES)).cast("int")
    return table(spark, sf, "events").select(
        "event_id",
        F.get(names, index).alias("model"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("size"),
    )


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def rules_sql() -> str:
    """The built-in rules as the constants they are, matched by prefix below."""
    from meterstone.functions.fixed_prices import builtin_models, builtin_tiers

    models = ", ".join(
        f"('{m}', {', '.join(str(x) for x in p)})" for m, p in builtin_models().items()
    )
    tiers = ", ".join(
        f"('{m}', {t}, {', '.join(str(x) for x in p)}, {sql_list(x)}::VARCHAR[])"
        for m, t, p, x in builtin_tiers()
    )
    return (
        f"book(prefix, i, o, r, w) AS (VALUES {models}), "
        f"tier(prefix, lim, i, o, r, w, skip) AS (VALUES {tiers})"
    )


NAMED = f"""ev0 AS (
  SELECT event_id, {sql_list(MODEL_NAMES)}[event_id % {len(MODEL_NAMES)} + 1] AS model,
    CAST(floor(value * 1000) AS BIGINT) AS size FROM events
),
nm AS (SELECT *, CASE model WHEN 'claude-4.5-sonnet-thinking' THEN 'claude-sonnet-4-5'
  WHEN 'claude-4.5-opus-high-thinking' THEN 'claude-opus-4-5'
  WHEN 'codex-auto-review' THEN 'gpt-5.3-codex' ELSE model END AS name FROM ev0),
{rules_sql()}"""
DENIED = (
    "regexp_matches(name, '^gpt-(5|5\\.1|5\\.2|5\\.3|5\\.4|5\\.5)-pro(-|$)')"
)
MATCH = "(name = prefix OR starts_with(name, prefix || '-'))"


def as_double(c: str, out: str) -> str:
    return f"CAST(CAST({c} AS VARCHAR) AS DOUBLE) AS {out}"


LOOKUP = f"""SELECT nm.model, nm.name, count(*) AS n,
  CASE WHEN name = '<synthetic>' THEN 0.0 ELSE b.i END AS input,
  CASE WHEN name = '<synthetic>' THEN 0.0 ELSE b.o END AS output,
  CASE WHEN name = '<synthetic>' THEN 0.0 ELSE b.r END AS cache_read,
  CASE WHEN name = '<synthetic>' THEN 0.0 ELSE b.w END AS cache_write
FROM nm LEFT JOIN (
  SELECT m.name AS matched, arg_max(struct_pack(i := book.i, o := book.o, r := book.r, w := book.w),
    length(prefix)) AS b FROM (SELECT DISTINCT name FROM nm WHERE NOT {DENIED}) m
  JOIN book ON (m.name = prefix OR starts_with(m.name, prefix || '-')) GROUP BY m.name
) p ON p.matched = nm.name, LATERAL (SELECT p.b.i AS i, p.b.o AS o, p.b.r AS r, p.b.w AS w) b
GROUP BY ALL"""


@query(
    "p03_price_lookup",
    f"WITH {NAMED} SELECT model, name, CAST(n AS BIGINT) AS requests, {as_double('input', 'input')}, "
    f"{as_double('output', 'output')}, {as_double('cache_read', 'cache_read')}, "
    f"{as_double('cache_write', 'cache_write')}, input IS NOT NULL AS is_priced FROM ({LOOKUP})",
)
def lookup_query(spark, sf):
    """Price of every model name in the events."""
    rows = named_models(spark, sf).groupBy("model").agg(F.count("*").alias("requests"))
    return rows.withColumn("price", BUILTIN.base_price(F.col("model"))).select(
        "model",
        canonical(F.col("model")).alias("name"),
        "requests",
        *[in_dollars(F.col(f"price.{f}")).alias(f) for f in FIELDS],
        F.col("price").isNotNull().alias("is_priced"),
    )


@query(
    "p03_price_dimension",
    f"WITH {NAMED} SELECT DISTINCT model, {as_double('input', 'input')}, "
    f"{as_double('output', 'output')}, {as_double('cache_read', 'cache_read')}, "
    f"{as_double('cache_write', 'cache_write')} FROM ({LOOKUP})",
)
def dimension_query(spark, sf):
    """P2, P3 in the join form used for large books."""
    return model_dimension(named_models(spark, sf), BUILTIN).select(
        "model", *[F.col(f"price.{f}").alias(f) for f in FIELDS]
    )


@query(
    "p07_tier_choice",
    f"""WITH {NAMED}
    SELECT nm.model, CAST(count(*) AS BIGINT) AS requests, CAST(count(t.i) AS BIGINT) AS tiered,
      CAST(CAST(max(t.i) AS VARCHAR) AS DOUBLE) AS tier_input,
      CAST(CAST(max(t.o) AS VARCHAR) AS DOUBLE) AS tier_output
    FROM nm LEFT JOIN tier t ON (name = prefix OR starts_with(name, prefix || '-'))
      AND size > lim AND NOT {DENIED}
      AND NOT list_bool_or(list_transform(skip, x -> name = x OR starts_with(name, x || '-')))
    GROUP BY nm.model""".replace(
        "AND NOT list_bool_or(list_transform(skip, x -> name = x OR starts_with(name, x || '-')))",
        "AND len(list_filter(skip, lambda x: name = x OR starts_with(name, x || '-'))) = 0",
    ),
)
def tier_query(spark, sf):
    """How many requests of a model are above a threshold, and at which rates."""
    rows = named_models(spark, sf).withColumn(
        "tier", BUILTIN.tier_price(F.col("model"), F.col("size"))
    )
    return rows.groupBy("model").agg(
        F.count("*").alias("requests"),
        F.count("tier").alias("tiered"),
        in_dollars(F.max("tier.input")).alias("tier_input"),
        in_dollars(F.max("tier.output")).alias("tier_output"),
    )


@query(
    "p09_request_cost",
    f"WITH {REQUESTS} SELECT event_id, model, {usd('cost_micro')} AS cost_usd FROM req",
)
def cost_query(spark, sf):
    """Cost of every request."""
    return requests(spark, sf).select(
        "event_id", "model", dollars(F.col("cost_micro")).alias("cost_usd")
    )


OWN_RATES = """own(model, i, o, r, w, lim, li, lo, lr, lw, lim2, mi, mo, mr, mw) AS (VALUES
  ('claude-sonnet-4-20250514', 3.0, 15.0, 0.3, 3.75, 200000, 6.0, 22.5, 0.6, 7.5, NULL, NULL, NULL, NULL, NULL),
  ('gpt-5.4', 2.5, 15.0, 0.25, 0.0, NULL, NULL, NULL, NULL, NULL, 400000, 7.0, 25.0, 0.7, 0.0),
  ('gpt-5.4-pro', 30.0, 180.0, 0.0, 0.0, NULL, NULL, NULL, NULL, NULL, 400000, 7.0, 25.0, 0.7, 0.0),
  ('claude-opus-4-7', 4.0, 20.0, 0.4, 5.0, 100000, 6.0, 30.0, 0.6, 7.0, 300000, 8.0, 40.0, 0.8, 9.0),
  ('<synthetic>', 0.0, 0.0, 0.0, 0.0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)
)"""


def own_cost(k_1h: str) -> str:
    total = "input_tokens + cache_read_tokens + cache_creation_tokens"

    def rate(k: str) -> str:
        return (
            f"CAST(CASE WHEN {total} > lim2 THEN m{k} WHEN {total} > lim THEN l{k} ELSE {k} END "
            f"AS DECIMAL(12,6))"
        )

    half = "CAST(floor(cache_creation_tokens / 2) AS BIGINT)"
    long_write = f"CASE WHEN starts_with(own.model, 'claude-') THEN 9.0 ELSE 2 * {rate('i')} END"
    return (
        f"CAST(input_tokens AS DECIMAL(20,0)) * {rate('i')} + CAST(output_tokens AS DECIMAL(20,0)) * "
        f"{rate('o')} + CAST(cache_read_tokens AS DECIMAL(20,0)) * {rate('r')} + "
        f"CAST(cache_creation_tokens - {half} AS DECIMAL(20,0)) * {rate('w')} + "
        f"CAST({half} AS DECIMAL(20,0)) * CAST({long_write} AS DECIMAL(12,6))"
    )


@query(
    "p10_session_cost",
    f"""WITH {REQUESTS},
    s AS (SELECT agent_type, session_id, arg_max(model, event_id) AS model,
      {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in TOKENS)} FROM ev GROUP BY ALL)
    SELECT agent_type, session_id, s.model, {usd(cost(TOKENS, "FALSE"))} AS cost_usd
    FROM s LEFT JOIN rates rt ON rt.model = s.model""",
)
def session_cost_query(spark, sf):
    """P10: session sums at base rates, whatever their size."""
    sums = (
        requests(spark, sf)
        .groupBy("agent_type", "session_id")
        .agg(F.max_by("model", "event_id").alias("model"), *[F.sum(c).alias(c) for c in TOKENS])
    )
    priced = BUILTIN.with_cost(
        sums, "cost_micro", F.col("model"), *[F.col(c) for c in TOKENS], long_context=False
    )
    return priced.select(
        "agent_type", "session_id", "model", dollars(F.col("cost_micro")).alias("cost_usd")
    )


@query(
    "p08_cache_1h_cost",
    f"WITH {BASE}, {OWN_RATES} SELECT event_id, ev.model, CASE WHEN input_tokens <= 0 AND "
    f"output_tokens <= 0 AND cache_read_tokens <= 0 AND cache_creation_tokens <= 0 THEN 0.0 ELSE "
    f"{usd('CAST(' + own_cost('') + ' AS DECIMAL(38,6))')} END AS cost_usd "
    f"FROM ev JOIN own ON own.model = ev.model",
)
def own_book_query(spark, sf):
    """P5, P7, P8, P9 with the user's prices, tiers, 1h rate and disabled built-in tier."""
    half = F.floor(F.col("cache_creation_tokens") / 2)
    rows = requests(spark, sf).drop("cost_micro")
    priced = OWN_BOOK.with_cost(
        rows, "cost_micro", F.col("model"), *[F.col(c) for c in TOKENS], half
    )
    return priced.select("event_id", "model", dollars(F.col("cost_micro")).alias("cost_usd"))


LIST_SQL = f"""WITH {NAMED}, {BASE},
  used AS (SELECT model, CAST(count(*) AS BIGINT) AS requests FROM ev GROUP BY model),
  own(model, i, o, r, w) AS (VALUES ('gpt-5.4-pro', 30.0, 180.0, 0.0, 0.0),
    ('claude-opus-4-7', 4.0, 20.0, 0.4, 5.0))
SELECT coalesce(own.model, prefix) AS model, {as_double('coalesce(own.i, book.i)', 'input')},
  {as_double('coalesce(own.o, book.o)', 'output')}, {as_double('coalesce(own.r, book.r)', 'cache_read')},
  {as_double('coalesce(own.w, book.w)', 'cache_write')},
  CASE WHEN own.model IS NULL THEN 'builtin' WHEN prefix IS NULL THEN 'custom' ELSE 'override' END
    AS source, coalesce(requests, 0) AS requests
FROM book FULL JOIN own ON own.model = prefix
LEFT JOIN used ON used.model = coalesce(own.model, prefix)"""


@query("p11_price_list", LIST_SQL)
def price_list_query(spark, sf):
    """The effective price list with the requests booked on each listed id."""
    used = requests(spark, sf).groupBy("model").agg(F.count("*").alias("requests"))
    return (
        price_list(spark, OWN_BOOK)
        .join(used, "model", "left")
        .withColumn("requests", F.coalesce("requests", F.lit(0)))
    )


TIER_SQL = f"""WITH {NAMED}, {BASE},
  listed AS (
    SELECT prefix, lim, i, o, r, w, CASE WHEN prefix = 'gpt-5.4' THEN 'disabled' ELSE 'builtin' END
      AS source FROM tier
    UNION ALL SELECT * FROM (VALUES ('claude-opus', 100000, 6.0, 30.0, 0.6, 7.0, 'user'),
      ('claude-opus', 300000, 8.0, 40.0, 0.8, 9.0, 'user'), ('gpt-5.4', 400000, 7.0, 25.0, 0.7, 0.0, 'user'))
  )
SELECT prefix, CAST(lim AS BIGINT) AS threshold, {as_double('i', 'input')}, {as_double('o', 'output')},
  {as_double('r', 'cache_read')}, {as_double('w', 'cache_write')}, source,
  CAST(count(event_id) AS BIGINT) AS requests_above
FROM listed LEFT JOIN ev ON (model = prefix OR starts_with(model, prefix || '-'))
  AND input_tokens + cache_read_tokens + cache_creation_tokens > lim
GROUP BY prefix, lim, i, o, r, w, source"""


@query("p12_tier_list", TIER_SQL)
def tier_list_query(spark, sf):
    """The effective tiers with the requests above each threshold."""
    from meterstone.functions.text import dash_prefixes

    tiers = tier_list(spark, OWN_BOOK)
    total = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    sized = requests(spark, sf).select("model", total.alias("total"))
    # No tier can apply to a request below the smallest threshold.
    lowest = tiers.agg(F.min("threshold")).scalar()
    sized = sized.filter(F.col("total") > lowest)
    # Tiers are configuration (a dozen rows); requests meet them by dash prefix.
    prefixes = sized.select("total", F.explode(dash_prefixes(F.col("model"))).alias("prefix"))
    above = (
        prefixes.join(F.broadcast(tiers.select("prefix", "threshold").distinct()), "prefix")
        .filter(F.col("total") > F.col("threshold"))
        .groupBy("prefix", "threshold")
        .agg(F.count("*").alias("requests_above"))
    )
    return tiers.join(above, ["prefix", "threshold"], "left").withColumn(
        "requests_above", F.coalesce("requests_above", F.lit(0))
    )


EDITS_SQL = """ed AS (
  SELECT event_id AS version,
    ['model', 'tier', 'disable', 'cache', 'tier'][event_id % 5 + 1] AS kind,
    concat('m-', user_id % 13) AS model,
    CASE WHEN event_id % 5 = 1 THEN (event_id % 3) * 1000 WHEN event_id % 5 = 4 AND event_id % 17 <> 0
      THEN (event_id % 3) * 1000 END AS threshold,
    CASE WHEN event_id % 5 = 4 OR event_id % 7 = 0 THEN 'remove' ELSE 'set' END AS op,
    CAST(event_id % 90 + 1 AS DOUBLE) AS price
  FROM events
),
ed2 AS (
  SELECT version, kind, model, threshold, op, price FROM ed
  WHERE NOT (kind = 'tier' AND op = 'set' AND threshold IS NULL)
  UNION ALL SELECT version, 'disable', model, NULL, 'remove', NULL FROM ed
  WHERE kind = 'tier' AND op = 'set'
),
lim AS (SELECT max(event_id) // 2 AS reset FROM events),
last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, model, threshold
    ORDER BY version DESC) AS rn FROM ed2) WHERE rn = 1
)"""


@query(
    "p13_book_edits",
    f"""WITH {EDITS_SQL} SELECT kind, model, threshold, price AS input, version FROM last
    WHERE op = 'set' AND version > (SELECT reset FROM lim) AND version > coalesce((SELECT max(version)
      FROM ed2 s WHERE s.kind = 'tier' AND last.kind = 'tier' AND s.op = 'remove' AND s.threshold IS NULL
      AND s.model = last.model), -1)""",
)
def edits_query(spark, sf):
    """Every event edits a rule; a reset in the middle clears the first half."""
    e = F.col("event_id")
    kinds = F.array(*[F.lit(k) for k in ("model", "tier", "disable", "cache", "tier")])
    threshold = F.when(
        (e % 5 == 1) | ((e % 5 == 4) & (e % 17 != 0)), (e % 3) * 1000
    )
    price = (e % 90 + 1).cast("decimal(12,6)")
    events = table(spark, sf, "events")
    edits = events.select(
        e.alias("version"),
        F.get(kinds, (e % 5).cast("int")).alias("kind"),
        F.concat(F.lit("m-"), (F.col("user_id") % 13).cast("string")).alias("model"),
        threshold.alias("threshold"),
        F.when((e % 5 == 4) | (e % 7 == 0), "remove").otherwise("set").alias("op"),
        *[price.alias(c) for c in (*PRICE_COLS, "write_1h")],
    )
    reset = events.agg(F.floor(F.max("event_id") / 2).alias("version")).select(
        "version",
        F.lit("all").alias("kind"),
        F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("bigint").alias("threshold"),
        F.lit("remove").alias("op"),
        *[F.lit(None).cast("decimal(12,6)").alias(c) for c in (*PRICE_COLS, "write_1h")],
    )
    return current_rules(edits.unionByName(reset)).select(
        "kind", "model", "threshold", "input", "version"
    )
