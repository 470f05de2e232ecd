"""Distinct sessions from bitmaps (U2), the price file (S4, P14), long lists of rules
and the price seed (P17)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from meterstone.functions.measures import dollars
from meterstone.functions.fixed_prices import builtin_models
from meterstone.functions.pricebook import BUILTIN, PriceBook
from meterstone.operators.sessionbits import distinct_sessions, number_sessions, session_bits
from meterstone.schemas import TOKEN_COLS
from meterstone.session import cut_lineage, new_folder
from meterstone.sources.pricefile import read_price_book
import suite.q_pricing  # noqa: F401  its oracle serves here too
from suite.queries import REGISTRY, query
from suite.sqlbase import BASE, usd
from suite.views import AS_OF, OWN_BOOK, requests, table

CUT = date(2024, 1, 16)
#: Days, weeks and longer spans, one of them without data.
RANGES = [
    (f"{start}..{start + timedelta(days=length)}", start, start + timedelta(days=length))
    for start in (AS_OF, AS_OF - timedelta(days=1), date(2024, 1, 1), date(2024, 1, 10), date(2024, 1, 14), date(2023, 1, 1))
    for length in (0, 6, 29)
]


@query(
    "u02_bitmap_ranges",
    f"""WITH {BASE}, r(label, a, b) AS (VALUES {", ".join(f"('{label}', DATE '{a}', DATE '{b}')" for label, a, b in RANGES)})
    SELECT label, agent_type, CAST(count(DISTINCT (agent_type, session_id)) AS BIGINT) AS session_count
    FROM ev JOIN r ON usage_date BETWEEN a AND b GROUP BY GROUPING SETS ((label, agent_type), (label))""",
)
def bitmap_query(spark, sf):
    """Bitmaps of two instalments of days, of which every range is counted."""
    facts = requests(spark, sf).select("agent_type", "session_id", "usage_date")
    old, new = facts.where(F.col("usage_date") < F.lit(CUT)), facts.where(F.col("usage_date") >= F.lit(CUT))
    known = number_sessions(old)
    numbers = known.union(number_sessions(new, known))
    bits = cut_lineage(session_bits(old, known).union(session_bits(new, numbers)))
    return distinct_sessions(bits, RANGES)


@query(
    "s04_price_file",
    f"""WITH b AS (
      SELECT lower(replace(p_brand, '#', '-')) AS model, min(p_size) AS i, max(p_size) AS o, count(*) % 2 AS odd FROM part GROUP BY 1),
    q AS (
      SELECT p_partkey, lower(replace(p_brand, '#', '-')) AS model, p_size * 100 AS i, p_size AS o, (p_partkey % 7) * 100 AS r,
        p_partkey % 5 AS w FROM part),
    c AS (
      SELECT p_partkey, q.i * b.i + q.o * b.o + q.r * 0.5 + q.w AS base,
        CASE WHEN odd = 0 AND q.i + q.r + q.w > 4000 THEN 4 WHEN q.i + q.r + q.w > 1000 THEN 2 ELSE 1 END AS times
      FROM q JOIN b USING (model))
    SELECT CAST(p_partkey AS BIGINT) AS part_id, {usd("CAST(base * times AS DECIMAL(38,6))")} AS cost_usd FROM c""",
)
def price_file_query(spark, sf):
    """A price file written from the table, with tiers in either form and out of order, prices
    requests of its models."""
    part = table(spark, sf, "part")
    model = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    brands = part.groupBy(model.alias("model")).agg(
        F.min("p_size").alias("i"), F.max("p_size").alias("o"), (F.count("*") % 2).alias("odd")
    )

    def prices(times: int):
        return F.array(F.col("i") * times, F.col("o") * times, F.lit(0.5 * times), F.lit(times)).cast("array<double>")

    def tier(threshold: int, times: int):
        return F.struct(F.lit(threshold).alias("threshold"), prices(times).alias("prices"))

    flat = F.to_json(tier(1000, 2))
    listed = F.to_json(F.struct(F.array(tier(4000, 4), tier(1000, 2)).alias("tiers")))
    entry = F.struct(
        F.concat(F.to_json(F.struct(prices(1).alias("p")))).alias("model_json"),
        F.when(F.col("odd") == 1, flat).otherwise(listed).alias("tier_json"),
    )
    rules = brands.select("model", entry.alias("e")).select("model", "e.*")

    def member(value):
        return F.concat_ws(",", F.collect_list(F.concat(F.lit('"'), F.col("model"), F.lit('":'), value)))

    # One small configuration file: a line for each brand.
    text = rules.agg(
        F.concat(
            F.lit('{"models":{'), member(F.regexp_extract("model_json", r'\{"p":(.*)\}', 1)),
            F.lit('},"long_context":{'), member(F.col("tier_json")), F.lit("}}"),
        ).alias("value")
    )
    path = new_folder(spark, "prices")
    text.coalesce(1).write.text(path)
    book = read_price_book(spark, path)
    size, key = F.col("p_size").cast("bigint"), F.col("p_partkey").cast("bigint")
    asked = part.select(
        key.alias("part_id"), model.alias("model"), (size * 100).alias("i"), size.alias("o"), (key % 7 * 100).alias("r"), (key % 5).alias("w")
    )
    priced = book.with_cost(asked, "cost_micro", F.col("model"), *map(F.col, "iorw"))
    return priced.select("part_id", dollars(F.col("cost_micro")).alias("cost_usd"))


def padded(book: PriceBook, rules: int) -> PriceBook:
    """``book`` among so many rules of every kind for models that nobody uses."""
    names = [f"pad-{k % 100}-{k}" for k in range(rules)]
    return PriceBook(
        {**dict.fromkeys(names, next(iter(book.models.values()))), **book.models},
        {**dict.fromkeys(names, next(iter(book.tiers.values()))), **book.tiers},
        {**dict.fromkeys(names, next(iter(book.write_1h.values()))), **book.write_1h},
        book.disabled,
    )


@query("p05_long_rules", REGISTRY["p08_cache_1h_cost"][1])
def long_rules_query(spark, sf):
    """The user's book among 50,000 model prices, tiers and 1h rates each."""
    half = F.floor(F.col("cache_creation_tokens") / 2)
    rows = requests(spark, sf).drop("cost_micro")
    book = padded(OWN_BOOK, 50_000)
    priced = book.with_cost(rows, "cost_micro", F.col("model"), *[F.col(c) for c in TOKEN_COLS], half)
    return priced.select("event_id", "model", dollars(F.col("cost_micro")).alias("cost_usd"))


# USD per one million tokens (input, output, cache read, cache write), spelled out once more so
# that the oracle does not depend on the engine's table.
SEED = """
  ('claude-opus-4-7', 5.0, 25.0, 0.50, 6.25), ('claude-opus-4-6', 5.0, 25.0, 0.50, 6.25),
  ('claude-opus-4-5', 5.0, 25.0, 0.50, 6.25), ('claude-opus-4-1', 15.0, 75.0, 1.50, 18.75),
  ('claude-opus-4', 15.0, 75.0, 1.50, 18.75), ('claude-sonnet-4-6', 3.0, 15.0, 0.30, 3.75),
  ('claude-sonnet-4-5', 3.0, 15.0, 0.30, 3.75), ('claude-sonnet-4', 3.0, 15.0, 0.30, 3.75),
  ('claude-sonnet-3-7', 3.0, 15.0, 0.30, 3.75), ('claude-3-7-sonnet', 3.0, 15.0, 0.30, 3.75),
  ('claude-3-5-sonnet', 3.0, 15.0, 0.30, 3.75), ('claude-haiku-4-5', 1.0, 5.0, 0.10, 1.25),
  ('claude-haiku-3-5', 0.80, 4.0, 0.08, 1.00), ('claude-3-5-haiku', 0.80, 4.0, 0.08, 1.00),
  ('claude-3-opus', 15.0, 75.0, 1.50, 18.75), ('claude-3-haiku', 0.25, 1.25, 0.03, 0.30),
  ('gpt-5.5', 5.0, 30.0, 0.50, 0.0), ('gpt-5.4-mini', 0.75, 4.5, 0.075, 0.0),
  ('gpt-5.4-nano', 0.20, 1.25, 0.02, 0.0), ('gpt-5.4', 2.5, 15.0, 0.25, 0.0),
  ('gpt-5.2-codex', 1.75, 14.0, 0.175, 0.0), ('gpt-5.2-chat-latest', 1.75, 14.0, 0.175, 0.0),
  ('gpt-5.2', 1.75, 14.0, 0.175, 0.0), ('gpt-5.1-codex-max', 1.25, 10.0, 0.125, 0.0),
  ('gpt-5.1-codex', 1.25, 10.0, 0.125, 0.0), ('gpt-5.1-chat-latest', 1.25, 10.0, 0.125, 0.0),
  ('gpt-5.1', 1.25, 10.0, 0.125, 0.0), ('gpt-5-codex', 1.25, 10.0, 0.125, 0.0),
  ('gpt-5-chat-latest', 1.25, 10.0, 0.125, 0.0), ('gpt-5', 1.25, 10.0, 0.125, 0.0),
  ('gpt-5.3-codex', 1.75, 14.0, 0.175, 0.0), ('gpt-5.3-chat-latest', 1.75, 14.0, 0.175, 0.0),
  ('gpt-5.3', 1.75, 14.0, 0.175, 0.0), ('gemini-3.1-pro', 2.00, 12.00, 0.20, 0.0),
  ('gemini-3.1-flash-lite', 0.25, 1.50, 0.025, 0.0), ('gemini-3-pro', 2.00, 12.00, 0.20, 0.0),
  ('gemini-3-flash', 0.50, 3.00, 0.05, 0.0), ('gemini-2.5-pro', 1.25, 10.00, 0.125, 0.0),
  ('gemini-2.5-flash', 0.30, 2.50, 0.03, 0.0), ('gemini-2.5-flash-lite', 0.10, 0.40, 0.01, 0.0),
  ('gemini-2.0-flash', 0.10, 0.40, 0.025, 0.0), ('gemini-2.0-flash-lite', 0.075, 0.30, 0.0, 0.0)
"""


@query(
    "p17_price_seed",
    f"""WITH {BASE}, seed(model, i, o, r, w) AS (VALUES {SEED}),
    used AS (SELECT model, CAST(count(*) AS BIGINT) AS requests, CAST(sum(output_tokens) AS BIGINT) AS out FROM ev GROUP BY model)
    SELECT seed.model, CAST(i AS DOUBLE) AS input, CAST(o AS DOUBLE) AS output, CAST(r AS DOUBLE) AS cache_read,
      CAST(w AS DOUBLE) AS cache_write, coalesce(requests, 0) AS requests,
      {usd("CAST(coalesce(out, 0) * CAST(o AS DECIMAL(12,6)) AS DECIMAL(38,6))")} AS output_usd
    FROM seed LEFT JOIN used USING (model)""",
)
def price_seed_query(spark, sf):
    """Every built-in price, the requests of just that model, and what their output costs."""
    rows = requests(spark, sf)
    seed = spark.createDataFrame(
        [(m, *p) for m, p in builtin_models().items()],
        "model string, input decimal(12,6), output decimal(12,6), cache_read decimal(12,6), cache_write decimal(12,6)",
    )
    used = rows.groupBy("model").agg(F.count("*").alias("requests"), F.sum("output_tokens").alias("out"))
    spent = BUILTIN.with_cost(
        used, "cost_micro", F.col("model"), F.lit(0), F.col("out"), F.lit(0), F.lit(0), long_context=False
    )
    joined = seed.join(spent.drop("out"), "model", "left")
    return joined.select(
        "model",
        *[F.col(c).cast("double").alias(c) for c in ("input", "output", "cache_read", "cache_write")],
        F.coalesce("requests", F.lit(0).cast("long")).alias("requests"),
        dollars(F.coalesce("cost_micro", F.lit(0))).alias("output_usd"),
    )
