"""Report queries over the usage source.

Every report is filter, aggregate, finish. The filter is a date literal; the
aggregate combines before its shuffle; labels, shares, zero fill and ordering
happen on the few rows that are left. Costs are published in USD.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterstone.functions import measures as M
from meterstone.functions.pricebook import BUILTIN, PriceBook
from meterstone.functions.text import nonempty
from meterstone.operators import calendar as cal
from meterstone.operators.usage import between, preferred_model, real_model
from meterstone.schemas import COUNTERS, SESSION_KEY, TOKEN_COLS
from meterstone.session import cut_lineage

USD = "estimated_cost_usd"
SMALL_REPORT = 10_000
# Parts of the models of one agent that are ranked on their own first.
RANK_PARTS = 64


def publish(df: DataFrame) -> DataFrame:
    """Replace the exact cost by USD."""
    return df.withColumn(USD, M.dollars(F.col("cost_micro"))).drop("cost_micro")


def by_cost() -> list[Column]:
    return [F.col("cost_micro").desc(), F.col("unknown_cost_count").desc()]


def totals(usage: DataFrame, first: date, last: date) -> DataFrame:
    """One row for a date range."""
    return publish(between(usage, first, last).agg(*M.standard("message_count", "user_turns")))


def by_agent(usage: DataFrame, first: date, last: date) -> DataFrame:
    """Agents, dearest first."""
    rows = between(usage, first, last).groupBy("agent_type").agg(*M.standard("user_turns"))
    return publish(rows.orderBy(*by_cost(), "agent_type"))


def agent_models(usage: DataFrame, first: date, last: date) -> DataFrame:
    return (
        between(usage, first, last)
        .groupBy("agent_type", F.col("model").alias("raw_model"))
        .agg(*M.standard())
    )


def by_agent_model(
    usage: DataFrame, first: date, last: date, book: PriceBook = BUILTIN
) -> DataFrame:
    """Agent by model with the display label of the model."""
    rows = agent_models(usage, first, last).orderBy("agent_type", *by_cost(), "raw_model")
    return publish(rows.withColumn("model", book.label(F.col("raw_model"))))


def by_project(usage: DataFrame, first: date, last: date, limit: int = 10) -> DataFrame:
    """Dearest projects. The limit is the report's own."""
    name = F.when(F.col("project_path") == "", "(unspecified)").otherwise(F.col("project_path"))
    rows = (
        between(usage, first, last)
        .groupBy("project_path")
        .agg(*M.standard("user_turns"))
        .orderBy(*by_cost(), "project_path")
        .limit(limit)
    )
    return publish(rows.withColumn("project_path", name))


def by_time_model(
    usage: DataFrame, first: date, last: date, limit: int = 10, book: PriceBook = BUILTIN
) -> DataFrame:
    """Dearest (date, hour, agent, model) buckets; all-unknown rows at the end."""
    keys = ["usage_date", "usage_hour", "agent_type", "model"]
    rows = (
        between(usage, first, last)
        .groupBy(*keys)
        .agg(*M.standard("user_turns"))
        .filter(M.cost_signal())
        .orderBy(*by_cost(), *keys)
        .limit(limit)
        .withColumnRenamed("model", "raw_model")
        .withColumn("model", book.label(F.col("raw_model")))
        .orderBy(M.unknown_last(), *by_cost(), "usage_date", "usage_hour", "agent_type", "raw_model")
    )
    return publish(rows)


def session_parts(usage: DataFrame) -> DataFrame:
    """Sums per session, model and project: few rows per session, numeric state only."""
    cost = F.col("cost_micro")
    return usage.groupBy(*SESSION_KEY, "model", "project_path").agg(
        *[M.total(c).alias(c) for c in COUNTERS],
        M.known_cost(F.when(cost > 0, cost)).alias("billed_cost"),
        M.unknown_count(cost).alias("unknown_cost_count"),
        M.known_cost(cost).alias("cost_micro"),
    )


def top_sessions(
    usage: DataFrame,
    sessions: DataFrame,
    first: date,
    last: date,
    limit: int = 10,
    book: PriceBook = BUILTIN,
) -> DataFrame:
    """Dearest sessions with their billed models.

    Summed per (session, model, project) first and per session then: the first
    step has numbers only, so it aggregates in hash tables, and the model list
    of a session is built from one row per model, never from its buckets. Only
    the ``limit`` survivors meet the sessions table.
    """
    top = (
        session_parts(between(usage, first, last))
        .withColumn(
            "billed_model",
            F.when(
                real_model(F.col("model")).isNotNull()
                & ((F.col("billed_cost") > 0) | (F.col("unknown_cost_count") > 0)),
                F.col("model"),
            ),
        )
        .groupBy(*SESSION_KEY)
        .agg(
            *[M.total(c).alias(c) for c in COUNTERS],
            M.total("unknown_cost_count").alias("unknown_cost_count"),
            M.known_cost(F.col("cost_micro")).alias("cost_micro"),
            F.max(nonempty(F.col("project_path"))).alias("usage_project"),
            F.max(real_model(F.col("model"))).alias("usage_model"),
            F.array_sort(F.collect_set("billed_model")).alias("billed"),
        )
        .filter(M.cost_signal())
        .orderBy(*by_cost(), *SESSION_KEY)
        .limit(limit)
    )
    # ``limit`` rows, cut so that they can be broadcast to the sessions table and
    # still be the preserved side of the join without summing the facts twice. A
    # limit beyond any report is left to the planner.
    top = cut_lineage(top)
    small = F.broadcast if limit <= SMALL_REPORT else (lambda frame: frame)
    described = sessions.join(small(top.select(*SESSION_KEY)), SESSION_KEY).select(
        *SESSION_KEY,
        F.col("project_path").alias("session_project"),
        "first_prompt",
        "started_at",
        "ended_at",
        F.col("model").alias("session_model"),
    )
    labels = F.array_distinct(F.transform("billed", book.label))
    shown = F.when(
        (F.col("unknown_cost_count") > 0) & (F.size(labels) == 0), F.array(F.lit("Unknown"))
    ).otherwise(labels)
    rows = (
        top.join(small(described), SESSION_KEY, "left")
        .withColumn("raw_model", preferred_model(F.col("session_model"), F.col("usage_model")))
        .select(
            *SESSION_KEY,
            F.coalesce(
                nonempty(F.col("session_project")), F.col("usage_project"), F.lit("")
            ).alias("project_path"),
            *[
                F.coalesce(F.col(c), F.lit("")).alias(c)
                for c in ("first_prompt", "started_at", "ended_at")
            ],
            "raw_model",
            book.label(F.col("raw_model")).alias("model"),
            F.array_join("billed", ",").alias("raw_models"),
            F.array_join(shown, ",").alias("models"),
            *COUNTERS,
            "cost_micro",
            "unknown_cost_count",
        )
        .orderBy(M.unknown_last(), *by_cost(), *SESSION_KEY)
    )
    return publish(rows)


def daily(usage: DataFrame, first: date, last: date) -> DataFrame:
    """Days with data, oldest first."""
    rows = between(usage, first, last).groupBy("usage_date").agg(*M.standard())
    return publish(rows.orderBy("usage_date"))


def day_overview(usage: DataFrame, day: date) -> DataFrame:
    """One day overall (agent NULL) and per agent.

    The agent is part of a session's key, so the overall counts are sums of the
    agent rows and the facts are aggregated once.
    """
    per_agent = (
        between(usage, day, day)
        .groupBy("agent_type")
        .agg(*M.standard("message_count", "user_turns"))
    )
    return publish(roll_up_agents(per_agent))


def roll_up_agents(per_agent: DataFrame) -> DataFrame:
    added = [c for c in per_agent.columns if c not in ("agent_type", "cost_micro")]
    return per_agent.rollup("agent_type").agg(
        *[M.total(c).alias(c) for c in added],
        M.known_cost(F.col("cost_micro")).alias("cost_micro"),
    )


def trend_rows(usage: DataFrame, as_of: date, days: int) -> DataFrame:
    first = as_of - timedelta(days=days)
    return (
        usage.filter(F.col("usage_date") >= F.lit(first))
        .groupBy("usage_date")
        .agg(*M.standard("user_turns", "message_count"))
    )


def daily_trend(usage: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """From ``days`` days ago on, newest first (that is days + 1 dates)."""
    return publish(trend_rows(usage, as_of, days).orderBy(F.col("usage_date").desc()))


def model_breakdown(
    usage: DataFrame, as_of: date, days: int = 30, book: PriceBook = BUILTIN
) -> DataFrame:
    """Named models from ``days`` days ago on, dearest first."""
    first = as_of - timedelta(days=days)
    cost = F.col("cost_micro")
    rows = (
        usage.filter((F.col("usage_date") >= F.lit(first)) & (F.col("model") != ""))
        .groupBy(F.col("model").alias("raw_model"))
        .agg(
            *[M.total(c).alias(c) for c in TOKEN_COLS],
            M.known_cost(cost).alias("cost_micro"),
            M.unknown_count(cost).alias("unknown_cost_count"),
        )
        .orderBy(*by_cost(), "raw_model")
    )
    return publish(rows.withColumn("model", book.label(F.col("raw_model"))))


def day_session_totals(usage: DataFrame, day: date) -> DataFrame:
    """One row per session active on a day."""
    return (
        session_parts(between(usage, day, day))
        .groupBy(*SESSION_KEY)
        .agg(
            *[M.total(c).alias(c) for c in COUNTERS],
            M.known_cost(F.col("cost_micro")).alias("cost_micro"),
            M.total("unknown_cost_count").alias("unknown_cost_count"),
            F.max(nonempty(F.col("project_path"))).alias("usage_project"),
            F.max(real_model(F.col("model"))).alias("usage_model"),
        )
    )


def day_sessions(
    usage: DataFrame, sessions: DataFrame, day: date, book: PriceBook = BUILTIN
) -> DataFrame:
    """Sessions active on a day, newest start first."""
    described = sessions.select(
        *SESSION_KEY,
        F.col("project_path").alias("session_project"),
        F.col("model").alias("session_model"),
        "git_branch",
        "started_at",
        "ended_at",
        "first_prompt",
        "last_prompt",
    )
    rows = (
        day_session_totals(usage, day)
        .join(described, SESSION_KEY, "left")
        .withColumn("raw_model", preferred_model(F.col("session_model"), F.col("usage_model")))
        .select(
            *SESSION_KEY,
            F.coalesce(
                nonempty(F.col("session_project")), F.col("usage_project"), F.lit("")
            ).alias("project_path"),
            *[
                F.coalesce(F.col(c), F.lit("")).alias(c)
                for c in ("git_branch", "started_at", "ended_at", "first_prompt", "last_prompt")
            ],
            "raw_model",
            book.label(F.col("raw_model")).alias("model"),
            *COUNTERS,
            "cost_micro",
            "unknown_cost_count",
        )
        .orderBy(F.col("started_at").desc(), *SESSION_KEY)
    )
    return publish(rows)


def top_projects(sessions: DataFrame, limit: int = 10) -> DataFrame:
    """Projects with the most messages, over sessions; the cost skips unknown ones."""
    rows = (
        sessions.filter(F.col("project_path") != "")
        .groupBy("project_path")
        .agg(
            F.count("*").alias("session_count"),
            F.sum("message_count").alias("total_messages"),
            F.sum("cost_micro").alias("total_micro"),
        )
        .orderBy(F.col("total_messages").desc(), "project_path")
        .limit(limit)
    )
    return rows.withColumn("total_cost", M.dollars(F.col("total_micro"))).drop("total_micro")


# ── Calendars ────────────────────────────────────────────────────────────


def fill(spine: DataFrame, facts: DataFrame) -> DataFrame:
    """Zero-filled calendar, oldest first.

    ``facts`` holds at most one row per calendar bucket (24 hours or some weeks),
    whatever the size of the table it was summed from, and may be broadcast.
    """
    measures = [c for c in facts.columns if c != "bucket"]
    zero = {c: F.lit(0).cast(facts.schema[c].dataType) for c in measures}
    rows = spine.join(F.broadcast(facts), "bucket", "left").withColumns(
        {c: F.coalesce(F.col(c), zero[c]) for c in measures}
    )
    return rows.drop("bucket").orderBy("position")


def heat_measures() -> list[Column]:
    cost = F.col("cost_micro")
    tokens = F.lit(0).cast("bigint")
    for c in TOKEN_COLS:
        tokens = tokens + M.total(c)
    return [
        M.known_cost(cost).alias("cost_micro"),
        M.unknown_count(cost).alias("unknown_cost_count"),
        tokens.alias("tokens"),
        M.session_count().alias("session_count"),
    ]


def heat_rows(usage: DataFrame, kind: str, as_of: date, offset: int = 0) -> DataFrame:
    spark = usage.sparkSession
    if kind == "today":
        day = as_of - timedelta(days=offset)
        span = (day, day)
        spine, bucket = cal.hour_spine(spark), F.col("usage_hour")
    elif kind == "week":
        monday = cal.monday_of(as_of) - timedelta(weeks=offset)
        span = (monday, monday + timedelta(days=6))
        spine, bucket = cal.week_spine(spark, monday), F.col("usage_date")
    elif kind == "month":
        first = cal.month_start(as_of, offset)
        span = (first, cal.month_end(first))
        spine = cal.month_weeks_spine(spark, first)
        bucket = F.to_date(F.date_trunc("week", "usage_date"))
    else:
        raise ValueError(f"unknown focus: {kind}")
    facts = between(usage, *span).groupBy(bucket.alias("bucket")).agg(*heat_measures())
    return fill(spine, facts)


def publish_cost(df: DataFrame) -> DataFrame:
    return df.withColumn("cost", M.dollars(F.col("cost_micro"))).drop("cost_micro")


def heatmap(usage: DataFrame, kind: str, as_of: date, offset: int = 0) -> DataFrame:
    """Hours of a day, days of a week or weeks of a month, zero filled."""
    return publish_cost(heat_rows(usage, kind, as_of, offset))


def trend_series(usage: DataFrame, unit: str, as_of: date, count: int) -> DataFrame:
    spark = usage.sparkSession
    if unit == "hour":
        facts = between(usage, as_of, as_of).groupBy(F.col("usage_hour").alias("bucket"))
        spine = cal.hour_spine(spark)
    else:
        spine = cal.trend_spine(spark, unit, as_of, count)
        first, last = {
            "day": (as_of - timedelta(days=count - 1), as_of),
            "week": (
                cal.monday_of(as_of) - timedelta(weeks=count - 1),
                cal.monday_of(as_of) + timedelta(days=6),
            ),
            "month": (
                cal.month_start(as_of, count - 1),
                cal.month_end(cal.month_start(as_of)),
            ),
        }[unit]
        bucket = F.to_date(F.date_trunc(unit, "usage_date"))
        facts = between(usage, first, last).groupBy(bucket.alias("bucket"))
    return fill(spine, facts.agg(M.known_cost(F.col("cost_micro")).alias("cost_micro")))


def trend(usage: DataFrame, unit: str, as_of: date, count: int = 24) -> DataFrame:
    """Cost of the last ``count`` buckets, zero filled, oldest first; hours are always 24."""
    return publish_cost(trend_series(usage, unit, as_of, count))


# ── Comparisons ──────────────────────────────────────────────────────────


def delta_columns(cost: str, unknown: str, before: str, before_unknown: str) -> dict[str, Column]:
    """Kind and size of the change of a cost against the period before."""
    now, then = F.col(cost), F.col(before)
    ratio = F.try_divide(now, then)
    close = (F.abs(now - then) < 0.01) | (F.abs(ratio - 1.0) < 0.01)
    kind = (
        F.when((F.col(unknown) > 0) | (F.col(before_unknown) > 0), F.lit(None))
        .when((then <= 0) & (now <= 0), F.lit(None))
        .when(then <= 0, "new")
        .when(close, "flat")
        .when((now > then) & (ratio >= 10), "up_10x")
        .when(now > then, "up")
        .otherwise("down")
    )
    pct = F.when(kind.isin("up", "down"), (ratio - 1.0) * 100.0)
    return {"delta_kind": kind, "delta_pct": pct}


# The periods of the summary, in the order they are shown.
PERIODS = ("today", "week", "month")


def period_rows(usage: DataFrame, as_of: date, kinds: tuple[str, ...] = PERIODS) -> DataFrame:
    """One row per period, current and previous, from one pass over the facts.

    A row belongs to every period whose dates contain it; rows outside all of
    them are not read.
    """
    spans = [
        (kind, offset, cal.named_range(kind, as_of, offset)) for kind in kinds for offset in (0, 1)
    ]
    day = F.col("usage_date")
    member = F.array(
        *[
            F.when(
                day.between(F.lit(r.first), F.lit(r.last)),
                F.struct(F.lit(kind).alias("period"), F.lit(offset).alias("back")),
            )
            for kind, offset, r in spans
        ]
    )
    wanted = F.lit(False)
    for _, _, r in spans:
        wanted = wanted | day.between(F.lit(r.first), F.lit(r.last))
    # Summed per session and day first, so that only those few rows are repeated.
    cost = F.col("cost_micro")
    small = (
        usage.filter(wanted)
        .groupBy(*SESSION_KEY, "usage_date")
        .agg(
            *[M.total(c).alias(c) for c in COUNTERS],
            M.known_cost(cost).alias("cost_micro"),
            M.unknown_count(cost).alias("unknown_cost_count"),
        )
    )
    facts = (
        small.select("*", F.inline(F.array_compact(member)))
        .groupBy("period", "back")
        .agg(
            M.session_count().alias("session_count"),
            *[M.total(c).alias(c) for c in (*COUNTERS, "unknown_cost_count")],
            M.known_cost(cost).alias("cost_micro"),
        )
        .withColumn("bucket", F.concat_ws(":", "period", F.col("back").cast("string")))
        .drop("period", "back")
    )
    names = [
        F.struct(
            F.lit(f"{kind}:{offset}").alias("bucket"),
            F.lit(kind).alias("period"),
            F.lit(offset).alias("back"),
            F.lit(r.first).alias("first_day"),
            F.lit(r.last).alias("last_day"),
            F.lit(i).alias("position"),
        )
        for i, (kind, offset, r) in enumerate(spans)
    ]
    spine = usage.sparkSession.range(1).select(F.inline(F.array(*names)))
    return publish(fill(spine, facts))


def compare_periods(rows: DataFrame) -> DataFrame:
    """Put the previous period beside the current one: a pivot, so the facts are summed once."""

    def at(back: int, name: str) -> Column:
        return F.max(F.when(F.col("back") == back, F.col(name)))

    kept = [c for c in rows.columns if c not in ("period", "back")]
    return (
        rows.groupBy("period")
        .agg(
            *[at(0, c).alias(c) for c in kept],
            at(1, USD).alias("prev_cost_usd"),
            at(1, "unknown_cost_count").alias("prev_unknown_count"),
        )
        .withColumns(delta_columns(USD, "unknown_cost_count", "prev_cost_usd", "prev_unknown_count"))
        .orderBy("position")
    )


def period_delta(usage: DataFrame, kind: str, as_of: date) -> DataFrame:
    """A named period against the one before it."""
    rows = compare_periods(period_rows(usage, as_of, (kind,)))
    return rows.select(
        "period", USD, "prev_cost_usd", "prev_unknown_count", "unknown_cost_count",
        "delta_kind", "delta_pct",
    )


def summary(usage: DataFrame, as_of: date) -> DataFrame:
    """Today, week and month with requests, tokens, cache share and change."""
    rows = compare_periods(period_rows(usage, as_of))
    share = F.bround(M.cache_share_pct(), 0).cast("int")
    return rows.withColumns(
        {"requests": M.requests(), "tokens": M.all_tokens(), "cache_share": share}
    ).select(
        "period", "first_day", "last_day", "session_count", "user_turns", "requests", "tokens",
        "cache_share", USD, "unknown_cost_count", "prev_cost_usd", "delta_kind", "delta_pct",
    )


# ── Derived views ────────────────────────────────────────────────────────


def model_rows(usage: DataFrame, first: date, last: date, book: PriceBook) -> DataFrame:
    """Agent-model rows worth showing, with the token split of the breakdown panel."""
    return (
        agent_models(usage, first, last)
        .filter(M.cost_signal())
        .withColumns(
            {
                "model": book.label(F.col("raw_model")),
                "tokens": M.all_tokens(),
                "cache": M.cache_tokens(),
            }
        )
        .withColumnsRenamed({"input_tokens": "input", "output_tokens": "output"})
    )


def nested_breakdown(
    usage: DataFrame, first: date, last: date, book: PriceBook = BUILTIN
) -> DataFrame:
    """One row per agent with its models nested, dearest first.

    The nested list has one entry per model the agent used, already summed.
    """
    cost = F.col("cost_micro")
    entry = F.struct(
        (-cost).alias("rank"),
        "raw_model",
        "model",
        M.dollars(cost).alias("cost"),
        "unknown_cost_count",
        "tokens",
        "input",
        "output",
        "cache",
    )
    added = ("tokens", "input", "output", "cache", "unknown_cost_count")
    groups = (
        model_rows(usage, first, last, book)
        .groupBy("agent_type")
        .agg(
            M.known_cost(cost).alias("cost_micro"),
            *[M.total(c).alias(c) for c in added],
            F.array_sort(F.collect_list(entry)).alias("ranked"),
        )
        .withColumn("models", F.transform("ranked", lambda m: m.dropFields("rank")))
        .drop("ranked")
        .orderBy(*by_cost(), "agent_type")
    )
    return publish(groups)


def folded_models(
    usage: DataFrame, first: date, last: date, top: int, book: PriceBook = BUILTIN
) -> DataFrame:
    """Per agent the ``top`` dearest known models, all unknown ones, and the rest as one row.

    Ranks are taken over summed (agent, model) rows of known models, first within
    parts of an agent's models and then among the best of each part: model names
    are free text, so an agent may have any number of them.
    """
    cost = F.col("cost_micro")
    rows = model_rows(usage, first, last, book).withColumn(
        "is_unknown", F.col("unknown_cost_count") > 0
    )
    best = rows.filter(~F.col("is_unknown")).select("agent_type", "raw_model", "cost_micro")
    part = F.pmod(F.hash("raw_model"), F.lit(RANK_PARTS))
    for group in (["agent_type", part], ["agent_type"]):
        rank = W.partitionBy(*group).orderBy(cost.desc(), "raw_model")
        best = best.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top)
    kept = best.select("agent_type", "raw_model", F.lit(True).alias("kept"))
    ranked = rows.join(kept, ["agent_type", "raw_model"], "left").withColumn(
        "folded", F.col("kept").isNull() & ~F.col("is_unknown")
    )
    shown = F.when(~F.col("folded"), F.col("raw_model"))
    rows = (
        ranked.groupBy("agent_type", "is_unknown", "folded", shown.alias("raw_model"))
        .agg(
            F.max(F.when(~F.col("folded"), F.col("model"))).alias("label"),
            F.count("*").alias("model_count"),
            M.known_cost(cost).alias("cost_micro"),
            *[
                M.total(c).alias(c)
                for c in ("tokens", "input", "output", "cache", "unknown_cost_count")
            ],
        )
        .withColumn(
            "model",
            F.when(
                F.col("folded"),
                F.concat(F.lit("+"), F.col("model_count").cast("string"), F.lit(" more models")),
            ).otherwise(F.col("label")),
        )
        .drop("label")
        .orderBy("agent_type", "folded", "is_unknown", cost.desc(), "raw_model")
    )
    return publish(rows.drop("is_unknown"))


def peak_bucket(series: DataFrame) -> DataFrame:
    """The dearest bucket; without any cost the first one with unknown cost."""
    telling = (F.col("cost") <= 0) & (F.col("unknown_cost_count") > 0)
    return series.orderBy(
        F.col("cost").desc(), F.when(telling, 0).otherwise(1), "position"
    ).limit(1)


def with_intensity(series: DataFrame, levels: int, blank_zero: bool = False) -> DataFrame:
    """Shade 0..levels-1 of every bucket, half-even rounded.

    With ``blank_zero`` buckets without cost have no shade. The window spans the
    buckets of one calendar.
    """
    whole = W.partitionBy()
    peak = F.max("cost").over(whole)
    ratio = F.col("cost") / F.when(peak > 0, peak).otherwise(F.lit(1.0))
    level = F.least(F.bround(ratio * (levels - 1), 0).cast("int"), F.lit(levels - 1))
    if blank_zero:
        level = F.when(F.col("cost") > 0, level)
    return series.withColumn("level", level)


def active_periods(series: DataFrame) -> DataFrame:
    """Buckets with a cost signal and their ratio to the dearest one."""
    rows = series.filter(M.cost_signal("cost"))
    peak = F.max("cost").over(W.partitionBy())
    return rows.withColumn(
        "ratio", F.col("cost") / F.when(peak > 0, peak).otherwise(F.lit(1e-9))
    )


def with_share(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """Percent of a one-row total; NULL if the row, any shown row or the total is unknown.

    The total is a scalar subquery, the test over the shown rows a window over
    an already limited report.
    """
    any_unknown = F.max("unknown_cost_count").over(W.partitionBy())
    total = whole.select(USD).scalar()
    total_unknown = whole.select("unknown_cost_count").scalar()
    known = (any_unknown == 0) & (total_unknown == 0) & (total > 0)
    return rows.withColumn("share_pct", F.when(known, F.lit(100.0) * F.col(USD) / total))


def cache_rates(rows: DataFrame) -> DataFrame:
    """U8: both cache rates of report rows."""
    return rows.withColumns(
        {"cache_hit_pct": M.cache_hit_pct(), "cache_share_pct": M.cache_share_pct()}
    )


# ── Bundle ───────────────────────────────────────────────────────────────


@dataclass(frozen=True)
class Report:
    """What a full report shows."""

    span: cal.DateRange
    totals: DataFrame
    by_agent: DataFrame
    by_agent_model: DataFrame
    by_project: DataFrame
    periodic: DataFrame | None
    previous: DataFrame | None


def full_report(
    usage: DataFrame,
    as_of: date,
    kind: str = "today",
    span: cal.DateRange | None = None,
    limit: int = 8,
    book: PriceBook = BUILTIN,
) -> Report:
    """Totals, breakdowns, calendar and previous period of a range.

    A custom ``span`` has no calendar and no previous period. The facts of all
    parts are read once and staged, with the columns that the parts need; each
    part is then a lazy frame over the stage.
    """
    named = span is None
    chosen = cal.named_range(kind, as_of) if named else span
    before = cal.named_range(kind, as_of, 1) if named else None
    day = F.col("usage_date")
    wanted = day.between(F.lit(chosen.first), F.lit(chosen.last))
    if before:
        wanted = wanted | day.between(F.lit(before.first), F.lit(before.last))
        # The calendar of a range reaches over its whole week or month.
        first = cal.monday_of(as_of) if kind == "week" else chosen.first
        wanted = wanted | day.between(F.lit(first), F.lit(as_of))
    usage = cut_lineage(usage.filter(wanted))
    return Report(
        chosen,
        totals(usage, chosen.first, chosen.last),
        by_agent(usage, chosen.first, chosen.last),
        by_agent_model(usage, chosen.first, chosen.last, book),
        by_project(usage, chosen.first, chosen.last, limit),
        heatmap(usage, kind, as_of) if named else None,
        totals(usage, before.first, before.last) if before else None,
    )
