"""Price rules as rows: lists, edits, the model dimension and repricing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterstone.functions.fixed_prices import (
    SYNTHETIC,
    UNPRICED_FAMILIES,
    builtin_models,
    builtin_tiers,
)
from meterstone.functions.measures import poisoned_cost
from meterstone.functions.pricebook import BROADCAST_LIMIT, PriceBook, canonical
from meterstone.functions.text import dash_prefixes
from meterstone.schemas import PRICE, SESSION_KEY, TOKEN_COLS

PRICE_COLS = ["input", "output", "cache_read", "cache_write"]
MODEL_ROWS = T.StructType(
    [T.StructField("model", T.StringType()), *[T.StructField(c, PRICE) for c in PRICE_COLS]]
)
TIER_ROWS = T.StructType(
    [
        T.StructField("prefix", T.StringType()),
        T.StructField("threshold", T.LongType()),
        *[T.StructField(c, PRICE) for c in PRICE_COLS],
        T.StructField("source", T.StringType()),
    ]
)
CHANGES = T.StructType(
    [
        T.StructField("version", T.LongType()),
        # model, tier, disable, cache or all
        T.StructField("kind", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("threshold", T.LongType()),
        # set or remove
        T.StructField("op", T.StringType()),
        *[T.StructField(c, PRICE) for c in PRICE_COLS],
        T.StructField("write_1h", PRICE),
    ]
)


def builtin_frame(spark: SparkSession) -> DataFrame:
    rows = [(m, *p) for m, p in builtin_models().items()]
    return spark.createDataFrame(rows, MODEL_ROWS)


def own_frame(spark: SparkSession, book: PriceBook) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in book.models.items()], MODEL_ROWS)


def price_list(spark: SparkSession, book: PriceBook) -> DataFrame:
    """Built-in prices overridden by the user's, each with its source."""
    own = own_frame(spark, book).select("model", F.struct(*PRICE_COLS).alias("own"))
    both = builtin_frame(spark).select("model", F.struct(*PRICE_COLS).alias("base")).join(
        own, "model", "full_outer"
    )
    source = (
        F.when(F.col("own").isNull() | F.col("own").eqNullSafe(F.col("base")), "builtin")
        .when(F.col("base").isNotNull(), "override")
        .otherwise("custom")
    )
    return both.select(
        "model", F.coalesce("own", "base").alias("p"), source.alias("source")
    ).select("model", *[F.col(f"p.{c}").alias(c) for c in PRICE_COLS], "source")


def tier_list(spark: SparkSession, book: PriceBook) -> DataFrame:
    """User, built-in and disabled tiers, longest prefix first."""
    rows = [(m, t, *p, "user") for m, tiers in book.tiers.items() for t, p in tiers]
    rows += [
        (m, t, *p, "disabled" if m in book.disabled else "builtin")
        for m, t, p, _ in builtin_tiers()
    ]
    return spark.createDataFrame(rows, TIER_ROWS).orderBy(
        F.length("prefix").desc(), "threshold", "prefix", "source"
    )


def model_dimension(models: DataFrame, book: PriceBook) -> DataFrame:
    """P2, P3 as joins: one row per distinct model with its base price.

    Every model is exploded into its dash prefixes, which turns prefix matching
    into an equi-join; the longest match wins. One row per model, for lists
    and look-ups outside a scan.
    """
    spark = models.sparkSession
    named = models.select("model").distinct().withColumn("name", canonical(F.col("model")))
    candidates = named.select(
        "model", "name", F.explode(dash_prefixes(F.col("name"))).alias("prefix")
    )
    rules = builtin_frame(spark).select(
        F.col("model").alias("prefix"), F.struct(*PRICE_COLS).alias("base")
    )
    matched = (
        candidates.join(F.broadcast(rules), "prefix", "left")
        .groupBy("model", "name")
        .agg(
            F.max_by("base", F.when(F.col("base").isNotNull(), F.length("prefix"))).alias("base"),
            F.max(F.col("prefix").isin(*UNPRICED_FAMILIES)).alias("unpriced"),
        )
    )
    own = own_frame(spark, book).select(
        F.col("model").alias("name"), F.struct(*PRICE_COLS).alias("own")
    )
    # The user's rules are checked before they are broadcast; a longer list is shuffled.
    own = F.broadcast(own) if len(book.models) <= BROADCAST_LIMIT else own
    free = F.struct(*[F.lit(0).cast(PRICE).alias(c) for c in PRICE_COLS])
    price = (
        F.when(F.col("name") == SYNTHETIC, free)
        .when(F.col("own").isNotNull(), F.col("own"))
        .when(~F.col("unpriced"), F.col("base"))
    )
    return matched.join(own, "name", "left").select("model", price.alias("price"))


def current_rules(changes: DataFrame) -> DataFrame:
    """The rules in force after a log of edits.

    The newest edit of a key wins; removals leave nothing. ``all`` clears what
    came before it, removing a tier without threshold clears all tiers of the
    model, and setting a tier enables the built-in rule of the model again.
    """
    named = changes.withColumn("model", canonical(F.col("model")))
    enabling = named.filter((F.col("kind") == "tier") & (F.col("op") == "set")).select(
        "version",
        F.lit("disable").alias("kind"),
        "model",
        F.lit(None).cast("bigint").alias("threshold"),
        F.lit("remove").alias("op"),
        *[F.lit(None).cast(PRICE).alias(c) for c in (*PRICE_COLS, "write_1h")],
    )
    edits = named.unionByName(enabling)
    payload = F.struct("op", *PRICE_COLS, "write_1h")
    newest = (
        edits.filter(F.col("kind") != "all")
        .groupBy("kind", "model", "threshold")
        .agg(F.max_by(payload, "version").alias("r"), F.max("version").alias("version"))
    )
    swept = edits.filter(
        (F.col("kind") == "tier") & (F.col("op") == "remove") & F.col("threshold").isNull()
    )
    swept = swept.groupBy("kind", "model").agg(F.max("version").alias("swept_version"))
    reset = edits.filter(F.col("kind") == "all").agg(F.max("version").alias("v")).scalar()
    none = F.lit(-1).cast("bigint")
    return (
        newest.filter(F.col("r.op") == "set")
        .join(swept, ["kind", "model"], "left")
        .filter(F.col("version") > F.coalesce(F.col("swept_version"), none))
        .filter(F.col("version") > F.coalesce(reset, none))
        .select(
            "kind", "model", "threshold", *[f"r.{c}" for c in (*PRICE_COLS, "write_1h")], "version"
        )
    )


def book_from_rules(rules: DataFrame, most: int = 500_000) -> PriceBook:
    """Load the rules in force into a book. Rules are configuration; more than ``most`` is an error."""
    rows = rules.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} price rules")
    tiers: dict[str, list] = {}
    for r in rows:
        if r.kind == "tier":
            tiers.setdefault(r.model, []).append((r.threshold, [r[c] for c in PRICE_COLS]))
    return PriceBook.of(
        {r.model: [r[c] for c in PRICE_COLS] for r in rows if r.kind == "model"},
        tiers,
        {r.model: r.write_1h for r in rows if r.kind == "cache"},
        [r.model for r in rows if r.kind == "disable"],
    )


def reprice_usage(usage: DataFrame, book: PriceBook) -> DataFrame:
    """New cost for buckets whose cost was not given by the source."""
    priced = book.with_cost(
        usage, "new_cost", F.col("model"), *[F.col(c) for c in TOKEN_COLS], long_context=False
    )
    kept = F.when(F.col("cost_is_explicit"), F.col("cost_micro"))
    return priced.withColumn("cost_micro", kept.otherwise(F.col("new_cost"))).drop("new_cost")


def reprice_sessions(sessions: DataFrame, usage: DataFrame, book: PriceBook) -> DataFrame:
    """Sessions follow their repriced buckets; those without any are priced themselves."""
    names = sessions.columns
    # Struct, because a NULL sum means "unknown" and a missing row "no buckets".
    sums = usage.groupBy(*SESSION_KEY).agg(
        F.struct(poisoned_cost(F.col("cost_micro")).alias("cost")).alias("buckets")
    )
    joined = book.with_cost(
        sessions.join(sums, SESSION_KEY, "left"),
        "own_cost",
        F.col("model"),
        *[F.col(c) for c in TOKEN_COLS],
        long_context=False,
    )
    followed = F.when(F.col("buckets").isNotNull(), F.col("buckets.cost"))
    return joined.withColumn("cost_micro", followed.otherwise(F.col("own_cost"))).select(*names)

