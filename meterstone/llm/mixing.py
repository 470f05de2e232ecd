"""Mixing sources to target weights: hash thresholds found in nested histograms.

Every row gets a hash of its id and text. Words are summed by source and by the
first bits of the hash; a running sum over these few buckets finds the one in
which the budget of a source ends. Only the rows of that bucket are summed again
by the next bits, and so on. The rows below the threshold found are taken by a
filter: nothing is sorted, and no row is compared with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterstone.llm.common import WORD, boxed, column, stage, unboxed

#: Bits of the hash that one level of the histogram looks at, and the levels.
BITS, LEVELS = 10, 4

#: Up to so many sources the table of one row per source is broadcast; beyond, Spark
#: joins it like any other and splits hot sources.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``, one row per source.

    Sources by code point, NULL last, weigh ``weights`` in turn. They share
    ``share`` times all words; no target exceeds ``cap`` times the source's words,
    and what a source cannot take the others share by weight. The level at which
    nobody is above is found with running sums over the sources in the order in
    which they fill up. One row per source is all that meets here.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    filled = Window.orderBy("fills", "weight", "turn")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weighed = (
        sizes.withColumn("turn", turn)
        .withColumn("weight", F.array(*map(F.lit, weights))[F.col("turn") % len(weights)])
        .withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("fills", F.col("most") / F.col("weight"))
    )
    budget = F.sum("source_size").over(everything) * F.lit(share)
    # The level, were this source the first one that does not fill up.
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level)
    reached = F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "level"))).over(everything)
    return levels.withColumn("reached", reached["level"]).select(
        "source",
        "source_size",
        F.coalesce(F.least("most", F.col("weight") * F.col("reached")), "most").alias("target"),
    )


def checked(per_source: DataFrame, sources: int) -> DataFrame:
    return F.broadcast(per_source) if sources <= BROADCAST_SOURCES else per_source


def thresholds(rows: DataFrame, targets: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """Per source the whole ``copies`` and the exclusive ``bound`` of the hash below
    which a row gets one more.

    ``rows(source, size, mark)``; ``mark`` is a hash of ``bits * levels`` bits. At
    the last level the bucket in which the budget ends is taken whole if that comes
    nearer to the target than leaving it.
    """
    sources = targets.count()
    state = targets.where("source_size > 0").select(
        "source",
        F.floor(F.col("target") / F.col("source_size")).alias("copies"),
        (F.col("target") % F.col("source_size")).alias("left"),
        F.lit(0).cast("long").alias("prefix"),
    )
    for level in range(1, levels + 1):
        shift = bits * (levels - level)
        inside = rows.join(
            checked(state.select(F.col("source").alias("s"), "prefix"), sources),
            F.col("source").eqNullSafe(F.col("s"))
            & (F.shiftright("mark", shift + bits) == F.col("prefix")),
        )
        sums = inside.groupBy("source", F.shiftright("mark", shift).alias("bucket")).agg(
            F.sum("size").alias("words")
        )
        upto = Window.partitionBy("source").orderBy("bucket")
        runs = sums.withColumn("end", F.sum("words").over(upto)).withColumn(
            "start", F.col("end") - F.col("words")
        )
        ends = runs.select(F.col("source").alias("s"), "bucket", "start", "end")
        found = state.join(
            ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("left") < F.col("end")), "left"
        )
        first = F.min(F.struct("bucket", "start", "end"))
        state = stage(
            found.groupBy("source", "copies", "left", "prefix")
            .agg(first.alias("cut"))
            .select(
                "source",
                "copies",
                F.greatest(F.col("left") - F.coalesce("cut.start", F.lit(0)), F.lit(0.0)).alias("left"),
                # Without such a bucket rounding left a rest: all of this prefix is taken.
                F.coalesce(
                    "cut.bucket", F.shiftleft(F.col("prefix") + 1, bits) - 1
                ).alias("prefix"),
                (F.coalesce("cut.end", F.lit(0)) - F.coalesce("cut.start", F.lit(0))).alias("width"),
                F.col("cut").isNull().alias("all"),
            )
        )
        last = state
        state = state.select("source", "copies", "left", "prefix")
    near = F.col("all") | (F.col("left") * 2 > F.col("width"))
    return last.select(
        F.col("source").alias("s"), "copies", (F.col("prefix") + near.cast("long")).alias("bound")
    )


def _marks(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[Column, Column, Column]:
    """Source, words and hash of a row."""
    mark = F.shiftrightunsigned(F.xxhash64(column(id_col), column(text_col)), 64 - BITS * LEVELS)
    return column(source_col).alias("source"), word_count(column(text_col)).alias("size"), mark.alias("mark")


def _per_source(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row per source, with what decides on its rows."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes, weights, share, cap))
    bounds = thresholds(rows, targets)
    table = targets.join(bounds, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        F.coalesce("copies", F.lit(0)).alias("whole"),
        F.coalesce("bound", F.lit(0)).alias("bound"),
    )
    return checked(table, targets.count())


def _with_copies(rows: DataFrame, table: DataFrame) -> DataFrame:
    copies = (F.col("whole") + (F.col("mark") < F.col("bound")).cast("long")).cast("long")
    return (
        rows.join(table, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("copies", copies)
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


ADDED = ("size", "source_size", "target", "copies", "taken")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Return ``doc_id, size, source_size, target, copies, taken`` for every row.

    ``copies`` says how often the mix takes the row, ``taken`` how many words that
    is; with a ``cap`` of 2 no row is taken more than twice. NULL and empty texts
    have size 0. NULL sources are one source, the last. Rows of equal id and text
    share a hash and are taken together; rows without an id differ by text. An
    empty table gives an empty result. The hash depends on nothing else, so reruns
    agree.
    """
    rows = stage(docs.select(column(id_col).alias("doc_id"), *_marks(docs, id_col, text_col, source_col)))
    return _with_copies(rows, _per_source(rows, weights, share, cap)).select("doc_id", *ADDED)


def take(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with the figures of ``mix`` as columns
    after their own; of own columns with those names the figures take the place."""
    marks = _marks(docs, id_col, text_col, source_col)
    table = _per_source(stage(docs.select(*marks)), weights, share, cap)
    own = [c for c, name in zip(unboxed(docs), docs.columns, strict=True) if name.lower() not in ADDED]
    return _with_copies(docs.select(boxed(docs), *marks), table).where("copies > 0").select(*own, *ADDED)
