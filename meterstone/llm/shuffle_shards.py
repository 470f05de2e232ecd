"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

In a uniform shuffle, how many rows of an input part go to each shard follows the
multivariate hypergeometric law. The matrix of these counts is drawn first, from the
sizes alone: parts are halved again and again, and each half gets its share of the
rows of every shard. Then rows are permuted within their part, dealt out by the
counts, exchanged, and permuted again where they arrive. Shards are cut into runs of
bounded size, whose sizes are exact too, so a place in a shard needs no counting.

Columns and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterstone.llm.common import boxed, free_name, stage, unboxed

#: A part has at most 2 to this power rows of one input partition.
PART_BITS = 20
#: A shard is cut into runs of about so many rows, each permuted in one task.
RUN_ROWS = 1 << 22
#: Standard deviations from the mode within which counts are drawn; what lies beyond has a
#: chance below that of a 53-bit draw.
REACH = 9


def uniform(*of: Column) -> Column:
    """A number from 0 to 1, 1 excluded, out of 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") * F.lit(2.0**-53)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` rows out of ``total`` are among ``good`` ones, at the quantile ``u``.

    Probabilities are built from the ratios of neighbours, from below the mode to above
    it; they are summed, and walked again up to ``u`` of the sum.
    """
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - good))
    high = F.least(good, drawn)
    share = good / total
    spread = F.sqrt(drawn * share * (1 - share) * (total - drawn) / F.greatest(total - 1, F.lit(1)))
    mode = F.floor((drawn + 1.0) * (good + 1.0) / (total + 2.0))
    reach = F.ceil(spread * REACH) + 12
    first, last = F.greatest(low, mode - reach), F.least(high, mode + reach)

    def ratio(x: Column) -> Column:
        y = x.cast("double")
        return (good - y) * (drawn - y) / ((y + 1) * (total - good - drawn + y + 1))

    steps = F.sequence(first, last - 1)
    one = F.lit(1.0)
    summed = F.aggregate(
        steps,
        F.struct(one.alias("f"), one.alias("sum")),
        lambda s, x: F.struct((s["f"] * ratio(x)).alias("f"), (s["sum"] + s["f"] * ratio(x)).alias("sum")),
        lambda s: s["sum"],
    )
    walked = F.aggregate(
        steps,
        F.struct(one.alias("f"), one.alias("sum"), summed.alias("all"), F.lit(0).cast("long").alias("passed")),
        lambda s, x: F.struct(
            (s["f"] * ratio(x)).alias("f"),
            (s["sum"] + s["f"] * ratio(x)).alias("sum"),
            s["all"].alias("all"),
            (s["passed"] + (s["sum"] <= u * s["all"]).cast("long")).alias("passed"),
        ),
        lambda s: s["passed"],
    )
    return F.when(first >= last, F.greatest(first, low)).otherwise(first + walked)


def shares(counts: Column, total: Column, drawn: Column, seed: Column) -> Column:
    """How many of ``drawn`` rows fall to each column of ``counts``, whose sum is ``total``."""
    start = F.struct(
        total.cast("long").alias("total"),
        drawn.cast("long").alias("drawn"),
        F.expr("CAST(array() AS array<bigint>)").alias("out"),
    )

    def step(s: Column, good: Column) -> Column:
        u = uniform(seed, F.size(s["out"]))
        x = F.when(good > 0, hypergeometric(s["total"], good, s["drawn"], u)).otherwise(F.lit(0).cast("long"))
        # Bound once: the draw is long, and three fields need it.
        return F.transform(
            F.array(x),
            lambda n: F.struct(
                (s["total"] - good).alias("total"), (s["drawn"] - n).alias("drawn"), F.array_append(s["out"], n).alias("out")
            ),
        )[0]

    return F.aggregate(counts, start, step, lambda s: s["out"])


def matrix(parts: DataFrame, sizes: DataFrame, n_parts: int, seed: int) -> DataFrame:
    """``part, counts``: rows of each part that go to each column.

    ``parts(part, no, rows)`` are numbered from 0; ``sizes`` is one row of ``counts``, what
    the columns hold in all, in order. Level by level, the rows of a range of parts are
    drawn from those of its parent.
    """
    depth = max(n_parts - 1, 0).bit_length()
    # Staged, so that the first joins are on a column and not on a constant.
    state = stage(sizes.select(F.lit(0).cast("long").alias("node"), "counts"))
    spark = parts.sparkSession
    for level in range(1, depth + 1):
        half = F.shiftright("no", depth - level)
        rows = parts.groupBy(F.shiftright(half, 1).alias("node")).agg(
            F.sum("rows").alias("total"),
            F.coalesce(F.sum(F.when(half % 2 == 0, F.col("rows"))), F.lit(0)).alias("drawn"),
        )
        seeded = F.xxhash64(F.lit(seed), F.lit(level), F.col("node"))
        drawn = (
            state.join(rows, "node")
            .repartition(min(1 << (level - 1), 2 * spark.sparkContext.defaultParallelism), "node")
            .withColumn("left", shares(F.col("counts"), F.col("total"), F.col("drawn"), seeded))
        )
        rest = F.zip_with("counts", "left", lambda a, b: a - b)
        state = stage(
            drawn.select(F.posexplode(F.array(F.col("left"), rest)).alias("side", "counts"), "node")
            .select((F.col("node") * 2 + F.col("side")).alias("node"), "counts")
        )
    return parts.join(state, parts["no"] == state["node"]).select("part", "counts")


def _upto(counts: Column) -> Column:
    """Running sums of an array."""
    none = F.expr("CAST(array() AS array<bigint>)")
    return F.aggregate(
        counts,
        none,
        lambda sums, n: F.array_append(sums, F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0).cast("long")) + n),
    )


def _passed(upto: Column, place: Column, columns: int) -> Column:
    """How many of the running sums are at most ``place``, by halving steps."""
    steps = [1 << k for k in reversed(range(columns.bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= columns) & (F.try_element_at(upto, at + step) <= place), at + step
        ).otherwise(at),
    )


def even_sizes(of: Column, pieces: Column, k: Column) -> Column:
    """The size of piece ``k`` of ``of`` rows cut into ``pieces``, at most one apart."""
    return F.floor(of / pieces) + (k < of % pieces).cast("long")


def even_start(of: Column, pieces: Column, k: Column) -> Column:
    """The rows before piece ``k``."""
    return k * F.floor(of / pieces) + F.least(k, of % pieces)


def shuffle_shards(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (its place there, from 0).

    Every order of all rows is as likely as any other, up to the hash that stands for
    chance; shard sizes differ by one at most, the first ones being the larger. No
    column decides anything: NULLs, empty and long texts, equal rows and shared ids are
    rows like any other, and equal texts part as chance has it. Given names that are taken get an
    underscore more. The same files, read in the same splits, and the same ``seed`` give
    the same result. An empty table stays empty; with fewer rows than shards, the last
    shards stay empty.
    """
    spark = docs.sparkSession
    rows = stage(docs.select(boxed(docs), F.monotonically_increasing_id().alias("at")))
    rows = rows.withColumn("part", F.shiftright("at", PART_BITS))
    # One row for every part.
    parts = stage(
        rows.groupBy("part")
        .agg(F.count("*").alias("rows"))
        .withColumn("no", F.row_number().over(Window.orderBy("part")).cast("long") - 1)
    )
    n, n_parts = parts.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    runs = max(1, -(-n // (shards * RUN_ROWS)))
    columns = shards * runs

    def at(k: Column) -> tuple[Column, Column, Column]:
        shard, run = F.floor(k / runs), k % runs
        return shard, run, even_sizes(F.lit(n), F.lit(shards), shard)

    def size(k: Column) -> Column:
        _, run, of = at(k)
        return even_sizes(of, F.lit(runs), run)

    sizes = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), size).alias("counts"))
    dealt = matrix(parts, sizes, n_parts, seed).withColumn("upto", _upto(F.col("counts"))).drop("counts")
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "at"), "at")
    sent = (
        rows.withColumn("place", F.row_number().over(local) - 1)
        .join(stage(dealt), "part")
        .select("doc", "at", _passed(F.col("upto"), F.col("place"), columns).alias("run"))
    )
    arrived = Window.partitionBy("run").orderBy(F.xxhash64(F.lit(seed), F.lit("arrived"), "at"), "at")
    shard, run, of = at(F.col("run"))
    slot = even_start(of, F.lit(runs), run) + F.row_number().over(arrived) - 1
    to_shard = free_name(docs, "shard")
    return sent.select(
        *unboxed(docs), shard.cast("int").alias(to_shard), slot.cast("long").alias(free_name(docs, "slot"))
    )
