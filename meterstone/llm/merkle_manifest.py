"""Merkle manifest of a dataset: every row provable against one root.

A row's leaf is a digest of its fields. Per group, leaves stand in order; every
``ARITY`` consecutive nodes hash to their parent until one is left, the group's
subroot, and the subroots form a tree of their own up to the root.

Positions come from one sort by range: a partition knows how many rows stand before
it, so no task counts a whole group. The tree is then built in blocks of ``SPAN``
consecutive nodes, which hold ``LEVELS`` levels in full. In a block, lag and lead
columns at the fixed offsets of a level, masked by the slot in the run and by the
length of the run, supply siblings, and the row of a first child hashes the parent.
The tops of the blocks are the nodes of the next round; paths come back down by block,
so no join has more than ``SPAN`` rows on a key, however large a group is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterstone.llm.common import column, stage

#: Children of a node.
ARITY = 8
#: Levels built in one block.
LEVELS = 4
SPAN = ARITY**LEVELS


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else the byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*map(field, values))


def proof(path: Column) -> Column:
    """The siblings of all levels, one after the other."""
    return F.concat_ws("", F.transform(path, lambda level: F.concat(level["left"], level["right"])))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to beside the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, level: digest(level["left"], node, level["right"]))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(g, ...)`` with ``pos``, from 0 in each ``g`` by ``order``, and ``n``, the rows of ``g``.

    Sorted by range over all groups, so that a large group has many partitions. Only
    a row for every partition and group is summed up.
    """
    keys = [F.col("g"), *(F.col(c).asc_nulls_first() for c in order)]
    placed = stage(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ).withColumn("part", F.shiftright("at", 33))
    upto = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stage(
        placed.groupBy("g", "part")
        .agg(F.count("*").alias("rows"), F.min("at").alias("first"))
        .select(
            "g",
            "part",
            (F.coalesce(F.sum("rows").over(upto), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("rows").over(Window.partitionBy("g")).alias("n"),
        )
    )
    return placed.join(parts, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _above(n: Column, levels: int) -> Column:
    """How many nodes there are ``levels`` levels above ``n`` ones."""
    return F.ceil(n / ARITY**levels).cast("long")


def climb(nodes: DataFrame) -> DataFrame:
    """``nodes(g, pos, n, node, ...)`` with ``block``, ``path`` (siblings of the levels built in
    the block, those that hash at all) and, in the first row of a block, its ``top``."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / SPAN)).withColumn("h0", F.col("node"))
    run = Window.partitionBy("g", "block").orderBy("pos")
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(LEVELS):
        own, stride = F.col(f"h{level}"), ARITY**level
        slot = F.floor(F.col("pos") / stride) % ARITY
        stands = (F.col("pos") % stride == 0) & (_above(F.col("n"), level) > 1)
        # A lag within the run is always there; a lead is missing where the group has ended.
        left = [F.when(slot >= k, F.lag(own, k * stride).over(run)) for k in range(ARITY - 1, 0, -1)]
        right = [F.when(slot + k < ARITY, F.lead(own, k * stride).over(run)) for k in range(1, ARITY)]
        rows = rows.withColumn(
            f"s{level}", F.when(stands, F.struct(F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right")))
        )
        first = F.col("pos") % (stride * ARITY) == 0
        rows = rows.withColumn(
            f"h{level + 1}",
            F.when(first & stands, digest(own, F.col(f"s{level}.right"))).when(first, own),
        )
    # What a first child knows of its level holds for all rows below it.
    below = [F.col("s0"), *(F.last(f"s{k}", ignorenulls=True).over(so_far) for k in range(1, LEVELS))]
    return rows.select(*nodes.columns, "block", F.array_compact(F.array(*below)).alias("path"), F.col(f"h{LEVELS}").alias("top"))


def _alone(tops: DataFrame) -> DataFrame:
    none = F.expr("CAST(array() AS array<struct<left: string, right: string>>)")
    return tops.select("g", F.col("pos").alias("block"), none.alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root"))


def tree(nodes: DataFrame, crown: Callable[[DataFrame], DataFrame] = _alone) -> DataFrame:
    """``nodes(g, pos, n, node, ...)`` with ``path``, ``subroot`` and ``root``.

    ``crown`` takes the one node left of each ``g`` and says what stands above it.
    """
    low = stage(climb(nodes))
    tops = low.where(F.col("pos") % SPAN == 0).select(
        "g", F.col("block").alias("pos"), _above(F.col("n"), LEVELS).alias("n"), F.col("top").alias("node")
    )
    most = low.agg(F.max("n")).first()[0] or 0
    above = tree(tops, crown).withColumnRenamed("pos", "block") if most > SPAN else crown(tops)
    above = above.select("g", "block", F.col("path").alias("over"), "subroot", "root")
    return low.join(above, ["g", "block"]).select(
        *nodes.columns, F.concat("path", "over").alias("path"), "subroot", "root"
    )


def _under_one_root(tops: DataFrame) -> DataFrame:
    """Subroots in the order of their groups are the leaves of the last tree."""
    named = tops.select(F.lit("").alias("g"), F.col("g").alias("of"), "node")
    crowned = tree(positions(named, ["of"]))
    return crowned.select(
        F.col("of").alias("g"), F.lit(0).cast("long").alias("block"), "path", F.col("node").alias("subroot"), "root"
    )


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "lang",
    **more: Column,
) -> DataFrame:
    """Return per row ``id, leaf, subroot, root, path``, and ``more`` columns computed from ``docs``.

    ``path`` holds the ``left`` and ``right`` siblings of every level from the leaf to the
    root: ``fold(leaf, path)`` is the root, and stays so only while the fields do.
    A NULL group is a group of its own, the first one. In a group rows stand by id, NULL
    first; rows of one id by their leaf, so that the root does not depend on how rows are
    dealt out. Equal rows are leaves of their own. A group of one row has its leaf as
    subroot, a dataset of one group its subroot as root. An empty table has no rows.
    """
    group = column(group_col).cast("string")
    leaves = stage(
        docs.select(
            # Sorts as the group does, bytewise, with NULL first, and joins as any text does.
            F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("g"),
            column(id_col).alias("id"),
            leaf_of(*map(column, fields)).alias("node"),
            F.monotonically_increasing_id().alias("row"),
            *(c.alias(name) for name, c in more.items()),
        )
    )
    # The row number only spreads equal rows over partitions.
    placed = positions(leaves, ["id", "node", "row"])
    return tree(placed, _under_one_root).select("id", F.col("node").alias("leaf"), "subroot", "root", "path", *more)


def roots(manifested: DataFrame) -> DataFrame:
    """The ``root`` and how many rows it stands for."""
    return manifested.groupBy("root").agg(F.count("*").alias("rows"))


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    upper = reduce(str.__add__, map(chr, range(ord("A"), ord("Z") + 1)))
    return F.translate(text, upper, upper.lower())
