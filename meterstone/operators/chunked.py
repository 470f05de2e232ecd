"""Running state over ordered logs that no single task has to hold.

A log may be far larger than a task can sort: one session may own a third of all
rows. Every log is therefore cut into chunks of bounded size (file splits, or
ranges of the order key). Windows run inside a chunk; one small row per chunk
says what the chunk leaves behind; a window over those rows gives each chunk the
state it starts with. The result equals one window over the whole log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: str,
    *,
    last: Sequence[str] = (),
    total: Sequence[str] = (),
    peak: Sequence[str] = (),
    prev: bool = False,
) -> DataFrame:
    """Add running columns over ``keys`` ordered by ``(chunk, order)``.

    ``last``  -> ``<c>_run``: newest value so far that is not NULL (forward fill)
    ``total`` -> ``<c>_run``: running sum
    ``peak``  -> ``<c>_run``: running maximum
    With ``prev`` every ``last`` column also gets ``<c>_prev``, the same state
    just before the row.
    """
    keys = list(keys)
    here = W.partitionBy(*keys, chunk).orderBy(order)
    upto = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = here.rowsBetween(W.unboundedPreceding, -1)

    local: dict[str, Column] = {}
    for c in last:
        local[f"{c}_run"] = F.last(c, ignorenulls=True).over(upto)
        if prev:
            local[f"{c}_prev"] = F.last(c, ignorenulls=True).over(before)
    for c in total:
        local[f"{c}_run"] = F.sum(c).over(upto)
    for c in peak:
        local[f"{c}_run"] = F.max(c).over(upto)

    leaves = [
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"{c}_carry")
            for c in last
        ],
        *[F.sum(c).alias(f"{c}_carry") for c in total],
        *[F.max(c).alias(f"{c}_carry") for c in peak],
    ]
    earlier = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    carry = (
        df.groupBy(*keys, chunk)
        .agg(*leaves)
        .select(
            *keys,
            chunk,
            *[F.last(f"{c}_carry", ignorenulls=True).over(earlier).alias(f"{c}_carry") for c in last],
            *[F.sum(f"{c}_carry").over(earlier).alias(f"{c}_carry") for c in total],
            *[F.max(f"{c}_carry").over(earlier).alias(f"{c}_carry") for c in peak],
        )
    )

    out = df.withColumns(local).join(carry, [*keys, chunk], "left")
    joined: dict[str, Column] = {}
    for c in last:
        joined[f"{c}_run"] = F.coalesce(f"{c}_run", f"{c}_carry")
        if prev:
            joined[f"{c}_prev"] = F.coalesce(f"{c}_prev", f"{c}_carry")
    for c in total:
        joined[f"{c}_run"] = F.coalesce(F.col(f"{c}_run"), F.lit(0)) + F.coalesce(
            F.col(f"{c}_carry"), F.lit(0)
        )
    for c in peak:
        joined[f"{c}_run"] = F.greatest(f"{c}_run", f"{c}_carry")
    dropped = [f"{c}_carry" for c in (*last, *total, *peak)]
    return out.withColumns(joined).drop(*dropped)


def chunk_of(order: Column, rows: int = 1 << 20) -> Column:
    """Chunk number for a unique, whole-numbered order key: at most ``rows`` rows each."""
    return F.floor(order / F.lit(rows)).cast("bigint")
