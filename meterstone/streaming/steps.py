"""Cumulative counters as a stream (L3).

Every micro-batch goes through the batch operators. What earlier batches left
behind is put in front of a session's new rows as a few seed rows, so a busy
session is cut into chunks here as well and no task holds a session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterstone.functions.pricebook import BUILTIN, PriceBook
from meterstone.operators.log_b import COUNTERS, carried_state, chunk_ends, events_b, resolve_state
from meterstone.session import cut_lineage, new_folder
from meterstone.streaming.hourly import run_available
from meterstone.streaming.state import BatchState

SEED_CHUNK = -1
#: What steps are made of; prompts, folders and branches of a parsed line are not.
READ = [
    *["file_path", "chunk", "pos", "kind", "ts_text", "usage_date", "usage_hour"],
    *["meta_id", "meta_forked", "ctx_model", *COUNTERS, "request"],
]
PLACE = ["file_path", "chunk", "pos"]

STATE = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("meta_id", T.StringType()),
        T.StructField("meta_forked", T.BooleanType()),
        T.StructField("opened", T.BooleanType()),
        T.StructField("ctx_model", T.StringType()),
        *[T.StructField(c, T.LongType()) for c in COUNTERS],
        *[T.StructField(f"base_{c}", T.LongType()) for c in COUNTERS],
        T.StructField("last_chunk", T.LongType()),
        T.StructField("last_pos", T.LongType()),
    ]
)


def seed_rows(state: DataFrame, schema: T.StructType) -> DataFrame:
    """State as log rows that bring a session back to where it was.

    In this order: who it is, what it had counted when its context came, the
    context with the newest model, the newest readings.
    """

    def row(pos: int, kind: str, **values: Column) -> Column:
        fixed = {
            "file_path": F.col("file_path"),
            "chunk": F.lit(SEED_CHUNK),
            "pos": F.lit(pos),
            "kind": F.lit(kind),
            "ts_text": F.lit(""),
        }
        given = {**fixed, **values}
        return F.struct(
            *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        )

    opened = F.col("opened")
    rows = F.array(
        F.when(
            F.col("meta_forked").isNotNull(),
            row(0, "meta", meta_id=F.col("meta_id"), meta_forked=F.col("meta_forked")),
        ),
        F.when(opened, row(1, "tokens", **{c: F.col(f"base_{c}") for c in COUNTERS})),
        F.when(opened, row(2, "context", ctx_model=F.col("ctx_model"))),
        row(3, "tokens", **{c: F.col(c) for c in COUNTERS}),
    )
    return state.select(F.inline(F.array_compact(rows)))


def state_after(ends: DataFrame, carried: DataFrame) -> DataFrame:
    """What sessions leave behind, from the ``chunk_ends`` of their rows, seeds included, and the state carried."""
    last = F.struct("chunk", "end_pos")

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), last))

    def newest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), last))

    left = ends.groupBy("file_path").agg(
        first("id_here").alias("meta_id"),
        F.coalesce(first("id_forked_here"), newest("any_forked_here")).alias("meta_forked"),
        F.max("has_context").alias("opened"),
        newest("model_here").alias("ctx_model"),
        *[newest(f"{c}_here").alias(c) for c in COUNTERS],
        F.max(last).alias("at"),
    )
    base = carried.groupBy("file_path").agg(*[F.max(f"base.{c}").alias(f"base_{c}") for c in COUNTERS])
    return left.join(base, "file_path", "left").select(
        "*", F.col("at.chunk").alias("last_chunk"), F.col("at.end_pos").alias("last_pos")
    ).drop("at")


def steps_of_batch(
    rows: DataFrame, state: DataFrame, book: PriceBook = BUILTIN
) -> tuple[DataFrame, DataFrame]:
    """Events of new rows after a state, and the state of the sessions they belong to.

    ``rows`` are read several times; ``state`` has the sessions of the rows only.
    """
    seeded = rows.unionByName(seed_rows(state, rows.schema))
    ends = cut_lineage(chunk_ends(seeded))
    carried = carried_state(ends)
    resolved = resolve_state(seeded, carried)
    return events_b(resolved.filter(F.col("chunk") > SEED_CHUNK), book), state_after(ends, carried)


def out_of_sequence(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows at or before a place that an earlier batch has passed already."""
    passed = state.select("file_path", F.struct("last_chunk", "last_pos").alias("passed"))
    late = F.struct("chunk", "pos") <= F.col("passed")
    return rows.join(passed, "file_path", "left").filter(late).drop("passed")


def batch_writer(
    folder: str, book: PriceBook = BUILTIN, **options
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that keeps events and state below ``folder``.

    Both are written under the batch number and a batch reads the state of the
    batches before it only, so a repeated batch replaces itself. Rows that come
    after their place has passed would give wrong steps: they are left out and kept
    below ``<folder>/late``, for the history sync to read their logs again; only if
    there are any is the batch read a second time.
    ``options`` go to the state table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = BatchState(spark, f"{folder}/state", STATE, ["file_path"], **options)
        rows = cut_lineage(batch.select(*READ))
        touched = cut_lineage(rows.select("file_path").distinct())
        state = cut_lineage(table.before(number, touched).join(touched, "file_path", "left_semi"))
        late = cut_lineage(out_of_sequence(rows.select(*PLACE), state))
        whole = spark.createDataFrame([], batch.schema)
        if not late.isEmpty():
            whole = batch.join(late, PLACE, "left_semi")
            rows = rows.join(late, PLACE, "left_anti").select(*rows.columns)
            # Sessions of which all rows are late stay as they were.
            state = state.join(rows.select("file_path").distinct(), "file_path", "left_semi")
        whole.write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        events, after = steps_of_batch(rows, state, book)
        events.write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
        table.put(number, after)

    return write


def drain_steps(
    parsed: DataFrame, book: PriceBook = BUILTIN, folder: str | None = None, **options
) -> DataFrame:
    """L3: run a stream of parsed agent-B rows over everything available; its events so far.

    With the ``folder`` of an earlier run the stream goes on where that one ended.

    ``parsed`` has the columns of ``log_b.parse_lines``; ``(chunk, pos)`` goes up
    within a session from batch to batch.
    """
    spark = parsed.sparkSession
    folder = folder or new_folder(spark, "steps")
    run_available(parsed, batch_writer(folder, book, **options), "append", folder)
    return spark.read.parquet(f"{folder}/events").drop("batch")
