import os
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from logs import context, event, meta, tokens, total
from meterstone.operators import log_b
from meterstone.schemas import COUNTERS, TOKEN_COLS
from meterstone.sources.logs import read_agent_b
from meterstone.streaming.changes import drain_snapshots, keyed_state, summed_changes
from meterstone.streaming.hourly import (
    drain_updates,
    hourly_usage,
    late_writer,
    run_available,
    with_late,
)
from meterstone.streaming.state import BatchState
from meterstone.streaming.steps import STATE, batch_writer, drain_steps

DAY = date(2026, 4, 20)


def in_batches(spark, frame, folder, step):
    """Write rows as files in sequence and stream them one file per batch."""
    low, high = frame.agg(F.min("seq"), F.max("seq")).first()
    for n, start in enumerate(range(low, high + 1, step)):
        part = frame.filter(F.col("seq").between(start, start + step - 1)).coalesce(1)
        part.write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.endswith(".parquet") and os.path.getmtime(path) > 1_700_001_000:
                os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    return (
        spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", "1").parquet(folder)
    )


def test_snapshot_moves_between_batches(spark, tmp_path):
    def row(seq, msg, hour, model, i, o):
        return ("claude_code", "s", msg, seq, DAY, hour, model, i, o, 0, 0)

    rows = [
        row(1, "m1", 1, "claude-opus-4-7", 100, 1),
        row(2, "m2", 1, "nobody", 7, 7),
        row(3, "m1", 1, "claude-opus-4-7", 100, 5),
        row(4, "m1", 2, "claude-opus-4-7", 250_000, 9),
        row(5, "m2", 1, "gpt-5.4", 7, 7),
        row(6, "m3", 2, "gpt-5.4", 1, 1),
    ]
    frame = spark.createDataFrame(
        rows,
        "agent_type string, session_id string, msg_id string, seq long, usage_date date, "
        "usage_hour int, model string, " + ", ".join(f"{c} long" for c in TOKEN_COLS),
    )
    stream = in_batches(spark, frame, str(tmp_path / "in"), 2)
    changes = drain_snapshots(stream, slots=3)
    got = {
        (r.usage_hour, r.model): (r.input_tokens, r.output_tokens, r.cost_micro)
        for r in summed_changes(changes).collect()
    }
    assert got == {
        (2, "claude-opus-4-7"): (250_000, 9, 250_000 * 5 + 9 * 25),
        (1, "gpt-5.4"): (7, 7, 7 * 2.5 + 7 * 15),
        (2, "gpt-5.4"): (1, 1, 17.5),
    }


def test_steps_equal_batch_whatever_the_batches(spark, tmp_path, write_log):
    root = tmp_path / "logs"
    for name, forked in (("plain", None), ("fork", "parent")):
        entries = [meta(name, forked_from_id=forked)]
        for i in range(1, 30):
            if i == 9 or (forked is None and i == 2):
                entries.append(context("gpt-5.4"))
            if i == 20:
                entries.append(context("gpt-5.5"))
            entries.append(event("user_message" if i % 3 else "agent_message", message="m"))
            entries.append(
                tokens(
                    total(
                        i * 100 if i % 5 else None, i * 30 if i % 4 else None, i * 11, i if i % 2 else None
                    )
                )
            )
        write_log(root / f"rollout-{name}.jsonl", entries)
    parsed = log_b.parse_lines(read_agent_b(spark, str(root)))
    batch = log_b.events_b(log_b.resolve_state(parsed))
    keys = ["file_path", "usage_date", "usage_hour", "model"]
    sums = [*[F.sum(c).alias(c) for c in COUNTERS], F.sum("cost_micro").alias("cost")]
    want = sorted(map(str, batch.groupBy(*keys).agg(*sums).collect()))
    line = F.expr("row_number() over (partition by file_path order by chunk, pos)").cast("long")
    rows = parsed.withColumn("pos", line).withColumns(
        {"seq": F.col("pos"), "chunk": F.floor(F.col("pos") / 10)}
    )
    for step in (7, 100):
        stream = in_batches(spark, rows, str(tmp_path / f"in{step}"), step).drop("seq")
        got = drain_steps(stream).groupBy(*keys).agg(*sums)
        assert sorted(map(str, got.collect())) == want


def test_repeated_batches_and_compaction(spark, tmp_path, write_log):
    entries = [meta("s", forked_from_id="p")]
    for i in range(1, 13):
        if i == 4:
            entries.append(context("gpt-5.4"))
        entries.append(event("user_message", message="m"))
        entries.append(tokens(total(i * 100, i * 10, i)))
    write_log(tmp_path / "logs" / "rollout-s.jsonl", entries)
    parsed = log_b.parse_lines(read_agent_b(spark, str(tmp_path / "logs")))
    line = F.expr("row_number() over (partition by file_path order by chunk, pos)").cast("long")
    rows = parsed.withColumn("pos", line).checkpoint()
    want = log_b.events_b(log_b.resolve_state(rows)).agg(*[F.sum(c) for c in COUNTERS]).first()
    folder = str(tmp_path / "steps")
    write = batch_writer(folder, gather=2)
    for number in range(4):
        if number == 3:
            write(rows.filter(F.floor(F.col("pos") / 7) == 2), 2)
        write(rows.filter(F.floor(F.col("pos") / 7) == number), number)
    # A row whose place has passed changes nothing and is kept apart.
    write(rows.filter("pos = 5"), 4)
    events = spark.read.parquet(f"{folder}/events")
    assert events.agg(*[F.sum(c) for c in COUNTERS]).first() == want
    assert [r.pos for r in spark.read.parquet(f"{folder}/late").collect()] == [5]
    state = BatchState(spark, f"{folder}/state", STATE, ["file_path"], gather=2)
    assert sorted(state._numbers("base")) == [1, 3]
    assert state.before(5).count() == 1 and state.before(0).count() == 0


def test_late_rows_are_kept_apart(spark, tmp_path):
    times = [datetime(2026, 4, 20, 10), datetime(2026, 4, 22, 12), datetime(2026, 4, 21, 9), datetime(2026, 4, 22, 1)]
    frame = spark.createDataFrame(list(enumerate(times)), "seq long, ts timestamp")
    stream = in_batches(spark, frame, str(tmp_path / "in"), 1)
    folder = str(tmp_path / "out")
    run_available(stream, late_writer(folder), "append", folder)
    late = spark.read.parquet(f"{folder}/late").select("seq").collect()
    assert [r.seq for r in late] == [2]


def test_hourly(spark, tmp_path):
    rows = [
        (1, datetime(2026, 4, 20, 10, 5), "codex", "m", 1, 1, 10, 1, 0, 0, None),
        (2, datetime(2026, 4, 20, 11, 5), "codex", "m", 1, 0, 20, 1, 0, 0, None),
        (3, datetime(2026, 4, 20, 10, 59), "codex", "m", 1, 0, 30, 1, 0, 0, None),
    ]
    frame = spark.createDataFrame(
        rows,
        "seq long, ts timestamp, agent_type string, model string, "
        + ", ".join(f"{c} long" for c in COUNTERS)
        + ", cost_micro decimal(38,6)",
    )
    stream = in_batches(spark, frame, str(tmp_path / "in"), 1)
    keys = ["usage_date", "usage_hour", "agent_type", "model"]
    got = drain_updates(hourly_usage(stream), "hourly", keys).orderBy("usage_hour").collect()
    assert [(r.usage_hour, r.input_tokens, r.unknown_cost_count) for r in got] == [
        (10, 40, 2),
        (11, 20, 1),
    ]


SNAPSHOT = (
    "agent_type string, session_id string, msg_id string, seq long, usage_date date, usage_hour int, model string, "
    + ", ".join(f"{c} long" for c in TOKEN_COLS)
)


def add(spark, folder, rows):
    full = [("claude_code", "s", m, seq, DAY, hour, "gpt-5.4", i, 0, 0, 0) for m, seq, hour, i in rows]
    spark.createDataFrame(full, SNAPSHOT).repartition(2).write.mode("append").parquet(folder)
    return spark.readStream.schema(SNAPSHOT).parquet(folder)


def test_snapshots_over_runs(spark, tmp_path):
    """Moved, repeated and overtaken snapshots; a stopped stream goes on where it ended."""
    into, out = str(tmp_path / "in"), str(tmp_path / "out")

    def signed(stream):
        rows = drain_snapshots(stream, out, slots=2).collect()
        return sorted((r.sign, r.usage_hour, r.input_tokens) for r in rows)

    assert signed(add(spark, into, [("a", 1, 1, 10), ("b", 2, 1, 5), ("a", 3, 1, 20)])) == [(1, 1, 5), (1, 1, 20)]
    # a moves to another hour; an older snapshot of b comes late and says nothing.
    moved = signed(add(spark, into, [("a", 4, 2, 30), ("b", 1, 7, 99)]))
    assert moved == [(-1, 1, 20), (1, 1, 5), (1, 1, 20), (1, 2, 30)]
    # A run without new rows adds nothing.
    assert signed(spark.readStream.schema(SNAPSHOT).parquet(into)) == moved


def test_snapshots_end_after_a_time(spark, tmp_path):
    """An entry that has ended is forgotten, so its message counts as a new one."""
    into, out = str(tmp_path / "in"), str(tmp_path / "out")
    drain_snapshots(add(spark, into, [("a", 1, 1, 10)]), out, slots=2, kept_ms=1)
    rows = drain_snapshots(add(spark, into, [("a", 2, 2, 20)]), out, slots=2, kept_ms=1).collect()
    assert sorted((r.sign, r.input_tokens) for r in rows) == [(1, 10), (1, 20)]


def test_settings_of_keyed_state_are_put_back(spark):
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    with keyed_state(spark):
        assert spark.conf.get(name) == "false"
    assert spark.conf.get(name) == before


def test_late_rows_are_added_to_the_hours(spark, tmp_path):
    """Stream and late rows together are what a batch over all rows gives."""
    def rows(times):
        return spark.createDataFrame(
            [(datetime.fromisoformat(t), "claude_code", "m", *[1] * len(COUNTERS), c if c is None else Decimal(c)) for t, c in times],
            "ts timestamp, agent_type string, model string, " + ", ".join(f"{c} long" for c in COUNTERS) + ", cost_micro decimal(38,6)",
        )

    parts = [
        [("2026-04-20 10:00:00", 1), ("2026-04-20 11:00:00", 2)],
        [("2026-04-25 10:00:00", 4)],
        [("2026-04-20 10:30:00", 8), ("2026-04-20 12:00:00", None), ("2026-04-25 09:00:00", 16)],
        [("2026-04-20 10:45:00", 32)],
    ]
    into, out, keys = str(tmp_path / "in"), str(tmp_path / "out"), ["usage_date", "usage_hour", "agent_type", "model"]
    for part in parts:
        rows(part).write.mode("append").parquet(into)
        stream = spark.readStream.schema(rows(part).schema).parquet(into)
        run_available(stream, late_writer(out), "append", f"{out}/late_query")
        hours = drain_updates(hourly_usage(stream), "hourly", keys, f"{out}/hourly")
    late = spark.read.parquet(f"{out}/late")
    assert late.count() == 3
    got = {(r.usage_date.day, r.usage_hour): (r.message_count, r.cost_micro, r.unknown_cost_count) for r in with_late(hours, late).collect()}
    assert got == {(20, 10): (3, 41, 0), (20, 11): (1, 2, 0), (20, 12): (1, 0, 1), (25, 9): (1, 16, 0), (25, 10): (1, 4, 0)}
