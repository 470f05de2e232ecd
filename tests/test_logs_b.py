import re

from pyspark.sql import functions as F

from logs import context, event, meta, tokens, total
from meterstone.operators import log_b
from meterstone.operators.cube import as_of_day, chosen_files, hourly, session_rows, usage_buckets
from meterstone.sources.logs import read_agent_b


def run(spark, root):
    parsed = log_b.parse_lines(read_agent_b(spark, str(root)))
    resolved = log_b.resolve_state(parsed)
    hours = hourly(log_b.events_b(resolved))
    chosen = chosen_files(log_b.files_b(resolved))
    sessions = {r.session_id: r for r in session_rows(hours, chosen).collect()}
    return sessions, usage_buckets(hours, chosen)


def log(root, name="rollout-1.jsonl"):
    return root / "2026" / "04" / "20" / name


def test_negative_delta(spark, tmp_path, write_log):
    write_log(
        log(tmp_path),
        [
            meta(cwd="/w", git={"branch": "dev"}),
            context("gpt-5.4"),
            event("user_message", message="  hi "),
            tokens(total(1000, 100)),
            tokens(total(cached=200)),
        ],
    )
    sessions, buckets = run(spark, tmp_path)
    s = sessions["s1"]
    assert (s.input_tokens, s.cache_read_tokens) == (800, 200)
    assert (s.project_path, s.git_branch, s.model, s.first_prompt) == ("/w", "dev", "gpt-5.4", "hi")
    assert s.cost_micro == 800 * 2.5 + 200 * 0.25
    assert buckets.agg(F.sum("input_tokens")).first()[0] == 800


def test_request_rate_needs_a_described_request(spark, tmp_path, write_log):
    big = total(300_000, 0, 0)
    head = [meta(), context("gpt-5.4"), event("user_message", message="q")]
    write_log(log(tmp_path, "rollout-a.jsonl"), [*head, tokens(big, last=big)])
    other = [meta("s2"), *head[1:]]
    write_log(log(tmp_path, "rollout-b.jsonl"), [*other, tokens(big)])
    write_log(log(tmp_path, "rollout-c.jsonl"), [meta("s3"), *head[1:], tokens(big, last={"x": 1})])
    sessions, _ = run(spark, tmp_path)
    assert sessions["s1"].cost_micro == 300_000 * 5
    assert sessions["s2"].cost_micro == 300_000 * 2.5
    assert sessions["s3"].cost_micro == 300_000 * 2.5


def test_unpriced_family(spark, tmp_path, write_log):
    write_log(
        log(tmp_path),
        [context("gpt-5.4-pro"), event("user_message", message="q"), tokens(total(10, 0, 5))],
    )
    sessions, _ = run(spark, tmp_path)
    assert sessions["rollout-1"].cost_micro is None


def fork_entries():
    return [
        meta("child", forked_from_id="parent"),
        meta("parent"),
        event("user_message", message="parent task"),
        tokens(total(1000, 800, 100)),
        context("gpt-5.4"),
        event("user_message", message="child task"),
        event("agent_message"),
        tokens(total(1300, 900, 120)),
    ]


def test_fork(spark, tmp_path, write_log):
    write_log(log(tmp_path), fork_entries())
    s = run(spark, tmp_path)[0]["child"]
    assert (s.user_turns, s.message_count) == (1, 2)
    assert (s.input_tokens, s.cache_read_tokens, s.output_tokens) == (200, 100, 20)
    assert s.first_prompt == "child task"


def test_fork_by_source_and_unforked(spark, tmp_path, write_log):
    body = fork_entries()[2:]
    write_log(log(tmp_path, "rollout-a.jsonl"), [meta("a", source={"subagent": {"x": 1}}), *body])
    write_log(log(tmp_path, "rollout-b.jsonl"), [meta("b", source="cli"), *body])
    sessions, _ = run(spark, tmp_path)
    assert sessions["a"].output_tokens == 20 and sessions["a"].user_turns == 1
    assert sessions["b"].output_tokens == 120 and sessions["b"].user_turns == 2


def test_cross_day(spark, tmp_path, write_log):
    write_log(
        log(tmp_path),
        [
            meta(),
            context("gpt-5.4"),
            event("user_message", ts="2026-04-20T10:00:00Z", message="a"),
            tokens(total(1000, 200, 100), ts="2026-04-20T10:00:01Z"),
            event("user_message", ts="2026-04-21T09:00:00Z", message="b"),
            tokens(total(1500, 300, 150), ts="2026-04-21T09:00:01Z"),
        ],
    )
    sessions, buckets = run(spark, tmp_path)
    s = sessions["s1"]
    assert (s.input_tokens, s.cache_read_tokens, s.output_tokens) == (1200, 300, 150)
    from datetime import date

    day = as_of_day(buckets, date(2026, 4, 21)).first()
    assert (day.today_input_tokens, day.today_cache_read_tokens) == (400, 100)
    assert (day.today_output_tokens, day.today_user_turns) == (50, 1)


def test_model_switch(spark, tmp_path, write_log):
    write_log(
        log(tmp_path),
        [
            meta(),
            context("gpt-5.4"),
            event("user_message", message="a"),
            tokens(total(1000, 0, 100)),
            context("gpt-5.5"),
            tokens(total(2000, 0, 200), ts="2026-04-20T11:00:00Z"),
        ],
    )
    s = run(spark, tmp_path)[0]["s1"]
    assert s.cost_micro == 12_000
    assert s.model == "gpt-5.5"


def test_message_that_is_not_text(spark, tmp_path, write_log):
    write_log(
        log(tmp_path),
        [
            event("user_message", message=["a"]),
            event("user_message", message={"b": 1}),
            event("user_message", message='["quoted"]'),
            event("user_message", message="{brace"),
        ],
    )
    s = run(spark, tmp_path)[0]["rollout-1"]
    assert (s.user_turns, s.first_prompt, s.last_prompt) == (4, '["quoted"]', "{brace")


def test_newest_of_two_files_wins(spark, tmp_path, write_log):
    import os

    head = [meta("same"), context("gpt-5.4"), event("user_message", message="q")]
    old = write_log(log(tmp_path, "rollout-z.jsonl"), [*head, tokens(total(10, 0, 1))])
    new = write_log(log(tmp_path, "rollout-a.jsonl"), [*head, tokens(total(20, 0, 2))])
    os.utime(old, (1_700_000_000, 1_700_000_000))
    os.utime(new, (1_700_000_100, 1_700_000_100))
    sessions, buckets = run(spark, tmp_path)
    assert sessions["same"].input_tokens == 20
    assert buckets.agg(F.sum("input_tokens")).first()[0] == 20


def test_splits_give_the_same_result(spark, tmp_path, write_log):
    """State carried over many splits equals state over the whole log, forks included."""
    entries = [meta("big", forked_from_id="p")]
    for i in range(1, 300):
        if i == 80:
            entries.append(context("gpt-5.4"))
        if i in (150, 200):
            entries.append(context("gpt-5.5"))
        entries.append(event("user_message", message=f"task {i}"))
        entries.append(
            tokens(
                total(
                    i * 100 if i % 5 else None,
                    i * 30 if i % 7 else None,
                    i * 11,
                    i if i % 3 else None,
                ),
                ts=f"2026-04-20T{i // 20:02d}:00:00Z",
            )
        )
    write_log(log(tmp_path), entries)
    whole = run(spark, tmp_path)
    whole = whole[0], sorted(map(tuple, whole[1].collect()))
    assert whole[0]["big"].first_prompt == "task 80"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert read_agent_b(spark, str(tmp_path)).select("chunk").distinct().count() > 5
        split = run(spark, tmp_path)
        split = split[0], sorted(map(tuple, split[1].collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert whole == split


def test_only_chunk_summaries_meet_per_file(spark):
    """Rows are shuffled by file and chunk; what is shuffled by file alone is already summed."""
    parsed = spark.createDataFrame([], log_b.parse_lines(read_agent_b(spark, "/nowhere")).schema)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = log_b.resolve_state(parsed)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = plan.splitlines()
    alone = [n for n, text in enumerate(lines) if re.search(r"hashpartitioning\(file_path#\d+, \d", text)]
    assert len(alone) == 1
    assert "SortAggregate" in lines[alone[0] + 1]
