import json
from datetime import date, datetime

import pytest

from logs import reply, usage, user
from meterstone.operators import log_a
from meterstone.operators.cube import chosen_files, hourly, session_rows, usage_buckets
from meterstone.sources.logs import read_agent_a, read_session_index, index_sessions

DAY = date(2026, 4, 20)


def frame(spark, values):
    rows = [("/logs/proj/s.jsonl", datetime(2026, 4, 20), 0, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "file_path string, modified timestamp, chunk long, pos long, value string")


def run(spark, root):
    parsed = log_a.parse_lines(read_agent_a(spark, str(root)))
    hours = hourly(log_a.events_a(parsed, DAY))
    chosen = chosen_files(log_a.files_a(parsed, str(root)))
    sessions = {r.session_id: r for r in session_rows(hours, chosen).collect()}
    return sessions, usage_buckets(hours, chosen).orderBy("usage_date", "usage_hour").collect()


def test_last_snapshot_counts_once(spark, tmp_path, write_log):
    write_log(
        tmp_path / "proj" / "s.jsonl",
        [
            user("hello", gitBranch="main", cwd="/work"),
            reply("m1", usage(10, 1, 100, 5)),
            reply("m1", usage(10, 20, 100, 5)),
            reply("m1", {}),
        ],
    )
    sessions, buckets = run(spark, tmp_path)
    s = sessions["s"]
    assert (s.message_count, s.user_turns) == (2, 1)
    assert (s.input_tokens, s.output_tokens, s.cache_read_tokens) == (10, 20, 100)
    assert s.cost_micro == 10 * 5 + 20 * 25 + 50 + 5 * 6.25
    assert (s.project_path, s.git_branch, s.model) == ("/work", "main", "claude-opus-4-7")
    assert {b.model for b in buckets} == {"", "claude-opus-4-7"}


def test_model_prompts_and_hygiene(spark, tmp_path, write_log):
    write_log(
        tmp_path / "proj" / "s.jsonl",
        [
            "",
            "{broken",
            user([{"type": "tool_result", "content": "x"}]),
            user(["text", {"type": "text"}]),
            user('[{"type": "tool_result"}]'),
            user({"a": 1}),
            user("<b>Caveat: a</b>\n\nlogin now\n ok\n  do this  \nrest"),
            reply("m1", usage(1, 1), model="<synthetic>"),
            user("  " + "y" * 100 + "　"),
            reply("m2", usage(0, 1), ts="2026-04-20T11:00:00Z"),
            reply("", usage(0, 1), ts="2026-04-20T11:00:00Z"),
            reply("", usage(0, 1), ts="garbage"),
            {"type": "summary", "timestamp": "2026-04-21T00:00:00+08:00"},
        ],
        end="",
    )
    sessions, buckets = run(spark, tmp_path)
    s = sessions["s"]
    assert s.user_turns == 5
    assert s.message_count == 9
    assert s.first_prompt == '[{"type": "tool_result"}]'
    assert s.last_prompt == "y" * 80
    assert s.model == "claude-opus-4-7"
    assert s.ended_at == "2026-04-21T00:00:00+08:00"
    assert s.project_path == f"{tmp_path}/proj"
    by_model = {(b.usage_hour, b.model): b.user_turns for b in buckets}
    assert by_model[(10, "")] == 4
    assert by_model[(10, "<synthetic>")] == 1
    assert (0, "claude-opus-4-7") in by_model


def test_truncated_tail_is_picked_up_later(spark, tmp_path, write_log):
    path = tmp_path / "proj" / "s.jsonl"
    whole = reply("m1", usage(0, 20))
    import json

    text = json.dumps(whole)
    write_log(path, [user("q"), text[:40]], end="")
    assert run(spark, tmp_path)[0]["s"].output_tokens == 0
    write_log(path, [user("q"), text])
    assert run(spark, tmp_path)[0]["s"].output_tokens == 20


def test_ids_and_files(spark, tmp_path, write_log):
    project = tmp_path / "proj a+b"
    lines = [user("q", cwd="/tmp/project"), reply("m1", usage(100, 20))]
    write_log(project / "parent" / "subagents" / "agent-a1.jsonl", lines)
    write_log(project / "subagents" / "plain.jsonl", lines)
    write_log(project / "quiet.jsonl", [reply("m1", usage(1, 1))])
    write_log(tmp_path / "stray.jsonl", lines)
    write_log(project / "late.jsonl", [{"type": "x"}] * 11 + [user("q", cwd="/late")])
    write_log(project / "soon.jsonl", [{"type": "x"}] * 10 + [user("q", cwd="/soon")])
    sessions, _ = run(spark, tmp_path)
    assert set(sessions) == {"parent:agent-a1", "plain", "late", "soon"}
    assert sessions["parent:agent-a1"].project_path == "/tmp/project"
    assert sessions["late"].project_path == str(project)
    assert sessions["soon"].project_path == "/soon"


def test_unknown_model_poisons_bucket_and_session(spark, tmp_path, write_log):
    write_log(
        tmp_path / "proj" / "s.jsonl",
        [
            user("q"),
            reply("a", usage(1, 1), model="nobody"),
            reply("b", usage(1, 1), model="nobody"),
            reply("c", usage(1, 1)),
            reply("d", usage(0, 0), model="nothing"),
        ],
    )
    sessions, buckets = run(spark, tmp_path)
    cost = {b.model: b.cost_micro for b in buckets}
    assert sessions["s"].cost_micro is None
    assert cost["nobody"] is None and cost["claude-opus-4-7"] == 30 and cost["nothing"] == 0


def test_missing_root_and_index(spark, tmp_path):
    assert read_agent_a(spark, str(tmp_path / "none")).count() == 0
    assert read_session_index(spark, str(tmp_path / "none")).count() == 0
    good = tmp_path / "p1" / "sessions-index.json"
    good.parent.mkdir()
    good.write_text(
        '{"entries": [\n{"sessionId": "a", "messageCount": 3, "summary": "one", "modified": "1"},'
        '{"sessionId": "a", "messageCount": 4, "summary": "two", "modified": "2"},'
        '{"sessionId": ""}, {"summary": "no id"}]}'
    )
    bad = tmp_path / "p2" / "sessions-index.json"
    bad.parent.mkdir()
    bad.write_text('{"entries": [')
    rows = index_sessions(read_session_index(spark, str(tmp_path))).collect()
    assert [(r.session_id, r.message_count, r.summary) for r in rows] == [("a", 4, "two")]


def test_splits_give_the_same_result(spark, tmp_path, write_log):
    """A log cut into many small splits normalises like one that is read whole."""
    entries = []
    for i in range(400):
        model = ["claude-opus-4-7", "<synthetic>", "claude-sonnet-4-6"][i // 7 % 3]
        entries.append(user(f"question {i}", ts=f"2026-04-2{i // 200}T{i // 20 % 20:02d}:00:00Z"))
        entries.append(
            reply(f"m{i // 3}", usage(i, i + 1, i * 2, 7, 3), model=model,
                  ts=f"2026-04-2{i // 200}T{i // 20 % 20:02d}:00:01Z")
        )
    write_log(tmp_path / "proj" / "s.jsonl", entries)
    whole = run(spark, tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        chunks = read_agent_a(spark, str(tmp_path)).select("chunk").distinct().count()
        split = run(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert chunks > 10
    assert whole[0] == split[0]
    assert sorted(map(tuple, whole[1])) == sorted(map(tuple, split[1]))


@pytest.mark.parametrize("text", ["<" * 50_000, "<>" * 20_000, "a < b > c", "<x>", ""])
def test_tag_stripping_is_exact_and_linear(spark, text):
    import re

    from pyspark.sql import functions as F

    from meterstone.functions.text import strip_tags

    got = spark.createDataFrame([(text,)], "t string").select(strip_tags(F.col("t"))).first()[0]
    want = text if text.startswith("<" * 10) else re.sub(r"<[^>]+>", "", text)
    assert got == want


def test_a_line_is_one_object_and_nothing_else(spark):
    good = json.dumps(user("hi"))
    lines = [good + tail for tail in ("", "  ", " garbage", good, "," + good, "] x", "}", "]")]
    rows = log_a.parse_lines(frame(spark, lines)).collect()
    assert [r.kind for r in sorted(rows, key=lambda r: r.pos)] == ["turn"] * 2 + ["other"] * 6


def test_counts_of_any_form(spark):
    forms = [10, 10.0, "12", 1e3, None, "x", True, -2]
    lines = [json.dumps(reply(f"m{i}", {"input_tokens": n, "cache_creation": {"ephemeral_1h_input_tokens": n}})) for i, n in enumerate(forms)]
    rows = sorted(log_a.parse_lines(frame(spark, lines)).collect(), key=lambda r: r.pos)
    assert [r.input_tokens for r in rows] == [10, 10, 12, 1000, 0, 0, 0, -2]
    assert [r.cache_1h_tokens for r in rows] == [r.input_tokens for r in rows]


def test_only_text_is_a_prompt(spark):
    contents = [5, True, "5", "true", 1.5, {"a": 1}, None]
    rows = sorted(log_a.parse_lines(frame(spark, [json.dumps(user(c)) for c in contents])).collect(), key=lambda r: r.pos)
    assert [r.prompt for r in rows] == [None, None, "5", "true", None, None, None]
