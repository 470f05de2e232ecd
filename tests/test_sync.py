import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from logs import context, event, meta, reply, tokens, total, usage, user
from meterstone.functions.pricebook import BUILTIN, PriceBook
from meterstone.operators.usage import usage_source
from meterstone.plans import reports as R
from meterstone.plans import sync
from meterstone.plans.sync import sync_history
from meterstone.sources import manifest as mf
from meterstone.sources.intents import Intents
from meterstone.sources.registry import LogSource, agent_a, agent_b
from meterstone.sources.tables import TableStore

DAY = date(2026, 4, 20)


@pytest.fixture
def world(spark, tmp_path, write_log):
    a, b = tmp_path / "a", tmp_path / "b"
    write_log(
        a / "proj" / "s.jsonl",
        [user("q", cwd="/w"), reply("m1", usage(1_000_000, 0)), user("z", ts="2026-04-21T01:00:00Z")],
    )
    write_log(
        b / "2026" / "rollout-x.jsonl",
        [meta("x"), context("gpt-5.4"), event("user_message", message="m"), tokens(total(100, 0, 10))],
    )
    (a / "proj" / "sessions-index.json").write_text(
        json.dumps(
            {
                "entries": [
                    {"sessionId": "s", "messageCount": 99, "gitBranch": "idx", "summary": "sum s"},
                    {"sessionId": "only", "messageCount": 3, "created": "2026-04-19T05:00:00Z"},
                ]
            }
        )
    )
    return TableStore(spark, str(tmp_path / "store"), key_buckets=4), a, b


def go(store, a, b, book=BUILTIN, **more):
    return sync_history(
        store, [agent_a(str(a)), agent_b(str(b))], DAY, book, index_root=str(a), **more
    )


def rows(store):
    return {r.session_id: r for r in store.sessions().collect()}


def test_sync_and_reports(world):
    store, a, b = world
    go(store, a, b)
    sessions = rows(store)
    assert set(sessions) == {"s", "x", "only"}
    assert (sessions["s"].message_count, sessions["s"].git_branch) == (3, "idx")
    assert sessions["s"].summary == "sum s" and sessions["s"].cost_micro == 5_000_000
    assert (sessions["only"].message_count, sessions["only"].cost_micro) == (3, 0)
    source = usage_source(store.usage(), store.sessions())
    days = {r.usage_date: r.session_count for r in R.daily(source, date(2026, 4, 1), date(2026, 5, 1)).collect()}
    assert days == {date(2026, 4, 19): 1, date(2026, 4, 20): 2, date(2026, 4, 21): 1}
    slow = usage_source(store.usage(), store.sessions().drop("has_buckets"))
    assert sorted(map(str, slow.collect())) == sorted(map(str, source.collect()))


def test_changed_file_replaces_its_buckets(world, write_log):
    store, a, b = world
    go(store, a, b)
    before = store.usage().filter(F.col("session_id") == "x").collect()
    write_log(a / "proj" / "s.jsonl", [user("new", cwd="/w"), reply("m1", usage(0, 99))])
    go(store, a, b)
    mine = store.usage().filter(F.col("session_id") == "s")
    assert mine.agg(F.sum("output_tokens"), F.sum("input_tokens")).first()[:] == (99, 0)
    # The second day has no row of any session left.
    assert store.usage().filter(F.col("usage_date") == date(2026, 4, 21)).count() == 0
    assert store.usage().filter(F.col("session_id") == "x").collect() == before
    assert rows(store)["s"].first_prompt == "new"
    assert rows(store)["s"].git_branch == "idx"


def test_same_size_edit_is_seen_and_unchanged_files_are_not_read(spark, world):
    store, a, b = world
    go(store, a, b)
    pending = mf.changed_files(
        mf.list_files(spark, str(b), "rollout-*.jsonl", BUILTIN.version), store.manifest()
    )
    assert pending.count() == 0
    path = b / "2026" / "rollout-x.jsonl"
    path.write_text(path.read_text().replace('"output_tokens": 10', '"output_tokens": 99'))
    os.utime(path, (1_800_000_000, 1_800_000_000))
    go(store, a, b)
    assert rows(store)["x"].output_tokens == 99
    forgotten = mf.forget(store.manifest(), str(b))
    assert forgotten.count() == store.manifest().count() - 1


def test_a_log_that_vanishes_takes_no_other_with_it(spark, world, write_log):
    store, a, b = world
    gone = write_log(b / "2026" / "rollout-gone.jsonl", [meta("gone"), event("user_message", message="m")])
    write_log(b / "2026" / "rollout-stays.jsonl", [meta("stays"), event("user_message", message="m")])
    listed = mf.list_files(spark, str(b), "rollout-*.jsonl", "v").collect()
    listing = spark.createDataFrame(listed, mf.MANIFEST)
    gone.unlink()
    lines = mf.read_changed(spark, str(b), "rollout-*.jsonl", listing)
    assert {os.path.basename(r.file_path) for r in lines.collect()} == {"rollout-x.jsonl", "rollout-stays.jsonl"}
    known = mf.read_files(listing, lines)
    assert str(gone) not in {r.file_path for r in known.collect()} and known.count() == 2


def test_only_what_was_read_is_known(spark, world, write_log):
    store, a, b = world
    (a / "loose.jsonl").write_text("{}")
    (a / "proj" / "empty.jsonl").write_text("")
    go(store, a, b)
    known = {os.path.basename(r.file_path) for r in store.manifest().collect()}
    assert known == {"s.jsonl", "rollout-x.jsonl"}


def test_an_older_log_of_a_session_does_not_replace_the_newer_one(world, write_log):
    store, a, b = world

    def log(name, out, time):
        path = write_log(b / "2026" / f"rollout-{name}.jsonl", [meta("two"), event("user_message", message=name), tokens(total(0, 0, out))])
        os.utime(path, (time, time))

    log("new", 50, 1_800_000_000)
    go(store, a, b)
    log("old", 7, 1_700_000_000)
    go(store, a, b)
    assert rows(store)["two"].output_tokens == 50
    log("new", 60, 1_800_000_500)
    go(store, a, b)
    log("newer", 9, 1_800_001_000)
    go(store, a, b)
    assert rows(store)["two"].output_tokens == 9
    mine = store.usage().filter(F.col("session_id") == "two")
    assert mine.agg(F.sum("output_tokens")).first()[0] == 9


def test_odd_file_names(spark, tmp_path, write_log):
    root = tmp_path / "odd"
    for name in ("p[1] a+b", "p{x,y}", "p*q", "p%20z"):
        write_log(root / name / "rollout-1.jsonl", [event("user_message", message=name)])
    listing = mf.list_files(spark, str(root), "rollout-*.jsonl", "v")
    lines = mf.read_changed(spark, str(root), "rollout-*.jsonl", listing)
    assert {r.file_path for r in lines.collect()} == {r.file_path for r in listing.collect()}
    assert lines.count() == 4


def test_price_change_reprices_requests(world):
    store, a, b = world
    go(store, a, b)
    book = PriceBook.of(models={"claude-opus-4-7": (1, 0, 0, 0)})
    assert go(store, a, b, book).repriced
    assert rows(store)["s"].cost_micro == 1_000_000
    assert not go(store, a, b, book).repriced


def test_broken_source_is_left_out(spark, world):
    store, a, b = world

    def explode(lines, as_of, book):
        raise RuntimeError("no such layout")

    result = sync_history(
        store, [LogSource("bad", str(b), "rollout-*.jsonl", explode), agent_a(str(a))], DAY
    )
    assert list(result.failed) == ["bad"]
    assert set(rows(store)) == {"s"}


def test_price_edits_persist(world):
    store, a, b = world
    go(store, a, b, None)
    assert rows(store)["s"].cost_micro == 5_000_000
    store.edit_prices([{"kind": "model", "op": "set", "model": "claude-opus-4-7", "prices": (1, 0, 0, 0)}])
    assert go(store, a, b, None).repriced
    assert rows(store)["s"].cost_micro == 1_000_000
    store.edit_prices([{"kind": "model", "op": "remove", "model": "claude-opus-4-7"}])
    go(store, a, b, None)
    assert rows(store)["s"].cost_micro == 5_000_000
    with pytest.raises(ValueError):
        store.edit_prices([{"kind": "model", "op": "set", "model": "m", "prices": (0.0000004, 0, 0, 0)}])


def state(store):
    """What the tables say of each session: costs and tokens of both must agree."""
    usage = store.usage().groupBy("session_id").agg(F.sum("output_tokens").alias("n"), F.sum("cost_micro").alias("c"))
    return (
        {r.session_id: (r.n, r.c) for r in usage.collect()},
        {r.session_id: (r.output_tokens, r.cost_micro) for r in store.sessions().filter("has_buckets").collect()},
    )


@pytest.mark.parametrize("at", ["staged sessions", "between the tables"])
def test_a_crash_leaves_all_or_nothing(world, write_log, monkeypatch, at):
    store, a, b = world
    go(store, a, b)
    before = state(store)
    write_log(a / "proj" / "s.jsonl", [user("new", cwd="/w"), reply("m1", usage(0, 99))])
    write_log(b / "2026" / "rollout-y.jsonl", [meta("y"), context("gpt-5.4"), event("user_message", message="m"), tokens(total(7, 0, 7))])

    def crash(*args, **more):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        if at == "staged sessions":
            broken.setattr(TableStore, "_stage_sessions", crash)
        elif at == "before the record":
            broken.setattr(Intents, "commit", crash)
        elif at == "after the record":
            broken.setattr(Intents, "carry_out", crash)
        else:
            rename, moves = Intents._rename, []

            def second_fails(self, source, target):
                moves.append(target)
                if len(moves) == 3:  # the record, one partition, then the crash
                    crash()
                rename(self, source, target)

            broken.setattr(Intents, "_rename", second_fails)
        with pytest.raises(RuntimeError, match="lost"):
            go(store, a, b)
    recorded = at in ("after the record", "between the tables")
    assert bool(store.recover()) == recorded
    usage_now, sessions_now = state(store)
    assert usage_now == sessions_now
    assert ((usage_now, sessions_now) == before) == (not recorded)
    go(store, a, b)
    usage_now, sessions_now = state(store)
    assert usage_now == sessions_now and usage_now["s"][0] == 99 and usage_now["y"][0] == 7
    assert not any((a.parent / "store" / "intents").iterdir())


def test_reprice_writes_only_what_changes(world, write_log):
    store, a, b = world
    write_log(
        b / "2026" / "rollout-far.jsonl",
        [meta("far"), context("unpriced"), event("user_message", ts="2026-05-02T01:00:00Z", message="m"), tokens(total(5, 0, 5), ts="2026-05-02T01:00:00Z")],
    )
    go(store, a, b)

    def files():
        return {p: p.stat().st_mtime_ns for table in ("usage", "sessions") for p in (a.parent / "store" / table).rglob("*.parquet")}

    before = files()
    # Costs that a log gave stay; only what had no price can change.
    book = PriceBook.of(models={"unpriced": (1, 1, 1, 1), "claude-opus-4-7": (9, 9, 9, 9)})
    sync.reprice(store, book)
    gone = {str(p.parent.name) for p in before if p not in files()}
    assert {g for g in gone if g.startswith("usage_date")} == {"usage_date=2026-05-02"}
    assert len({g for g in gone if g.startswith("key_bucket")}) == 1
    assert {r.session_id: r.cost_micro for r in store.sessions().collect()}["far"] == 10
    assert state(store)[0] == state(store)[1]
    before = files()
    sync.reprice(store, book)
    assert files() == before
