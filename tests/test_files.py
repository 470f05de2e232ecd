"""Logs listed and read by tasks instead of being planned on the driver."""

import io
import os
import re
from datetime import date

from pyspark.sql import functions as F

from logs import event, meta
from meterstone.plans.sync import sync_history
from meterstone.session import setting
from meterstone.sources import manifest as mf
from meterstone.sources.files import END, MARK, _walk, lines_between, list_tree
from meterstone.sources.logs import read_agent_a, read_lines
from meterstone.sources.registry import LogSource, agent_b
from meterstone.sources.tables import TableStore

ODD = {
    "a.jsonl": b"one\ntwo\r\n\rthree\r\r\n\nfour",
    "b.jsonl": b"\xef\xbb\xbfmarked\n\xef\xbb\xbfnot\n",
    "c.jsonl": b"\n",
    "d.jsonl": b"",
    "e.jsonl": "é ü\x0b\x85\n".encode() + b"\xff\xfe broken\nend\r",
    "p q/f%20+[1].jsonl": b"x" * 9_000 + b"\n" + b"y\r\n" * 3_000,
}


def in_order(lines):
    rows = sorted(lines.withColumn("value", F.hex(F.col("value").cast("binary"))).collect(), key=lambda r: (r.file_path, r.chunk, r.pos))
    return [(r.file_path, r.modified, r.value) for r in rows]


def test_every_line_belongs_to_one_split():
    for data in ODD.values():
        want = END.split(data.removeprefix(MARK))
        want = want[:-1] if want[-1] == b"" else want
        for step in (1, 2, 3, 7, 4096) if len(data) < 100 else (97, 4096, 100_000):
            blocks = [lines_between(io.BytesIO(data), at, min(at + step, len(data))) for at in range(0, len(data), step)]
            assert b"".join(blocks).split(b"\n")[:-1] == want


def test_lines_as_spark_reads_them(spark, tmp_path):
    for name, data in ODD.items():
        path = tmp_path / "logs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    for name in (".h.jsonl", "_h.jsonl", "x.json", ".git/h.jsonl", "_tmp/h.jsonl", "_a=b/i.jsonl"):
        path = tmp_path / "logs" / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("hidden or not\n")
    os.symlink(tmp_path / "nowhere", tmp_path / "logs" / "gone.jsonl")
    os.utime(tmp_path / "logs" / "a.jsonl", ns=(0, 1_700_000_000_123_999_999))
    root = str(tmp_path / "logs")
    # With an option Spark's own source reads.
    want = in_order(read_lines(spark, root, ignoreMissingFiles="true"))
    assert in_order(read_lines(spark, root)) == want and len(want) > 3_000
    with setting(spark, "spark.sql.files.maxPartitionBytes", "4096"):
        lines = read_lines(spark, root)
        assert in_order(lines) == want and lines.select("file_path", "chunk").distinct().count() > 7


def test_listing_is_handed_on(spark, tmp_path):
    for k in range(40):
        path = tmp_path / "r" / str(k % 5) / str(k % 7) / f"{k}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * k)
    root = str(tmp_path / "r")
    assert any(size is None for _, size, _ in _walk(root, 10))
    want = sorted((os.path.basename(r.file_path), r.size, r.modified) for r in mf.list_files(spark, f"{root}/[0-9]", "*.jsonl", "v").collect())
    got = [(os.path.basename(r.file_path), r.size, r.modified) for r in list_tree(spark, root, "*.jsonl", most=10).collect()]
    assert sorted(got) == want and len(want) == 39  # without the empty one


def test_short_splits_share_tasks(spark, write_log, tmp_path):
    """Splits of many logs are no tasks of their own."""
    for k in range(40):
        write_log(tmp_path / "a" / "proj" / f"{k}.jsonl", [{"n": i, "text": "x" * 100} for i in range(200)])
    with setting(spark, "spark.sql.files.maxPartitionBytes", "4096"):
        lines = read_agent_a(spark, str(tmp_path / "a"))
        assert lines.select("file_path", "chunk").distinct().count() > 200
        assert lines.rdd.getNumPartitions() < 20


def test_a_sync_plans_no_files_on_the_driver(spark, write_log, tmp_path):
    """Names and splits of changed logs stay in tables."""
    for k in range(3):
        write_log(tmp_path / "b" / "2026" / f"rollout-{k}.jsonl", [meta(str(k))])
    root = str(tmp_path / "b")
    listing = mf.list_files(spark, root, "rollout-*.jsonl", "v")
    lines = mf.read_changed(spark, root, "rollout-*.jsonl", listing)
    for frame in (listing, lines):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"binaryFile|\btext\b", plan) and frame.inputFiles() != [] and not any("rollout" in f for f in frame.inputFiles())
    assert listing.count() == lines.count() == 3


def test_a_sync_broadcasts_little(spark, write_log, tmp_path):
    """A table of many logs is far larger on the driver than its files are."""
    write_log(tmp_path / "b" / "rollout-1.jsonl", [meta("1"), event("user_message", message="m")])
    name, seen = "spark.sql.autoBroadcastJoinThreshold", []
    whole, before = agent_b(str(tmp_path / "b")), spark.conf.get(name)

    def normalise(lines, as_of, book):
        seen.append(int(spark.conf.get(name)))
        return whole.normalise(lines, as_of, book)

    store = TableStore(spark, str(tmp_path / "s"))
    sync_history(store, [LogSource("b", whole.root, whole.glob, normalise)], date(2026, 4, 30))
    assert store.sessions().count() == 1 and seen[0] <= 1 << 20 and spark.conf.get(name) == before
