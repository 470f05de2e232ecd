"""Logs are small and many, and share tasks in a sync."""

from datetime import date

from logs import reply, usage, user
from meterstone.sources.logs import read_agent_a
from meterstone.sources.registry import LogSource, agent_a, parse_all
from meterstone.sources.tables import TableStore


def test_small_logs_share_tasks(spark, write_log, tmp_path):
    for k in range(600):
        write_log(tmp_path / "a" / "proj" / f"{k}.jsonl", [user("q"), reply("m", usage(k + 1, 1))])
    root = str(tmp_path / "a")
    whole, tasks = agent_a(root), []

    def normalise(lines, as_of, book):
        tasks.append(read_agent_a(spark, root).rdd.getNumPartitions())
        return whole.normalise(lines, as_of, book)

    before = spark.conf.get("spark.sql.files.openCostInBytes")
    source = LogSource("a", root, "*.jsonl", normalise, whole.is_log)
    parsed, failed = parse_all(spark, [source], TableStore(spark, str(tmp_path / "s")).manifest(), date(2026, 4, 30))
    assert not failed and parsed.files.count() == 600
    assert parsed.hours.groupBy().sum("input_tokens").first()[0] == 600 * 601 // 2
    # At 4 MB a file a task had 32 of them.
    assert tasks[0] < 10 and spark.conf.get("spark.sql.files.openCostInBytes") == before
