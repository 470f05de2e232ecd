from pyspark.sql import functions as F

from logs import context, event, meta, tokens, total
from meterstone.functions.jsonline import whole_number
from meterstone.operators import log_b
from meterstone.sources.logs import read_agent_b
from meterstone.streaming.steps import batch_writer


def test_a_batch_is_read_without_what_steps_do_not_need(spark, tmp_path, write_log):
    """Prompts, folders and branches are most of a parsed line; without late rows nobody looks at them."""
    entries = [meta("s", forked_from_id="p")]
    for i in range(1, 13):
        if i == 4:
            entries.append(context("gpt-5.4"))
        entries.append(event("user_message", message="m"))
        entries.append(tokens(total(i * 100, i * 10, i)))
    write_log(tmp_path / "logs" / "rollout-s.jsonl", entries)
    parsed = log_b.parse_lines(read_agent_b(spark, str(tmp_path / "logs"))).checkpoint()
    want = log_b.events_b(log_b.resolve_state(parsed)).agg(F.sum("output_tokens")).first()
    unread = F.raise_error(F.lit("read")).cast("string")
    rows = parsed.withColumns({"prompt": unread, "meta_cwd": unread, "meta_branch": unread})
    folder = str(tmp_path / "steps")
    batch_writer(folder)(rows, 0)
    assert spark.read.parquet(f"{folder}/events").agg(F.sum("output_tokens")).first() == want
    assert spark.read.parquet(f"{folder}/late").count() == 0


def test_counts_are_the_same_whole_or_not(spark):
    texts = ["12", "12.0", " 7 ", "-3", "+4", "1e3", "0.9999999", "12.9999999", "", "x", "1_0", "12\x7f", None]
    texts += ["9223372036854775807", "9223372036854775808", "99999999999999999999999999999999999999999"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(whole_number(F.col("t")).alias("n"), F.col("t").try_cast("decimal(38,6)").try_cast("bigint").alias("m")).collect()
    assert [r.n for r in got] == [r.m for r in got]
