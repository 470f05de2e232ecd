"""Bitmaps of sessions against plain distinct counts."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from meterstone.operators.sessionbits import distinct_sessions, number_sessions, session_bits

START = date(2026, 1, 1)


@pytest.fixture
def facts(spark):
    rng = random.Random(5)
    rows = [
        (rng.choice("ab"), f"s{rng.randrange(300)}", START + timedelta(days=int(rng.triangular(0, 40, 5))))
        for _ in range(2000)
    ]
    return spark.createDataFrame(rows, "agent_type string, session_id string, usage_date date")


def days(start, end):
    return START + timedelta(days=start), START + timedelta(days=end)


def test_any_range_is_exact(facts):
    ranges = [(f"r{k}", *days(*k)) for k in [(0, 0), (0, 40), (3, 9), (9, 20), (35, 60), (90, 99)]]
    bits = session_bits(facts, number_sessions(facts))
    got = {(r["label"], r.agent_type): r.session_count for r in distinct_sessions(bits, ranges).collect()}
    want = {}
    for label, start, end in ranges:
        seen = {tuple(r) for r in facts.where(F.col("usage_date").between(start, end)).select("agent_type", "session_id").distinct().collect()}
        for agent in "ab":
            if any(a == agent for a, _ in seen):
                want[label, agent] = sum(a == agent for a, _ in seen)
        if seen:
            want[label, None] = len(seen)
    assert got == want


def test_new_days_extend_the_bits(facts):
    """Numbers of earlier sessions stay, so bitmaps of old and new days go together."""
    cut = START + timedelta(days=10)
    old, new = facts.where(F.col("usage_date") < cut), facts.where(F.col("usage_date") >= cut)
    known = number_sessions(old)
    more = number_sessions(new, known)
    numbers = known.union(more)
    assert numbers.count() == facts.select("agent_type", "session_id").distinct().count() == numbers.select("number").distinct().count()
    bits = session_bits(old, numbers).union(session_bits(new, numbers))
    whole = [("all", *days(0, 99))]
    got = {r.agent_type: r.session_count for r in distinct_sessions(bits, whole).collect()}
    assert got[None] == numbers.count() == got["a"] + got["b"]


def test_ranges_read_the_bits_alone(facts, tmp_path, spark):
    session_bits(facts, number_sessions(facts)).write.partitionBy("usage_date").parquet(f"{tmp_path}/bits")
    frame = distinct_sessions(spark.read.parquet(f"{tmp_path}/bits"), [("x", *days(0, 9)), ("y", *days(5, 12))])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "PartitionFilters: [isnotnull(usage_date" in plan
