"""Exact sizes, gapless slots, and the law of the counts."""

from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from meterstone.llm import shuffle_shards as module
from meterstone.llm.shuffle_shards import hypergeometric, matrix, shares, shuffle_shards


def check(rows, n, shards):
    sizes = Counter(r[0] for r in rows)
    assert len(rows) == n
    assert [sizes[s] for s in range(shards)] == [n // shards + (s < n % shards) for s in range(shards)]
    for s in range(shards):
        assert sorted(r[1] for r in rows if r[0] == s) == list(range(sizes[s]))


@pytest.mark.parametrize("shards,runs", [(24, 1 << 22), (5, 3), (300, 1 << 22)])
def test_sizes_and_slots(docs, monkeypatch, shards, runs):
    monkeypatch.setattr(module, "RUN_ROWS", runs)
    monkeypatch.setattr(module, "PART_BITS", 3)
    rows = shuffle_shards(docs, shards).select("shard", "slot").collect()
    check(rows, docs.count(), shards)


def test_all_rows_and_columns_stay(docs):
    out = shuffle_shards(docs.withColumn("shard", F.lit("mine")), 4)
    assert out.columns == [*docs.columns, "shard", "shard_", "slot"]
    assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))


def test_empty_and_few(spark, nothing):
    assert shuffle_shards(nothing).collect() == []
    check(shuffle_shards(spark.range(3), 24).select("shard", "slot").collect(), 3, 24)


def test_same_files_same_result(spark, tmp_path):
    spark.range(500).repartition(4).write.parquet(f"{tmp_path}/t")
    one, two = (sorted(map(tuple, shuffle_shards(spark.read.parquet(f"{tmp_path}/t"), 7, seed=3).collect())) for _ in range(2))
    other = sorted(map(tuple, shuffle_shards(spark.read.parquet(f"{tmp_path}/t"), 7, seed=4).collect()))
    assert one == two != other


@pytest.mark.parametrize("total,good,drawn", [(30, 12, 9), (30, 12, 25), (10, 10, 4), (10, 0, 4), (7, 3, 7), (7, 3, 0), (1000, 30, 500)])
def test_quantiles(spark, total, good, drawn):
    """Every quantile gives the count whose summed probability first exceeds it."""
    low, high = max(0, drawn - (total - good)), min(good, drawn)
    chance = [comb(good, x) * comb(total - good, drawn - x) / comb(total, drawn) for x in range(low, high + 1)]
    table = spark.range(997).select(((F.col("id") + 0.5) / 997).alias("u"))
    args = (F.lit(v).cast("long") for v in (total, good, drawn))
    for r in table.select("u", hypergeometric(*args, F.col("u")).alias("x")).collect():
        below = sum(chance[: r.x - low])
        assert below - 1e-9 <= r.u <= below + chance[r.x - low] + 1e-9


def test_large_counts_stay_near_the_mean(spark):
    table = spark.range(400).select(F.rand(1).alias("u"))
    x = hypergeometric(F.lit(10**10), F.lit(4 * 10**8), F.lit(5 * 10**9), F.col("u"))
    mean, dev = table.limit(60).select(x.alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(mean - 2e8) < 5 * 9800 / 60**0.5 and 7000 < dev < 13000


def test_matrix_sums_and_law(spark):
    """Row and column sums hold; one cell follows its law over many seeds."""
    sizes = [5, 0, 3, 9, 2]
    parts = spark.createDataFrame([(10 + i, i, n) for i, n in enumerate(sizes)], "part long, no long, rows long")
    columns = spark.createDataFrame([([7, 7, 5],)], "counts array<long>")
    for seed in range(2):
        got = {r.part - 10: r.counts for r in matrix(parts, columns, len(sizes), seed).collect()}
        assert [sum(got[i]) for i in range(5)] == sizes
        assert [sum(c) for c in zip(*got.values(), strict=True)] == [7, 7, 5]
        assert all(n >= 0 for row in got.values() for n in row)
    many = spark.range(4000).select(
        shares(F.array(*(F.lit(n).cast("long") for n in (7, 7, 5))), F.lit(19), F.lit(9), F.xxhash64("id"))[1].alias("x")
    )
    seen = Counter(r.x for r in many.collect())
    for x in range(8):
        want = comb(7, x) * comb(12, 9 - x) / comb(19, 9)
        assert abs(seen[x] / 4000 - want) < 5 * (want / 4000) ** 0.5 + 1e-3


def test_every_place_is_as_likely(spark, tmp_path):
    """Over seeds, the first rows of the table land in many places, and neighbours part."""
    spark.range(0, 400, 1, 2).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    where, together = Counter(), 0
    for seed in range(3):
        rows = {r.id: r.shard for r in shuffle_shards(table, 4, seed).collect()}
        where.update(rows[i] for i in range(100))
        together += sum(rows[i] == rows[i + 1] for i in range(399))
    # 300 rows over 4 shards, and 1,197 pairs of neighbours of which a fourth should stay together.
    assert all(45 < where[s] < 105 for s in range(4)) and 230 < together < 370
