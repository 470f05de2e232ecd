"""Shared and missing ids: the result is the same however rows are dealt."""

import random

import pytest

from meterstone.llm.substring_dedup import repeats


@pytest.mark.parametrize("parts", [1, 5])
def test_copies_under_shared_and_missing_ids(spark, parts):
    rng = random.Random(6)

    def prose(n):
        return " ".join(rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("xyz") for _ in range(n))

    t, u, v = prose(20), prose(30), prose(40)
    rows = [
        (1, t),
        (None, t),
        (None, prose(25)),
        (2, u),
        (9, u),
        (9, v),
        (9, v),
        (None, v + " " + t),
        (None, "end " + v),
    ]
    want = [(1, 20, 0), (None, 20, 20), (None, 25, 0), (2, 30, 0), (9, 30, 30), (9, 40, 0), (9, 40, 0), (None, 60, 60), (None, 41, 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    out = repeats(table.coalesce(1) if parts == 1 else table.repartition(parts)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in out), key=str) == sorted(want, key=str)
