"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterstone.llm import hard_negatives as module
from meterstone.llm.hard_negatives import Mining, Postings, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string"


def brute(rows, every, mining=Mining()):
    sound = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], label)
        for i, v, label, _ in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = max((len(v) for _, v, _ in sound), default=0)
    sound = [(i, v + [0] * (width - len(v)), label) for i, v, label in sound]
    out = []
    for k, (i, v, label) in enumerate(sound):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for m, (j, w, other) in enumerate(sound) if m != k]
        scored.sort()
        for p, j, _ in [s for s in scored if s[2] == label][: mining.positives]:
            fits = [s for s in scored if s[2] != label and -mining.low * p <= -100 * s[0] <= -mining.high * p]
            out += [(i, j, r + 1, s[1], -p, -s[0]) for r, s in enumerate(fits[: mining.negatives])]
    return sorted(out)


def planted(seed, n=220, width=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=width) * rng.choice([0.05, 0.5, 3])
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(4)), "r"))
    same = rows[7][1]
    rows += [(1000 + i, same, i % 2, None) for i in range(60)]
    rows += [rows[0], rows[0], (0, rows[3][1], 1, "t"), (5, rows[5][1], None, ""), (None, same, 1, "")]
    rows += [(2000, None, 1, ""), (2010, [float("nan")] * width, 1, ""), (2020, [float("inf")] * width, 2, "")]
    rows += [(2030, [None] + [0.5] * (width - 1), 3, ""), (2040, [], 1, ""), (2050, [0.0] * width, 2, ""), (2060, [0.25, -0.5], 0, "")]
    return rows


def mined(spark, rows, every=10, **more):
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(map(tuple, hard_negatives(table, F.col("vec_id") % every == 0, F.col("label"), **more).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = planted(seed)
    got = mined(spark, rows)
    assert got and got == brute(rows, 10)


def test_blocks_and_panels(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 40), ("BLOCK_ANCHORS", 5), ("STEP_ROWS", 16), ("PANEL", 3)):
        monkeypatch.setattr(module, name, value)
    rows = planted(3, n=150)
    assert mined(spark, rows) == brute(rows, 10)


def test_other_windows(spark):
    rows, mining = planted(4, n=120), Mining(positives=2, negatives=7, low=10, high=120)
    assert mined(spark, rows, mining=mining) == brute(rows, 10, mining)


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1, "")]) == []
    assert mined(spark, [(0, [1.0], 1, ""), (1, [1.0], 1, "")]) == []
    assert mined(spark, [(0, [1.0], 1, ""), (1, [1.0], 1, ""), (2, [0.9], 2, "")]) == [(0, 1, 1, 2, 65536, 58880)]


def test_scores_too_large(spark):
    with pytest.raises(ValueError, match="2\\*\\*40"):
        mined(spark, [(0, [5000.0], 1, "")])


@pytest.mark.parametrize("share", [-5.0, 0.0, 0.2, 0.6, 0.95])
def test_index_loses_no_pair(share):
    """What the index omits and prunes is below the threshold; every other pair is found, exactly."""
    rng = np.random.default_rng(0)
    rows = np.floor(rng.normal(size=(300, 50)) * rng.choice([1, 30, 200], size=(1, 50)))
    rows[40:60] = rows[0] + np.floor(rng.normal(size=(20, 50)) * 9)
    anchors = rows[::20]
    norms = np.linalg.norm(anchors, axis=1)
    least = share * norms * np.linalg.norm(rows, axis=1).max()
    squares = np.cumsum((anchors * anchors)[:, ::-1], axis=1)[:, ::-1]
    suffix = np.sqrt(np.concatenate((squares, np.zeros((len(anchors), 1))), axis=1))
    index = Postings(rows, float(least.min()) / norms.max() - 1e-9)
    a, r, score = index.reaching(anchors, suffix, least)
    want = anchors @ rows.T
    assert set(zip(a.tolist(), r.tolist(), score.tolist(), strict=True)) == {
        (i, j, want[i, j]) for i, j in zip(*np.nonzero(want >= least[:, None]), strict=True)
    }
    if share >= 0.6:
        assert (index.indexed < rows.shape[1]).any()


def test_random_order_of_rows(spark):
    rows = planted(5, n=100)
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    assert mined(spark, rows) == mined(spark, mixed)
