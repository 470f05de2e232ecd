"""The share of good labels does not depend on the bound of the sample."""

import random

from pyspark.sql import functions as F

from meterstone.llm.compression_quality import Fit, fit_quality, learn


def test_bounded_sample_keeps_the_share(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    # The labels say nothing about the texts, so that all there is to learn is their share.
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), int(i % 7 != 0)) for i in range(560)]
    known = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs, labels = known.select("doc_id", "text"), known.select("doc_id", "quality")
    bounded = fit_quality(docs, labels, fit=Fit(rows_per_label=60))
    whole = fit_quality(docs, labels)
    assert bounded.prior == whole.prior == 481 / 562
    score = bounded.scorer()
    assert score(None) == bounded.prior
    mean = sum(score(t.encode()) for _, t, _ in rows) / len(rows)
    assert abs(mean - 6 / 7) < 0.1
    # Labels without a text teach nothing.
    more = labels.union(spark.createDataFrame([(10_000 + i, 0) for i in range(500)], "doc_id long, quality int"))
    assert fit_quality(docs, more, F.col("id") >= 0, fit=Fit(rows_per_label=700)).prior == whole.prior


def test_texts_of_the_dictionaries_are_scored_like_others():
    """Few labels, all of whose texts the dictionaries hold whole: both halves of the good ones are kept alike."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    good = [" ".join(rng.choice(words) for _ in range(rng.randrange(40, 120))).encode() for _ in range(120)]
    bad = [" ".join([rng.choice(words)] * 3 + [rng.choice("#$%&*")] * rng.randrange(1, 5)).encode() * 8 for _ in range(30)]
    model = learn([(t, 1) for t in good] + [(t, 0) for t in bad])
    score = model.scorer()
    built, others = ([score(t) >= 0.5 for t in half] for half in (good[::2], good[1::2]))
    assert sum(built) == len(built) and sum(others) >= len(others) - 1
    assert sum(score(t) < 0.5 for t in bad) >= 28
