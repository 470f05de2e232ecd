import random

import pytest
from pyspark.sql import functions as F

from meterstone.llm.compression_quality import Fit, fit_quality, learn, quality_score
from meterstone.llm.weak_rules import expectation_maximisation, figures, judge

import numpy as np


def sample(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    good = [" ".join(rng.choice(words) for _ in range(80)) + "." for _ in range(n)]
    bad = [" ".join(rng.choice(words).upper() + "!!" for _ in range(80)) for _ in range(n)]
    return good, bad


def test_held_out_accuracy():
    good, bad = sample(200)
    rows = [(t.encode(), 1) for t in good[:100]] + [(t.encode(), 0) for t in bad[:100]]
    score = learn(rows).scorer()
    right = sum(score(t.encode()) >= 0.5 for t in good[100:]) + sum(score(t.encode()) < 0.5 for t in bad[100:])
    assert right >= 195


def test_without_both_labels_the_score_is_the_share():
    score = learn([(b"text", 1)] * 3).scorer()
    assert score(b"anything") == score(None) == 4 / 5


def test_scores_of_all_rows(spark, docs, nothing):
    good, bad = sample(30)
    known = spark.createDataFrame(
        [(i, t, i % 2) for i, t in enumerate(x for pair in zip(bad, good, strict=True) for x in pair)],
        "doc_id long, text string, quality int",
    )
    labels = known.select("doc_id", "quality")
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7), (3, 1)], "doc_id long, quality int")
    model = fit_quality(known.select("doc_id", "text"), labels.union(odd), F.col("id") % 3 != 1)
    out = quality_score(docs, model)
    assert out.columns == [*docs.columns, "score"]
    rows = out.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert quality_score(nothing, model).collect() == []
    again = fit_quality(known.select("doc_id", "text").repartition(5), labels.union(odd), F.col("id") % 3 != 1)
    assert again.weights == model.weights
    assert fit_quality(nothing, labels).weights == ()


def test_bound_of_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert fit_quality(docs, labels, fit=Fit(rows_per_label=3)).prior == 0.5


def brute_figures(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_figures_against_brute_force(docs, texts):
    extra = ["a\na\n\n a\na", "x y z x y z x", "é é é é", "##|<>", "one two three"]
    for text in [t for t in texts if len(t or "") < 20000] + extra:
        assert figures(text.encode() if text else None)[:5] == brute_figures(text)


def test_judge(docs, nothing):
    rows = judge(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.posterior >= 0.5)
    assert any(r.kept for r in rows)
    assert judge(nothing).collect() == []


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.9, 0.8, 0.85, 0.7])
    votes = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]) * -1 + 2
    votes[rng.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, good, chance = expectation_maximisation(patterns, counts.astype(float))
    assert abs(good - 0.7) < 0.03
    found = chance[:, 1, 1] / (chance[:, 1, 1] + chance[:, 1, 2])
    assert np.abs(found - right).max() < 0.05
    assert ((posterior >= 0) & (posterior <= 1)).all()


@pytest.mark.parametrize("text", [b"", None])
def test_no_text(text):
    assert set(figures(text)) == {0}
