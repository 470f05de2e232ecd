import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterstone.llm.brown_lm import END, SHAPES, Size, best_class, exchange, fit_model, score_texts, shape, smoothed, word_counts
from meterstone.llm.common import bucket_of, stage

SMALL = Size(clustered=20, classes=4, shared=150, evidence=5)


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("size", [SMALL, Size()])
def test_base_against_brute_force(docs, size):
    rows = docs.collect()
    tokens = {}
    count = Counter()
    for r in rows:
        line = (r.text or "").encode().lower().split() + [END]
        tokens.setdefault(r.doc_id, []).append(line)
        if not held(r.doc_id):
            count.update(line)
    n, v = sum(count.values()), len(count)
    got = score_texts(docs, bucket_of(F.col("id"), 7) != 2, size=size).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.train_tokens) == (held(r.doc_id), n)
        assert any(
            r.n_tokens == len(line)
            and r.n_known == sum(count[w] > 0 for w in line)
            and abs(r.base_score - sum(math.log10((count[w] + 1) / (n + v + 1)) for w in line)) < 1e-6
            for line in tokens[r.doc_id]
        )
        assert r.score < 0 and abs(10 ** (-r.score / r.n_tokens) - r.perplexity) < 1e-6 * r.perplexity
    if size == Size():
        known = [r for r in got if r.n_tokens > 15 and not r.held_out]
        assert sum(r.score > r.base_score for r in known) > 0.8 * len(known)


def test_the_model_is_a_distribution(docs):
    texts = docs.select(F.col("text").cast("binary").alias("text"))
    counts = stage(word_counts(texts))
    model = fit_model(texts, counts, SMALL)
    assert np.allclose((10.0**model.transitions).sum(axis=1), 1)
    # Words of a class, and what is left for unseen ones of a shape, add up to one.
    share = Counter()
    shared = {w: i for i, w in enumerate(model.words)}
    for r in counts.where("shape >= 0").collect():
        i = shared.get(bytes(r.word))
        if i is not None:
            share[model.class_of[i]] += 10 ** model.emissions[i]
        else:
            below = model.emissions[len(model.words) + r["shape"]]
            of = model.class_of[len(model.words) + r["shape"]]
            share[of] += 10 ** (math.log10(r["count"] + model.smoothing) + below)
    for s in range(SHAPES):
        place = len(model.words) + s
        share[model.class_of[place]] += 10 ** (math.log10(model.smoothing) + model.emissions[place])
    for of, total in share.items():
        assert abs(total - 1) < 1e-9, of


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    # Words of even number are followed by odd ones, and the other way round.
    grid = np.zeros((14, 14))
    for a in range(12):
        for b in range(12):
            grid[a, b] = rng.integers(50, 90) if (a + b) % 2 else rng.integers(0, 3)
    of = exchange(grid, 12, 2, 20)
    assert len({of[a] for a in range(0, 12, 2)}) == 1 and len({of[a] for a in range(1, 12, 2)}) == 1
    assert of[0] != of[1] and of[12] == 2 and of[13] == 3


def test_no_training_rows(docs, nothing):
    got = score_texts(docs, F.lit(False)).collect()
    assert len(got) == docs.count()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in got)
    assert score_texts(nothing, F.lit(True)).collect() == []


def test_shapes_are_within_bounds():
    for word in ("a", "a.", "é", "é,", "1", "…", "ab!", "x#"):
        assert 0 <= shape(word.encode()) < SHAPES


def test_words_by_their_neighbours_take_the_likeliest_class():
    """Against the likelihood of each choice, neighbour by neighbour."""
    rng = np.random.default_rng(3)
    classes, total = 4, 9
    transitions = smoothed(rng.integers(0, 40, size=(total, total)).astype(float))
    sizes = rng.integers(5, 200, size=total).astype(float)
    counts = rng.integers(0, 6, size=(30, 2 * total)).astype(float)
    times, of_shape = counts.sum(axis=1) / 2, rng.integers(classes, total, size=30)
    got = best_class(counts, times, of_shape, transitions, sizes, classes)
    for w in range(30):
        def likelihood(c, w=w):
            near = sum(counts[w, d] * transitions[c, d] + counts[w, total + d] * transitions[d, c] for d in range(total))
            held = sizes[c] if c == of_shape[w] else sizes[c] + times[w]
            return near - times[w] * math.log10(held)

        want = {c: likelihood(c) for c in [*range(classes), of_shape[w]]}
        assert abs(want[got[w]] - max(want.values())) < 1e-9


def test_scores_against_brute_force(docs):
    """Every text's score, transition by transition, from the model's tables; and the transitions from the corpus."""
    training = bucket_of(F.col("id"), 7) != 2
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    taught = texts.where(F.coalesce(training, F.lit(True))).select("text")
    counts = stage(word_counts(taught))
    model = fit_model(taught, counts, SMALL)
    listed, count = {w: i for i, w in enumerate(model.words)}, {bytes(r.word): r["count"] for r in counts.collect()}
    assert any(model.class_of[i] < 4 for i in range(20, len(model.words)))

    def place(word):
        return listed.get(word, len(model.words) + shape(word)) if word else len(model.words) + SHAPES

    def line(text):
        return [*(text or b"").lower().split(), END]

    seen = np.zeros_like(model.transitions)
    for r in taught.collect():
        before = model.class_of[-1]
        for word in line(r.text):
            seen[before, model.class_of[place(word)]] += 1
            before = model.class_of[place(word)]
    assert np.allclose(smoothed(seen), model.transitions)
    want = []
    for r in texts.collect():
        before, score = model.class_of[-1], 0.0
        for word in line(r.text):
            at = place(word)
            score += model.transitions[before, model.class_of[at]] + model.emissions[at]
            if word and word not in listed:
                score += math.log10(count.get(word, 0) + model.smoothing)
            before = model.class_of[at]
        want.append((str(r.id), round(score, 5)))
    got = score_texts(docs, training, size=SMALL).collect()
    assert sorted((str(r.doc_id), round(r.score, 5)) for r in got) == sorted(want)
