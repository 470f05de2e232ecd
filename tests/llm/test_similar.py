import random
import re

import numpy as np
import pytest

from meterstone.llm import partenum_join
from meterstone.llm.common import components
from meterstone.llm.partenum_join import Join, Sets, jaccard_join, keep_one, signatures
from meterstone.llm.recompression import anchors
from meterstone.llm.substring_dedup import LAST, repeats


def root(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)]
    edges += [(5, 5), (None, 3), edges[0]]
    parent = {i: i for i in range(500)}
    for a, b in edges:
        if a is not None:
            x, y = root(parent, a), root(parent, b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {i: root(parent, i) for i in linked}


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(r.text) for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                x, y = root(parent, i), root(parent, j)
                parent[max(x, y)] = min(x, y)
    out = []
    for i, r in enumerate(rows):
        ids = [q.doc_id for k, q in enumerate(rows) if root(parent, k) == root(parent, i) and q.doc_id is not None]
        out.append((r.doc_id, len(sets[i]), min(ids, default=None), links[i]))
    return sorted(out, key=str), [root(parent, i) for i in range(len(rows))]


@pytest.mark.parametrize("sizes", [(2_000_000, 4096, 10**6), (150, 2, 0)])
def test_join_against_brute_force(docs, monkeypatch, sizes):
    """Also with tiny blocks, and with the texts of candidates joined by id."""
    for name, value in zip(("BLOCK_SHINGLES", "BLOCK_SETS", "BROADCAST_IDS"), sizes, strict=True):
        monkeypatch.setattr(partenum_join, name, value)
    want, _ = brute(docs.collect())
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join(docs).collect()), key=str)
    assert got == want
    assert sum(n > 0 for *_, n in want) > 20


def test_keep_one(docs, nothing):
    rows = docs.collect()
    _, groups = brute(rows)
    out = keep_one(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert len(kept) == len(set(groups))
    for group in set(groups):
        ids = [r.doc_id for r, g in zip(rows, groups, strict=True) if g == group and r.doc_id is not None]
        assert not ids or min(ids) in {r.doc_id for r in kept}
    assert keep_one(nothing).collect() == [] and jaccard_join(nothing).collect() == []


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    join = Join()
    for size in [1, 2, 8, 9, 10, 11, 19, 20, 37, 90, 200, 1500]:
        for _ in range(20):
            a = rng.integers(0, 2**63, size, dtype=np.uint64)
            other = size + int(rng.integers(-size // 10, size // 9 + 1))
            most = min(size, other)
            # As few common elements as a link allows.
            common = next(c for c in range(most + 2) if 100 * c >= 90 * (size + other - c))
            if common > most:
                continue
            b = np.concatenate((rng.permutation(a)[:common], rng.integers(0, 2**63, other - common, dtype=np.uint64)))
            both = Sets(np.repeat([0, 1], [size, other]), np.concatenate((np.sort(a), np.sort(b))), np.array([size, other]))
            text, key = signatures(both, np.array([True, True]), join)
            assert set(key[text == 0].tolist()) & set(key[text == 1].tolist()), (size, other, common)


def gone(rows, width=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows]
    key = [LAST if r.doc_id is None else r.doc_id for r in rows]
    first = {}
    for w, k in zip(words, key, strict=True):
        for i in range(len(w) - width + 1):
            t = tuple(w[i : i + width])
            first[t] = min(first.get(t, k), k)
    out = []
    for w, k, r in zip(words, key, rows, strict=True):
        hit = {i + j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < k for j in range(width)}
        out.append((r.doc_id, len(w), len(hit), " ".join(x for i, x in enumerate(w) if i not in hit)))
    return out


def test_repeats_against_brute_force(spark, docs):
    import hashlib

    rng = random.Random(3)
    runs = [" ".join(rng.choice("ab") for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    runs += [" ".join(["run"] * rng.randrange(10, 40)) for _ in range(6)]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(runs)], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(more).repartition(5)
    want = [(a, b, c, hashlib.sha256(t.encode()).hexdigest()) for a, b, c, t in gone(table.collect())]
    rows = repeats(table).collect()
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in rows:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert sum(c > 0 for _, _, c, _ in want) > 30


def test_repeats_of_nothing(nothing):
    assert repeats(nothing).collect() == []


def test_a_window_has_the_same_anchor_everywhere():
    rng = np.random.default_rng(5)
    for alphabet in (2, 5, 1000):
        passage = rng.integers(1, alphabet + 1, 40).astype(np.uint64)
        seen = []
        for _ in range(20):
            before, after = (rng.integers(1, alphabet + 1, 30).astype(np.uint64) for _ in range(2))
            every = anchors(np.concatenate((before, passage, after)), 13, 3)
            seen.append(every[30 : 30 + 28].tolist())
        assert all(s == seen[0] for s in seen)
        assert all(seen[0])
