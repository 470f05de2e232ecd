"""The pipeline's near copies: five-word shingles, 0.8."""

import random
import re

import pytest

import corpus_pipeline
from meterstone.llm import partenum_join, rare_prefix
from meterstone.llm.partenum_join import Join, jaccard_join

WIDE = Join(shingle=5, part=80, whole=100)


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Sorted ``id, size, component, links`` of each row, and the group of each."""
    sets = [shingles(text) for _, text in rows]
    group, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    least = {g: min((i for (i, _), h in zip(rows, group, strict=True) if h == g and i is not None), default=None) for g in group}
    out = [(i, len(s), least[g], n) for (i, _), s, g, n in zip(rows, sets, group, links, strict=True)]
    return sorted(out, key=str), group


def planted():
    """Texts, copies of theirs with two words replaced (0.8 to 0.9), and a line of many texts."""
    rng = random.Random(9)

    def prose(n):
        return [rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + rng.choice("xyz") for _ in range(n)]

    line, rows = prose(12), []
    for k in range(30):
        base = prose(rng.choice([8, 30, 100, 130])) + (line if k % 3 == 0 else [])
        rows.append(base)
        for _ in range(3):
            copy = base[:]
            for at in rng.sample(range(0, len(base), 5), min(2, len(base) // 12)):
                copy[at] = "changed"
            rows.append(copy + (["more"] * rng.randrange(3)))
    hundred = prose(100)
    edited = hundred[:]
    edited[30] = edited[70] = "edited"
    return [" ".join(w) for w in [*rows, hundred, edited]]


def test_stage_links_at_eight_tenths_of_five_words(spark):
    rows = list(enumerate(planted()))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, table, "").collect()}
    # 86 of 106 shingles of five words are common, but 92 of 104 of three.
    assert rows[-2][0] in kept and rows[-1][0] not in kept
    assert kept == set(brute(rows)[1])


@pytest.mark.parametrize("blocks", [(2_000_000, 512), (150, 2)])
def test_join_against_brute_force(spark, docs, monkeypatch, blocks):
    for name, value in zip(("BLOCK_SHINGLES", "BLOCK_SETS"), blocks, strict=True):
        monkeypatch.setattr(partenum_join, name, value)
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(planted())], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(more).repartition(5)
    want = brute([(r.doc_id, r.text) for r in table.collect()])[0]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join(table, join=WIDE).collect()), key=str)
    assert got == want


def edges_of(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    rows = table.selectExpr("row", "row AS doc_id", "CAST(text AS BINARY) AS text")
    known = rows.mapInArrow(partenum_join._doc_rows(WIDE, True), "row long, doc_id long, n_shingles long, h1 long, h2 long, marks array<long>")
    name = {r.h1: r.row for r in known.collect()}
    return {tuple(sorted((name[e.a], name[e.b]))) for e in partenum_join.by_prefix(rows, known, WIDE).collect()}


def test_unrelated_sets_make_no_candidates(spark):
    rng = random.Random(2)
    assert edges_of(spark, [" ".join(str(rng.randrange(10**6)) for _ in range(80)) for _ in range(400)]) == set()


def test_a_line_of_many_texts_makes_no_candidates(spark):
    """Groups of near copies that have a license line in common stay apart."""
    rng = random.Random(4)
    line, texts, group = " ".join(str(rng.randrange(10**6)) for _ in range(30)), [], []
    for g in range(60):
        base = [str(rng.randrange(10**6)) for _ in range(90)]
        for _ in range(3):
            copy = base[:]
            copy[rng.randrange(90)] = "changed"
            texts.append(line + " " + " ".join(copy))
            group.append(g)
    edges = edges_of(spark, texts)
    assert edges and all(group[a] == group[b] for a, b in edges)


@pytest.mark.parametrize("paired", [2, 32])
def test_elements_of_many_sets(spark, monkeypatch, paired):
    """Above the bound sets are linked to the least one; the outcome is the same."""
    monkeypatch.setattr(rare_prefix, "PAIRED", paired)
    monkeypatch.setattr(rare_prefix, "BUCKET_ELEMENTS", 500)
    rng = random.Random(6)
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    rows = []
    for i in range(80):
        copy = base[:]
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 4])):
            copy[at] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)[0]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join(table, join=WIDE).collect()), key=str) == want
