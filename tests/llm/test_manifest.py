"""The manifest against plain hashing, with rounds of more than one block."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from meterstone.llm import merkle_manifest
from meterstone.llm.merkle_manifest import fold, leaf_of, manifest, proof


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    texts = [None if v is None else str(v) for v in values]
    return h(*("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def grown(nodes):
    """The root of ``nodes``, and the siblings of each up to it."""
    proofs, at = [""] * len(nodes), list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, i in enumerate(at):
            proofs[k] += "".join(n for j, n in enumerate(runs[i // 8]) if j != i % 8)
        nodes, at = [h(*run) for run in runs], [i // 8 for i in at]
    return nodes[0], proofs


def brute(rows):
    """``doc_id, leaf, subroot, root, proof`` of ``doc_id, source, lang, n_chars, text`` rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(*r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        leaves = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((leaves, *grown([x[1] for x in leaves])))
    root, above = grown([t[1] for t in trees]) if trees else (None, [])
    return sorted(
        (
            (i, node, sub, root, h(p + up))
            for (leaves, sub, proofs), up in zip(trees, above, strict=True)
            for (i, node), p in zip(leaves, proofs, strict=True)
        ),
        key=str,
    )


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def built(table):
    out = manifest(table).select("id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_against_plain_hashing(docs):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    assert built(docs) == brute([tuple(r) for r in docs.select(*fields).collect()])


@pytest.mark.parametrize("levels", [1, 2])
def test_blocks_of_blocks(spark, monkeypatch, levels):
    """Small blocks: trees of up to five levels and many languages take several rounds."""
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "SPAN", 8**levels)
    rng = random.Random(3)
    langs = ["big"] * 700 + ["b"] * 65 + ["a"] * 8 + ["é"] + [None] * 3 + ["", "Z"] + [f"l{k}" for k in range(70)]
    rows = [(rng.choice([None, *range(400)]), "s", lang, 1, rng.choice(["x", "y", None])) for lang in langs]
    table = spark.createDataFrame(rows, COLUMNS)
    assert built(table.repartition(5)) == brute(rows)


def test_rows_dealt_otherwise_give_the_same_root(docs):
    assert built(docs.repartition(7)) == built(docs.coalesce(1))


@pytest.mark.parametrize("rows", [[(1, "s", "en", 1, "t")], [(1, None, None, None, None)], [(2, "s", "en", 1, "t")] * 9])
def test_small_trees(spark, rows):
    assert built(spark.createDataFrame(rows, COLUMNS)) == brute(rows)


def test_fold_finds_changes(spark):
    rows = [(i, "s", "en", 4, "Abc" if i % 2 else "abc") for i in range(100)]
    table = spark.createDataFrame(rows, COLUMNS)
    other = leaf_of(*map(F.col, ["doc_id", "source", "lang", "n_chars"]), F.lower("text"))
    folded = manifest(table, other=other).withColumn("folded", fold(F.col("other"), F.col("path")))
    assert {(r.id % 2 == 1) == (r.folded != r.root) for r in folded.collect()} == {True}


def test_empty(nothing):
    assert manifest(nothing).collect() == []


def test_query_tampers_by_checksum(spark, tmp_path):
    from meterstone.llm.queries import op11_merkle_manifest

    rows = [(i, "s", ["en", None][i % 2], 3, [None, "Abc", "abc", "É"][i % 4]) for i in range(40)] + [(None, None, None, None, "Q")]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_merkle_manifest(spark, str(tmp_path)).collect()
    text = {r[0]: r[4] for r in rows}
    for r in got:
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and (text[r.doc_id] or "").startswith("A")
        assert r.verified == (not changed) == (r.folded_root == r.root)
    assert len(got) == len(rows)
