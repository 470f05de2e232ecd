import re

import pytest

from meterstone.llm.mixing import mix, take


def level(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= cap * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            target[s] = cap * sizes[s]
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def test_targets_and_taken(docs):
    rows = mix(docs).collect()
    source = {}
    for d in docs.collect():
        source.setdefault(d.source, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")))
    want = level({s: sum(v) for s, v in source.items()})
    assert len(rows) == docs.count()
    by_target = {}
    for r in rows:
        assert r.taken == r["size"] * r.copies and 0 <= r.taken <= 2 * r["size"]
        by_target.setdefault(round(r.target, 6), []).append(r)
    for s, sizes in source.items():
        mine = by_target[round(want[s], 6)]
        assert {r.source_size for r in mine} == {sum(sizes)}
        # The last bucket holds a single text, so no source is off by more than half of one.
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(sizes)


def test_reruns_agree(docs):
    assert sorted(map(str, mix(docs).collect())) == sorted(map(str, mix(docs.repartition(2)).collect()))


def test_take_keeps_columns(docs):
    out = take(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "masks", "size", "source_size", "target", "copies", "taken"]
    assert sum(r.taken for r in out.collect()) == sum(r.taken for r in mix(docs).collect())


@pytest.mark.parametrize("operator", [mix, take])
def test_empty(nothing, operator):
    assert operator(nothing).collect() == []


def test_texts_without_words(spark):
    rows = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in mix(rows).collect()] == [(0, 0.0, 0)] * 2
