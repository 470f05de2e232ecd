import random
import re

import pytest

from meterstone.llm.context_pii import Bootstrap, find_pii, mask_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def private(spark):
    rng = random.Random(11)
    alphabet = ["a", "b.", "@", "é", " ", "-", "1", "23", "4539", "255.", "+1 ", "(", ")", "x@y.z", "\n", "\u0001", "😀", "4111111111111111 "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(600)]
    texts += [None, "", "9" * 3000, "1.2." * 2000, "a@b.c." * 500, "+1 " * 500, "a" * 5000 + "@b.c", "1 " * 4000]
    return spark.createDataFrame(list(enumerate(texts)) + [(None, "a@b.cd"), (5, texts[5])], "doc_id long, text string")


def test_base_against_plain_patterns(private):
    rows = find_pii(private).collect()
    texts = {}
    for r in private.collect():
        texts.setdefault(r.doc_id, set()).add(str(brute(r.text)))
    assert len(rows) == private.count()
    for r in rows:
        base = [(s.start, s["rank"] - 1, s.kind, s.stop) for s in r.spans if s.base]
        assert str(base) in texts[r.doc_id]


def test_contexts_reveal_what_no_pattern_knows(spark):
    seeds = [(i, f"Please call me at +1 (555) 010-0{i:03d} today, thanks") for i in range(12)]
    hidden = [(100 + i, f"Please call me at 555-01{i:02d}-77 today, thanks") for i in range(5)]
    other = [(200 + i, f"The order number 777-{i:04d}-88 was sent") for i in range(5)]
    table = spark.createDataFrame(seeds + hidden + other, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in find_pii(table).collect()}
    for i, text in hidden:
        (span,) = found[i]
        assert (span.kind, span.base, text[span.start : span.stop]) == ("phone", False, text[18 : text.index(" today")])
    assert all(not found[i] for i, _ in other)
    few = find_pii(table, how=Bootstrap(support=50)).collect()
    assert all(not r.spans for r in few if r.doc_id >= 100)


def test_mask(docs, private):
    out = mask_pii(private)
    assert out.columns == private.columns
    want = []
    for r in private.collect():
        text, at = "", 0
        spans = brute(r.text)
        while spans:
            start, _, kind, stop = spans.pop(0)
            while spans and spans[0][0] < stop:
                stop = max(stop, spans.pop(0)[3])
            text += r.text[at:start] + f"[{kind.upper()}]"
            at = stop
        want.append((r.doc_id, None if r.text is None else text + r.text[at:]))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in out.collect())
    assert mask_pii(docs).columns == docs.columns


@pytest.mark.parametrize("operator", [find_pii, mask_pii])
def test_empty(nothing, operator):
    assert operator(nothing).collect() == []
