import random

from pyspark.sql import functions as F

from meterstone.llm.cross_parse_language import Fit, fit_language, language, learn, normalised, suffix_automaton


def phrases(text: bytes, known: bytes) -> int:
    """Greedy parse into the longest pieces of ``known``; a byte never seen is a piece."""
    n = at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[at : end + 1] in known:
            end += 1
        at = max(end, at + 1)
        n += 1
    return n


def speech(alphabet, n, rng):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_automaton_accepts_exactly_the_substrings():
    text = b"abcbcabbca"
    nexts = suffix_automaton(text)
    rng = random.Random(2)
    for _ in range(500):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6)))
        state = 0
        for symbol in piece:
            state = nexts[state].get(symbol) if state is not None else None
        assert (state is not None) == (piece in text)


def test_costs_are_those_of_a_plain_parse():
    rng = random.Random(5)
    known = {"x": [speech("abcd", 80, rng)], "y": [speech("cdef", 80, rng)]}
    model = learn(known, Fit(block_bytes=10**6))
    texts = [speech("abcdefg", n, rng) for n in (1, 5, 200)]
    costs = model.costs([normalised(t) for t in texts])
    for text, row in zip(texts, costs, strict=True):
        for k, name in enumerate(model.languages):
            sample = normalised(known[name][0])
            assert abs(row[k] - phrases(normalised(text), sample) * model.bits[k]) < 1e-9


def test_languages_are_told_apart(spark, docs, nothing):
    rng = random.Random(9)
    rows = [(i, speech(["aeiourst", "aeßüöklm"][i % 2], 60, rng), ["one", "two"][i % 2]) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language(table, F.col("id") % 4 != 2)
    out = language(table, model).collect()
    assert sum(r.language.lang == r.lang for r in out) >= 198
    assert all(0 <= r.language.score <= 1 for r in out)
    every = language(docs, model)
    assert every.columns == [*docs.columns, "language"]
    for r in every.collect():
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.language.lang == "und") == (not letters)
    assert language(nothing, model).collect() == []


def test_nothing_learned(docs, nothing):
    model = fit_language(nothing)
    assert {r.language.lang for r in language(docs, model).collect()} == {"und"}


def test_blocks_cover_long_texts():
    rng = random.Random(4)
    model = learn({"x": [speech("abcd", 500, rng)], "y": [speech("efgh", 500, rng)]})
    long = speech("abcd", 20_000, rng)
    assert model.predict([long, "efgh " * 300, None, "12 !"]) [0][0] == "x"
    assert [k for k, _ in model.predict([long, "efgh " * 300, None, "12 !"])] == ["x", "y", "und", "und"]
