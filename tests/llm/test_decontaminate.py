import re

import pytest
from pyspark.sql import functions as F

from meterstone.llm.decontaminate import contaminated, decontaminate, n_hit, words


def split(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(text, items, width=13):
    tokens, hit, found = split(text), set(), set()
    for item, body in items:
        w = split(body)
        n = min(width, len(w))
        for i in range(len(w) - n + 1) if w else []:
            for j in range(len(tokens) - n + 1):
                if tokens[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(tokens), len(hit), sorted(str(x) for x in found if x is not None)


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    some = [(i, " ".join(texts[i].split()[3:30])) for i in (0, 3, 9)] + [(7, "is was"), (8, ""), (9, None)]
    some += [(0, some[0][1]), (None, " ".join(texts[12].split()[:15])), (10, "CHANGED")]
    return spark.createDataFrame(some, "item_id long, text string")


@pytest.mark.parametrize("bound", [10**6, 0])
def test_against_brute_force(docs, benchmark, bound):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    found = decontaminate(docs, benchmark, broadcast_words=bound)
    assert found.columns == [*docs.columns, "hits"]
    rows = found.select("text", "hits", n_hit(F.col("hits")).alias("n"), contaminated(F.col("hits")).alias("c")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, hit, names = brute(r.text, items)
        assert (r.hits.n_words, r.n, r.hits["items"], r.c) == (n, hit, names, hit > 0 and 20 * hit >= n)


def test_clean_text_lacks_the_hit_words(spark):
    docs = spark.createDataFrame([("Some words. One, TWO three! Other words",)], "text string")
    items = spark.createDataFrame([(1, "one two three")], "item_id int, text string")
    row = decontaminate(docs, items).first()
    assert row.hits.clean_text == "Some words. ! Other words"
    assert words(row.hits.clean_text.encode()) == [b"some", b"words", b"other", b"words"]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_empty_sides(docs, benchmark, nothing, bound):
    assert decontaminate(nothing, benchmark, broadcast_words=bound).collect() == []
    none = decontaminate(docs, benchmark.where("false"), broadcast_words=bound)
    assert none.where(n_hit(F.col("hits")) > 0).count() == 0
    assert none.count() == docs.count()


def test_a_result_column_of_a_taken_name_replaces_it(docs, benchmark):
    out = decontaminate(docs, benchmark, to="SIZE", broadcast_words=0)
    assert [c.lower() for c in out.columns].count("size") == 1
