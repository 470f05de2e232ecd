import random

import pytest

WORDS = "the of and to in that is was for on with as by at it from be this are or".split()


@pytest.fixture(scope="session")
def texts():
    """Prose with repeated passages, copies and near copies; every case of an odd text."""
    rng = random.Random(7)

    def prose(n):
        return " ".join(rng.choice(WORDS) + rng.choice(["", "a", "be", "ing", "er", "."]) for _ in range(n))

    passage = prose(60)
    out = [prose(rng.randrange(20, 150)) for _ in range(40)]
    out += [out[0], out[0], out[1].upper()]
    for base in out[2:8]:
        words = base.split()
        for _ in range(3):
            near = words[:]
            near[rng.randrange(len(near))] = "changed"
            out.append(" ".join(near))
    out += [prose(30) + "\n" + passage + " " + prose(20) for _ in range(5)]
    out += ["a " * 40, "a " * 25 + "b " * 20, "x", "x y", "", None, " \t\n ", "é ü " * 10, "long" * 5000, "…" * 50]
    out += [prose(5000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with repeated rows, NULLs and columns of clashing names."""
    rows = [
        (i, t, ["en", "fr", None][i % 3], ["b", "a", None, "c"][i % 4], len(t or ""), i, "r", 1.5)
        for i, t in enumerate(texts)
    ]
    rows += [rows[3], rows[3], (5, "another text under an id that is taken", "en", "a", 1, 0, "", None)]
    rows += [(None, texts[4], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, n_chars long, row long, masks string, Size double",
    ).repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
