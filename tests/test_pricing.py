from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterstone.functions.fixed_prices import UNPRICED_FAMILIES, builtin_models
from meterstone.functions.pricebook import BUILTIN, PriceBook
from meterstone.operators.pricing import (
    CHANGES,
    book_from_rules,
    current_rules,
    model_dimension,
    price_list,
    tier_list,
)
from meterstone.sources.pricefile import parse_price_file, read_price_book

COLS = ["i", "o", "r", "w", "h"]


def costs(spark, rows, book=BUILTIN, long_context=True):
    """USD cost of (model, input, output, read, write, 1h write) rows, in order."""
    frame = spark.createDataFrame(
        [(n, *r) for n, r in enumerate(rows)],
        "n int, model string, i long, o long, r long, w long, h long",
    )
    priced = book.with_cost(
        frame, "c", F.col("model"), *[F.col(c) for c in COLS], long_context=long_context
    )
    return [
        None if r.c is None else float(r.c / 1_000_000) for r in priced.orderBy("n").collect()
    ]


def test_price_points(spark):
    million = 1_000_000
    rows = [
        ("claude-sonnet-4-6", million, million, 0, 0, 0),
        ("claude-opus-4-6", 500_000, 100_000, 2_000_000, 200_000, 0),
        ("gpt-5.1-codex", 900_000, 0, 100_000, 0, 0),
        ("gpt-5.4", 272_001, 0, 0, 0, 0),
        ("gpt-5.4", 272_000, 0, 0, 0, 0),
        ("gpt-5.4-mini", 300_000, 0, 0, 0, 0),
        ("gpt-5.4-pro", 1, 0, 0, 0, 0),
        ("nobody", 0, 0, 0, 0, 0),
        ("nobody", 0, 1, 0, 0, 0),
        ("<synthetic>", 5, 5, 5, 5, 0),
        ("claude-sonnet-4-20250514", 200_001, 0, 0, 1000, 1000),
        ("claude-sonnet-4-6", 200_001, 0, 0, 1000, 1000),
        ("claude-opus-4-7", 0, 0, 0, 1000, 5000),
        ("claude-4.5-sonnet-thinking", million, 0, 0, 0, 0),
        ("gpt-5.40", 1, 0, 0, 0, 0),
        ("claude-opus-4-7", -5, 0, 0, 0, 0),
        ("gpt-5.4", -10, 300_000, 400_000, 0, 0),
    ]
    assert costs(spark, rows) == [
        18.0, 7.25, 1.1375,
        pytest.approx(272_001 * 5 / 1e6), pytest.approx(272_000 * 2.5 / 1e6),
        pytest.approx(300_000 * 0.75 / 1e6),
        None, 0.0, None, 0.0,
        pytest.approx((200_001 * 6 + 1000 * 12) / 1e6),
        pytest.approx((200_001 * 3 + 1000 * 6) / 1e6),
        pytest.approx(1000 * 10 / 1e6),
        3.0, None, 0.0,
        pytest.approx((-10 * 2.5 + 300_000 * 15 + 400_000 * 0.25) / 1e6),
    ]


def test_aggregates_use_no_request_rates_and_do_not_overflow(spark):
    rows = [("gpt-5.4", 300_000, 0, 0, 0, 0), ("claude-3-opus", 10**14, 10**14, 0, 0, 0)]
    assert costs(spark, rows, long_context=False) == [0.75, pytest.approx(9e9)]


def test_user_rules(spark):
    book = PriceBook.of(
        models={"gpt-5.4-pro": (30, 180, 0, 0), "house": (1, 2, 3, 4)},
        tiers={
            "gpt-5.4": [(512_000, (9, 9, 9, 9)), (272_000, (7, 7, 7, 7))],
            "gpt-5.4-x": [(900_000, (99, 99, 99, 99))],
        },
        write_1h={"claude": 8, "claude-opus": 20},
        disabled=["gpt-5.5"],
    )
    rows = [
        ("gpt-5.4-pro", 1_000_000, 0, 0, 0, 0),
        ("gpt-5.4-pro", 100, 0, 0, 0, 0),
        ("gpt-5.4", 300_000, 0, 0, 0, 0),
        ("gpt-5.4-x", 600_000, 0, 0, 0, 0),
        ("house", 1_000_000, 0, 0, 0, 0),
        ("house-2", 1_000_000, 0, 0, 0, 0),
        ("gpt-5.5", 300_000, 0, 0, 0, 0),
        ("claude-opus-4-7", 0, 0, 0, 1_000_000, 1_000_000),
        ("claude-sonnet-4-6", 0, 0, 0, 1_000_000, 1_000_000),
    ]
    assert costs(spark, rows, book) == [
        9.0, pytest.approx(0.003), pytest.approx(2.1), pytest.approx(5.4), 1.0, None,
        pytest.approx(1.5), 20.0, 8.0,
    ]


def test_long_price_list_is_joined(spark, monkeypatch):
    book = PriceBook.of(models={"house": (1, 2, 3, 4), "gpt-5.4": (9, 9, 9, 9), "<synthetic>": (5, 5, 5, 5)})
    rows = [
        ("house", 10**6, 0, 0, 0, 0), ("gpt-5.4", 10**6, 0, 0, 0, 0), ("gpt-5.4-x", 100, 0, 0, 0, 0),
        ("<synthetic>", 10**6, 0, 0, 0, 0), ("nobody", 1, 0, 0, 0, 0),
    ]
    inline = costs(spark, rows, book, long_context=False)
    monkeypatch.setattr("meterstone.functions.pricebook.INLINE_LIMIT", 1)
    assert costs(spark, rows, book, long_context=False) == inline
    assert inline == [1.0, 9.0, pytest.approx(0.00025), 0.0, None]


def test_long_lists_of_every_kind_are_joined(spark, monkeypatch):
    """Tiers and 1h rates as rows give what they give as constants, nested prefixes and fall-backs too."""
    steps = [(1000 * k, (k, k, k, k)) for k in range(1, 13)]
    book = PriceBook.of(
        models={"house": (1, 2, 3, 4)},
        tiers={"claude": [(100, (7, 7, 7, 7))], "claude-opus-4": [(10**6, (8, 8, 8, 8))], "house": steps, "gpt-5.4": [(50, (1, 1, 1, 1))]},
        write_1h={"claude": 9, "claude-opus-4-7": 11, "house": 2},
    )
    rows = [
        ("claude-opus-4-7", 200, 1, 0, 10, 5), ("claude-opus-4-7", 10**6, 1, 1, 0, 0), ("claude-x", 99, 0, 0, 1, 1),
        ("claude-opus-47", 200, 1, 0, 10, 5), ("house", 3500, 1, 0, 9, 9), ("house", 20_000, 1, 0, 0, 0), ("house-a", 500, 0, 0, 0, 0),
        ("gpt-5.4-pro", 60, 0, 0, 0, 0), ("nobody", 5, 0, 0, 0, 0), ("", 1, 0, 0, 0, 0),
    ]
    inline = costs(spark, rows, book)
    assert inline[0] is not None and inline[4] is not None
    for limit in ({"INLINE_LIMIT": 0}, {"INLINE_LIMIT": 0, "BROADCAST_LIMIT": 0}, {"UNROLLED_TIERS": 0}):
        with monkeypatch.context() as changed:
            for name, value in limit.items():
                changed.setattr(f"meterstone.functions.pricebook.{name}", value)
            assert costs(spark, rows, book) == inline


def prefix_price(model):
    """Longest-prefix lookup spelled out, to compare the expressions with."""
    if model == "<synthetic>":
        return Decimal(0)
    hit = [p for p in builtin_models() if model == p or model.startswith(p + "-")]
    if any(model == p or model.startswith(p + "-") for p in UNPRICED_FAMILIES) or not hit:
        return None
    return builtin_models()[max(hit, key=len)][0]


PARTS = ["claude", "opus", "sonnet", "4", "3", "7", "gpt", "5.4", "5", "mini", "pro", "codex", "x"]


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.lists(st.sampled_from(PARTS), min_size=1, max_size=5).map("-".join),
        min_size=1,
        max_size=40,
    )
)
def test_expression_and_dimension_agree(spark, models):
    names = sorted({*models, *builtin_models(), "gpt-5.4-pro-x", "<synthetic>", ""})
    frame = spark.createDataFrame([(m,) for m in names], "model string")
    inline = {
        r.model: r.p
        for r in frame.select("model", BUILTIN.base_price(F.col("model"))["input"].alias("p")).collect()
    }
    joined = {
        r.model: r.p
        for r in model_dimension(frame, BUILTIN).select("model", "price.input").toDF("model", "p").collect()
    }
    want = {m: prefix_price(m) for m in names if m not in ("codex-auto-review",)}
    assert joined == want
    assert inline == {m: None if p is None else int(p * 1_000_000) for m, p in want.items()}


def test_price_file(spark, tmp_path):
    good = tmp_path / "prices.json"
    good.write_text(
        '{"models": {"claude-4.5-sonnet-thinking": [1, 2, 3, 4]},'
        ' "long_context": {"a": {"threshold": 5, "prices": [1, 1, 1, 1]},'
        ' "b": {"tiers": [{"threshold": 9, "prices": [2, 2, 2, 2]}, {"threshold": 7, "prices": [1, 1, 1, 1]}]}},'
        ' "cache": {"c": {"write_1h": 4.5}, "d": {}},'
        ' "disabled_builtin_long_context": ["gpt-5.4"]}'
    )
    book = read_price_book(spark, str(good))
    assert list(book.models) == ["claude-sonnet-4-5"]
    assert [t for t, _ in book.tiers["b"]] == [7, 9]
    assert book.tiers["a"][0][0] == 5
    assert book.write_1h == {"c": Decimal("4.500000")}
    assert book.disabled == {"gpt-5.4"}
    assert book.version != BUILTIN.version
    assert parse_price_file("{broken") == BUILTIN
    assert parse_price_file('{"models": {"m": [1, 2, 3]}}') == BUILTIN
    assert parse_price_file('{"models": {"m": [1, 2, 3, 4]}, "cache": {"c": 1}}') == BUILTIN
    assert read_price_book(spark, str(tmp_path / "absent.json")) == BUILTIN


def test_lists(spark):
    same = tuple(float(p) for p in builtin_models()["gpt-5"])
    book = PriceBook.of(
        models={"gpt-5": same, "gpt-5.4": (1, 1, 1, 1), "mine": (2, 2, 2, 2)},
        tiers={"mine": [(10, (3, 3, 3, 3))]},
        disabled=["gpt-5.5"],
    )
    source = {r.model: r.source for r in price_list(spark, book).collect()}
    assert source["gpt-5"] == "builtin"
    assert source["gpt-5.4"] == "override"
    assert source["mine"] == "custom"
    assert len(source) == len(builtin_models()) + 1
    tiers = [(r.prefix, r.source) for r in tier_list(spark, book).collect()]
    assert tiers[0][0] == "claude-sonnet-4"
    assert ("gpt-5.5", "disabled") in tiers and ("mine", "user") in tiers


def test_edits(spark):
    p = Decimal(1)
    rows = [
        (1, "model", "old", None, "set", p, p, p, p, None),
        (2, "all", None, None, "remove", None, None, None, None, None),
        (3, "model", "a", None, "set", p, p, p, p, None),
        (4, "model", "a", None, "set", p + 1, p, p, p, None),
        (5, "model", "b", None, "set", p, p, p, p, None),
        (6, "model", "b", None, "remove", None, None, None, None, None),
        (7, "disable", "gpt-5.4", None, "set", None, None, None, None, None),
        (8, "disable", "gpt-5.5", None, "set", None, None, None, None, None),
        (9, "tier", "gpt-5.4", 10, "set", p, p, p, p, None),
        (10, "tier", "t", 1, "set", p, p, p, p, None),
        (11, "tier", "t", None, "remove", None, None, None, None, None),
        (12, "tier", "t", 2, "set", p, p, p, p, None),
        (13, "cache", "codex-auto-review", None, "set", None, None, None, None, p),
    ]
    book = book_from_rules(current_rules(spark.createDataFrame(rows, CHANGES)))
    assert book.models == {"a": (2, 1, 1, 1)}
    assert book.disabled == {"gpt-5.5"}
    assert {m: [t for t, _ in rows] for m, rows in book.tiers.items()} == {"gpt-5.4": [10], "t": [2]}
    assert book.write_1h == {"gpt-5.3-codex": 1}
    with pytest.raises(ValueError):
        PriceBook.of(tiers={"m": [(-1, (1, 1, 1, 1))]})
