from datetime import date, datetime
from decimal import Decimal

import pytest


from meterstone.functions.pricebook import BUILTIN
from meterstone.operators import calendar as cal
from meterstone.operators import live as L
from meterstone.operators.usage import COLUMNS
from meterstone.plans import reports as R
from meterstone.schemas import COUNTERS, SESSIONS, USAGE

DAY = date(2026, 4, 22)  # a Wednesday


def usage_frame(spark, rows):
    """Rows of (session, agent, date, hour, model, tokens in, cost micro or None)."""
    full = [
        (s, a, d, h, "/p", m, 2, 1, i, 10, 5, 1, None if c is None else Decimal(c), False)
        for s, a, d, h, m, i, c in rows
    ]
    return spark.createDataFrame(full, USAGE)


def empty_sessions(spark):
    return spark.createDataFrame([], SESSIONS)


@pytest.mark.parametrize(
    "kind,as_of,offset,label,first,last",
    [
        ("today", DAY, 0, "Today", DAY, DAY),
        ("today", DAY, 1, "Yesterday", date(2026, 4, 21), date(2026, 4, 21)),
        ("today", DAY, 20, "Apr 2", date(2026, 4, 2), date(2026, 4, 2)),
        ("week", DAY, 0, "This week", date(2026, 4, 20), DAY),
        ("week", date(2026, 4, 20), 0, "This week", date(2026, 4, 20), date(2026, 4, 20)),
        ("week", DAY, 1, "Last week", date(2026, 4, 13), date(2026, 4, 19)),
        ("week", DAY, 3, "3 weeks ago", date(2026, 3, 30), date(2026, 4, 5)),
        ("month", DAY, 0, "This month", date(2026, 4, 1), DAY),
        ("month", date(2026, 1, 15), 1, "Last month", date(2025, 12, 1), date(2025, 12, 31)),
        ("month", date(2026, 1, 15), 14, "Nov 2024", date(2024, 11, 1), date(2024, 11, 30)),
    ],
)
def test_ranges(kind, as_of, offset, label, first, last):
    assert cal.named_range(kind, as_of, offset) == cal.DateRange(label, first, last)


def test_custom_ranges():
    assert cal.custom_range("2026-04-01: 2026-04-02 ").last == date(2026, 4, 2)
    assert cal.last_days(DAY, 14).first == date(2026, 4, 9)
    for bad in ("2026-04-02:2026-04-01", "2026-04-01", "x:y"):
        with pytest.raises(ValueError):
            cal.custom_range(bad)
    with pytest.raises(ValueError):
        cal.named_range("year", DAY)


@pytest.mark.parametrize(
    "first,weeks,ends",
    [
        (date(2027, 2, 1), 4, ("02-01 – 02-07", "02-22 – 02-28")),
        (date(2026, 4, 1), 5, ("04-01 – 04-05", "04-27 – 04-30")),
        (date(2026, 8, 1), 6, ("08-01 – 08-02", "08-31 – 08-31")),
    ],
)
def test_clipped_weeks(spark, first, weeks, ends):
    rows = cal.month_weeks_spine(spark, first).orderBy("position").collect()
    assert len(rows) == weeks and rows[-1].label == f"W{weeks}"
    assert (rows[0].sublabel, rows[-1].sublabel) == ends


def test_spines(spark):
    assert [r.label for r in cal.week_spine(spark, date(2026, 4, 20)).orderBy("position").collect()][
        ::6
    ] == ["Mon", "Sun"]
    months = cal.trend_spine(spark, "month", date(2026, 2, 28), 4).orderBy("position").collect()
    assert [r.label for r in months] == ["25-11", "25-12", "26-01", "26-02"]
    weeks = cal.trend_spine(spark, "week", DAY, 2).orderBy("position").collect()
    assert [r.label for r in weeks] == ["04-13", "04-20"]


def test_unknown_cost_in_reports(spark):
    usage = usage_frame(
        spark,
        [
            ("s1", "codex", DAY, 9, "nobody", 100, None),
            ("s2", "codex", DAY, 9, "gpt-5.5", 100, 35_000_000),
            ("s2", "codex", DAY, 10, "gpt-5.5", 100, 35_000_000),
            ("s2", "claude_code", DAY, 10, "", 100, 0),
        ],
    )
    total = R.totals(usage, DAY, DAY).first()
    assert (total.session_count, total.estimated_cost_usd, total.unknown_cost_count) == (3, 70.0, 1)
    models = {r.raw_model: r for r in R.by_agent_model(usage, DAY, DAY).collect()}
    assert models["nobody"].model == "Unknown" and models["nobody"].estimated_cost_usd == 0
    assert models["gpt-5.5"].estimated_cost_usd == 70.0 and models[""].model == "(unknown)"
    times = R.by_time_model(usage, DAY, DAY).collect()
    assert [r.raw_model for r in times] == ["gpt-5.5", "gpt-5.5", "nobody"]
    share = R.with_share(R.by_agent(usage, DAY, DAY), R.totals(usage, DAY, DAY))
    assert {r.share_pct for r in share.collect()} == {None}
    top = R.top_sessions(usage, empty_sessions(spark), DAY, DAY).collect()
    assert [(r.session_id, r.models) for r in top] == [("s2", "gpt-5.5"), ("s1", "Unknown")]
    nested = R.nested_breakdown(usage, DAY, DAY).collect()
    assert [m.raw_model for m in nested[0].models] == ["gpt-5.5", "nobody"]


def test_fold_keeps_unknown(spark):
    usage = usage_frame(
        spark,
        [("s", "codex", DAY, 1, f"gpt-5.{n}", 1, n * 100) for n in (1, 2, 3, 4)]
        + [("s", "codex", DAY, 1, "nobody", 1, None)],
    )
    rows = R.folded_models(usage, DAY, DAY, top=2).collect()
    assert [r.model for r in rows] == ["gpt-5.4", "gpt-5.3", "Unknown", "+2 more models"]
    assert rows[-1].estimated_cost_usd == pytest.approx(300 / 1e6)


def test_cross_day_session(spark):
    usage = usage_frame(
        spark,
        [
            ("s", "codex", date(2026, 4, 21), 23, "gpt-5.4", 100, 1),
            ("s", "codex", DAY, 1, "gpt-5.4", 200, 2),
        ],
    )
    both = R.totals(usage, date(2026, 4, 21), DAY).first()
    assert (both.session_count, both.input_tokens) == (1, 300)
    assert R.totals(usage, DAY, DAY).first().input_tokens == 200
    trend = R.daily_trend(usage, DAY, 1).collect()
    assert [(r.usage_date, r.input_tokens) for r in trend] == [(DAY, 200), (date(2026, 4, 21), 100)]
    heat = R.heatmap(usage, "week", DAY).collect()
    assert [r.session_count for r in heat] == [0, 1, 1, 0, 0, 0, 0]
    month = R.heatmap(usage, "month", DAY).collect()
    assert [r.session_count for r in month] == [0, 0, 0, 1, 0]


def test_peak(spark):
    ddl = "position int, cost double, unknown_cost_count long"
    known = spark.createDataFrame([(0, 1.0, 0), (1, 2.0, 0), (2, 2.0, 3)], ddl)
    assert R.peak_bucket(known).first().position == 1
    unknown = spark.createDataFrame([(0, 0.0, 0), (1, 0.0, 2), (2, 0.0, 3)], ddl)
    assert R.peak_bucket(unknown).first().position == 1


def test_no_data(spark):
    usage = usage_frame(spark, [])
    assert R.totals(usage, DAY, DAY).first().estimated_cost_usd == 0
    assert len(R.heatmap(usage, "today", DAY).collect()) == 24
    assert R.peak_bucket(R.heatmap(usage, "today", DAY)).first().label == "00"
    assert {r.delta_kind for r in R.summary(usage, DAY).collect()} == {None}
    assert R.active_periods(R.heatmap(usage, "today", DAY)).count() == 0


@pytest.mark.parametrize(
    "now,then,unknown,kind",
    [
        (0.0, 0.0, 0, None), (1.0, 0.0, 0, "new"), (1.0, 1.005, 0, "flat"), (100.5, 100.0, 0, "flat"),
        (2.0, 1.0, 0, "up"), (20.0, 1.0, 0, "up_10x"), (1.0, 2.0, 0, "down"), (1.0, 2.0, 1, None),
    ],
)
def test_delta(spark, now, then, unknown, kind):
    frame = spark.createDataFrame([(now, then, unknown, 0)], "c double, p double, u long, v long")
    row = frame.withColumns(R.delta_columns("c", "u", "p", "v")).first()
    assert row.delta_kind == kind


def test_intensity_is_half_even(spark):
    series = spark.createDataFrame(
        [(0, 0.0), (1, 2.5), (2, 3.5), (3, 10.0)], "position int, cost double"
    )
    levels = [r.level for r in R.with_intensity(series, 11).orderBy("position").collect()]
    assert levels == [0, 2, 4, 10]
    blank = R.with_intensity(series, 8, blank_zero=True).orderBy("position").collect()
    assert blank[0].level is None


def live_frame(spark, rows):
    names = [*COUNTERS, *[f"today_{c}" for c in COUNTERS]]
    ddl = "session_id string, agent_type string, model string, last_active string, " + ", ".join(
        f"{n} long" for n in names
    )
    return spark.createDataFrame(rows, ddl)


def test_live_merge(spark):
    usage = usage_frame(spark, [("same", "codex", DAY, 1, "gpt-5.4", 1000, 2500)])
    counters = (5, 2, 50, 195, 0, 0)
    absent = (None,) * 6
    live = live_frame(
        spark,
        [
            ("same", "claude_code", "claude-opus-4-7", "2026-04-22T11:58:00Z", *counters, *absent),
            ("idle", "codex", "gpt-5.4", "2026-04-22T11:59:00Z", 0, 0, 9, 0, 0, 0, *absent),
            ("same", "codex", "gpt-5.4", "2026-04-22T11:00:00Z", 9, 1, 1200, 30, 5, 1, *absent),
        ],
    )
    rows = {r.agent_type: r for r in L.overview_with_live(usage, live, DAY).collect()}
    assert (rows[None].session_count, rows[None].input_tokens) == (2, 1250)
    assert (rows["codex"].output_tokens, rows["codex"].message_count) == (30, 9)
    trend = L.trend_with_live(usage.filter("false"), live, DAY).collect()
    assert [(r.usage_date, r.session_count) for r in trend] == [(DAY, 2)]
    noon = datetime(2026, 4, 22, 12, 0)
    active = L.recently_active(live, noon).collect()
    assert [(r.session_id, r.agent_type) for r in active] == [("same", "claude_code")]
    assert L.active_count(live).first().active_count == 2


def test_full_report(spark):
    usage = usage_frame(spark, [("s", "codex", DAY, 1, "gpt-5.4", 1000, 2500)]).select(*COLUMNS)
    named = R.full_report(usage, DAY, "week")
    assert named.periodic.count() == 7 and named.previous.first().session_count == 0
    custom = R.full_report(usage, DAY, span=cal.custom_range("2026-04-01:2026-04-30"))
    assert custom.periodic is None and custom.by_project.first().project_path == "/p"
    assert BUILTIN.rule_count == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    path = str(tmp_path / "usage")
    usage_frame(spark, [("s", "codex", DAY, 1, "gpt-5.4", 1000, 2500)]).write.partitionBy(
        "usage_date"
    ).parquet(path)
    usage = spark.read.parquet(path)
    ranged = {
        "totals": R.totals(usage, DAY, DAY),
        "models": R.by_agent_model(usage, DAY, DAY),
        "projects": R.by_project(usage, DAY, DAY),
        "heat": R.heatmap(usage, "month", DAY),
        "periods": R.summary(usage, DAY),
        "trend": R.trend(usage, "week", DAY, 12),
    }
    for name, frame in ranged.items():
        text = plan(frame)
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
        assert "PartitionFilters: [isnotnull(usage_date" in text or "usage_date" in (
            text.split("PartitionFilters: [")[1].split("]")[0]
        ), name
    models = plan(ranged["models"])
    assert models.count("FileScan") == 1 and "project_path" not in models
    assert "TakeOrderedAndProject" in plan(ranged["projects"])
