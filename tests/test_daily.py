import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.functions import columns
from tickloom.operators import daily, dates, factors, shape
from tickloom.operators.universe import members, restrict

D = dt.date(2026, 3, 13)
P = dt.date(2026, 3, 12)
TRADES = "date date, instrument_key string, Time int, row_num_in_file long, Price double, Volume long, TradeDir int"


def trades(spark, rows):
    return spark.createDataFrame(rows, TRADES)


def test_trades_daily(spark):
    rows = [(D, "00001", 34200, 1, 10.0, 100, 1), (D, "00001", 34260, 2, 11.0, 200, 2), (D, "00002", 34320, 1, 20.0, 300, 1), (D, "00003", 1, 1, 5.0, 0, 0)]
    out = {r["instrument_key"]: r for r in daily.trades_daily(trades(spark, rows)).collect()}
    one = out["00001"]
    assert set(out) == {"00001", "00002"}
    assert (one["trade_count"], one["turnover"], one["share_volume"], one["avg_trade_size"], one["close_like_price"]) == (2, 3200.0, 300, 150.0, 11.0)
    assert one["vwap"] == pytest.approx(3200 / 300)
    assert daily.trades_daily(trades(spark, rows), positive_volume=False).count() == 3


def test_orders_daily(spark):
    rows = [(D, "00001", 1, 10.0, 100), (D, "00001", 1, 11.0, 200), (D, "00002", 2, 20.0, 300)]
    frame = spark.createDataFrame(rows, "date date, instrument_key string, OrderId long, Price double, Volume long")
    one = daily.orders_daily(frame).where("instrument_key = '00001'").first()
    assert (one["order_event_count"], one["unique_order_ids"], one["total_order_notional"], one["churn_ratio"]) == (2, 1, 3200.0, 2.0)


def test_universe_keeps_rows_and_columns(spark):
    universe = spark.createDataFrame([("00001", True), ("00002", False), ("00003", True)], "instrument_key string, stock_research_candidate boolean")
    assert sorted(r[0] for r in members(universe).collect()) == ["00001", "00003"]
    frame = spark.createDataFrame([(D, "00001"), (D, "00002"), (D, "00001")], "date date, instrument_key string")
    out = restrict(frame, universe)
    assert sorted(out.columns) == sorted(frame.columns) and out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    with pytest.raises(ValueError):
        restrict(frame, universe, "")


def test_instrument_key(spark):
    frame = spark.createDataFrame([("trade/00001.csv",), ("x",)], "f string")
    assert [r[0] for r in frame.select(columns.instrument_key(F.col("f"))).collect()] == ["00001", None]


def test_gini_and_burstiness(spark):
    rows = [(D, "a", t, i, float(v), 1, 0) for i, (t, v) in enumerate([(0, 1), (10, 2), (20, 3), (60, 10)])] + [(D, "b", 5, 1, 3.0, 1, 0)]
    got = {r["instrument_key"]: r["trade_size_gini"] for r in shape.gini(trades(spark, rows)).collect()}
    assert got["b"] == 0.0 and got["a"] == pytest.approx((-3 * 1 - 2 + 3 + 30) / (4 * 16))
    cv = {r["instrument_key"]: r["interval_cv"] for r in shape.burstiness(trades(spark, rows)).collect()}
    gaps = [10, 10, 40]
    mean = sum(gaps) / 3
    assert cv["b"] == 0.0 and cv["a"] == pytest.approx((sum((g - mean) ** 2 for g in gaps) / 2) ** 0.5 / mean)


def test_raw_statistics_are_the_separate_ones(spark, sf):
    from tickloom.sources import lanes

    ticks = lanes.event_trades(spark, sf)
    one = shape.raw_statistics(ticks)
    apart = daily.raw_daily(ticks).join(shape.gini(ticks), daily.KEY, "left").join(shape.burstiness(ticks), daily.KEY, "left").select(*one.columns)
    rows = lambda df: sorted(tuple(round(v, 8) if isinstance(v, float) else str(v) for v in r) for r in df.collect())
    assert rows(one) == rows(apart)


def test_calendar_stays_within_years(spark):
    days = spark.createDataFrame([(dt.date(2025, 12, 30),), (dt.date(2025, 12, 31),), (dt.date(2026, 1, 2),)], "date date")
    rows = {r["date"]: r for r in dates.stepped(days).collect()}
    assert rows[dt.date(2026, 1, 2)]["previous_date"] is None and rows[dt.date(2025, 12, 31)]["next_date"] is None
    assert rows[dt.date(2025, 12, 31)]["previous_date"] == dt.date(2025, 12, 30)
    assert {r["date"]: r["previous_date"] for r in dates.previous_requested(days).collect()}[dt.date(2026, 1, 2)] == dt.date(2025, 12, 31)


def test_levels_and_change(spark):
    schema = "date date, instrument_key string, trade_count long, turnover double, close_like_price double, vwap double, instrument_key_source string"
    t = spark.createDataFrame([(D, "a", 10, 100.0, 11.0, 10.0, "s"), (P, "a", 10, 100.0, 10.0, 10.0, "s"), (D, "b", 10, 100.0, 10.1, 10.0, "s")], schema)
    o = spark.createDataFrame([(D, "a", 8, 2, 50.0, 4.0, "s"), (P, "a", 4, 4, 50.0, 1.0, "s"), (D, "b", 1, 1, 5.0, 1.0, "s")], "date date, instrument_key string, order_event_count long, unique_order_ids long, total_order_notional double, churn_ratio double, instrument_key_source string")
    spec = factors.BY_NAME["close_vwap_churn_interaction"]
    level = factors.levels(t, o, specs=(spec,))
    rows = {(r["date"], r["instrument_key"]): r[spec.name] for r in level.collect()}
    import math

    assert rows[D, "a"] == pytest.approx(0.1 * math.log(5)) and rows[D, "b"] == pytest.approx(0.01 * math.log(2))
    steps = dates.stepped(dates.calendar(t))
    change = factors.one_day_change(level, steps, [spec.name]).collect()
    assert len(change) == 1 and change[0][spec.change] == pytest.approx(0.1 * math.log(5))
    assert factors.one_day_change(level.where(F.col("date") == P), dates.stepped(dates.calendar(t.where(F.col("date") == P))), [spec.name]).count() == 0
    joined = daily.joined_daily(t, o)
    assert joined.columns.count("instrument_key_source") == 1 and joined.count() == 3


def test_catalogue_has_28_factors():
    assert len(factors.factor_names()) == 28 == len(set(factors.factor_names()))


def test_columns(spark):
    one = spark.range(1)
    n = lambda c: one.select(c.alias("x")).first()["x"]
    assert n(columns.ratio(F.lit(1), F.lit(0))) is None
    assert [n(columns.adaptive_bins(F.lit(x))) for x in (1, 2, 3, 10, 120)] == [1, 2, 2, 5, 8]
    assert [n(columns.effective_bins(F.lit(x), 4)) for x in (1, 2, 7, 100)] == [1, 2, 3, 4]
    assert [n(columns.frequency_bin(F.lit(i), F.lit(4), F.lit(10))) for i in range(10)] == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3]
    assert n(columns.slug(F.lit("Ab c--D "))) == "ab_c_d"
    assert n(columns.listed(F.lit(" a, b,,a "))) == ["a", "b"]
    with pytest.raises(ValueError):
        columns.equal_weight()
