"""Date ranges, score output, board order, metric names."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tickloom.operators import dates, information
from tickloom.plans import policy
from tickloom.sources import ticks


def test_date_ranges_have_both_ends(spark):
    days = spark.createDataFrame([(dt.date(2026, 1, d),) for d in range(1, 8)], "date date")
    picked = lambda *ends: [r["date"].day for r in dates.between(days, *ends).orderBy("date").collect()]
    assert picked("2026-01-03", "2026-01-05") == [3, 4, 5] and picked("2026-01-06") == [6, 7] and picked(None, "2026-01-02") == [1, 2] and picked() == list(range(1, 8))


def test_steps_of_several_dates(spark):
    days = spark.createDataFrame([(dt.date(2025, 12, 31),), *((dt.date(2026, 1, d),) for d in range(1, 6))], "date date")
    rows = {r["date"]: (r["previous_date"], r["next_date"]) for r in dates.stepped(days, 2).collect()}
    assert rows[dt.date(2026, 1, 3)] == (dt.date(2026, 1, 1), dt.date(2026, 1, 5)) and rows[dt.date(2026, 1, 2)] == (None, dt.date(2026, 1, 4)) and rows[dt.date(2025, 12, 31)] == (None, None)
    with pytest.raises(ValueError):
        dates.stepped(days, 0)


def test_scores_are_written_in_order_with_a_preview(spark, tmp_path):
    rows = [(dt.date(2026, 1, 2), "b", 1.0), (dt.date(2026, 1, 1), "a", 1.0), (dt.date(2026, 1, 2), "a", 3.0), (dt.date(2026, 1, 2), "c", 1.0)]
    frame = spark.createDataFrame(rows, "date date, instrument_key string, score double").repartition(3)
    shown = json.loads(ticks.write_scores(frame, str(tmp_path / "out"), preview=3))
    assert [(r["date"], r["instrument_key"]) for r in shown] == [("2026-01-01", "a"), ("2026-01-02", "a"), ("2026-01-02", "b")]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_board_order(spark):
    schema = "factor string, mean_abs_rank_ic double, mean_nmi double, mean_abs_baseline_corr double, mean_abs_peer_corr double, distinct_instruments long"
    rows = [("none", None, None, None, 0.0, 9), ("low", 0.1, 0.5, 0.1, 0.1, 9), ("top", 0.2, 0.1, 0.9, 0.9, 1), ("more_nmi", 0.1, 0.6, 0.9, 0.9, 1), ("crowded", 0.1, 0.5, 0.1, 0.2, 9), ("fewer", 0.1, 0.5, 0.1, 0.1, 8), ("like_base", 0.1, 0.5, 0.2, 0.0, 9), ("only_nmi", None, 0.9, None, 0.0, 9)]
    assert [r["factor"] for r in policy.board_order(spark.createDataFrame(rows, schema)).collect()] == ["top", "more_nmi", "low", "fewer", "crowded", "like_base", "only_nmi", "none"]


def test_a_metric_may_have_another_name(spark):
    frame = spark.createDataFrame([("a", dt.date(2026, 1, 1), None, 0.5), ("a", dt.date(2026, 1, 2), 0.1, 0.7), ("b", dt.date(2026, 1, 1), None, None)], "factor string, date date, mean_nmi double, nmi double")
    assert sorted(r["value"] for r in information.metric_series(frame, "mean_nmi", "nmi").collect()) == [0.1, 0.5]
    assert information.metric_series(frame, "mean_nmi").count() == 1


def test_ranked_edges(spark):
    tests = spark.createDataFrame([("a", "b", 0.5, 0.01, True), ("b", "a", 0.2, 0.5, False), ("a", "c", 0.9, 0.2, False), ("c", "a", 0.1, 0.9, False)], "source string, target string, observed double, p_value double, significant boolean")
    found = information.ranked_edges(tests).orderBy("rank").collect()
    assert [(r["source"], r["target"]) for r in found] == [("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")]
    assert found[0]["reverse_p_value"] == 0.5 and found[0]["lead_gap"] == pytest.approx(0.3) and not found[0]["reverse_significant"]
    assert information.ranked_edges(tests.where(F.lit(False))).count() == 0
