import json

import pytest
from pyspark.sql import functions as F

from tickloom.operators import information, regimes
from tickloom.operators.factors import BY_NAME
from tickloom.plans import cycle, profiles, records
from tickloom.plans.policy import Selection
from tickloom.plans.views import Lane, TickLane
from tickloom.sources import lanes, ticks


def test_recent_factors_need_an_output(spark):
    rows = [("a", "t1", "/1"), ("a", "t5", ""), ("b", "t3", "/2"), ("b", "t2", "/3"), ("c", "t4", None), ("", "t9", "/4"), ("d", "t3", "/5")]
    runs = spark.createDataFrame(rows, "factor_name string, created_at string, run_dir string")
    assert [tuple(r) for r in records.recent_factors(runs).collect()] == [("b", "t3"), ("d", "t3"), ("a", "t1")]
    assert records.recent_factors(runs, 1).count() == 1 and records.recent_factors(runs.limit(0)).count() == 0


def test_best_comparison_prefers_the_same_runs(spark):
    columns = "left_experiment_id string, right_experiment_id string, left_factor string, right_factor string"
    wanted = spark.createDataFrame([("e1", "e2", "a", "b"), ("e3", "e4", "b", "a"), ("e5", "e6", "c", "d")], columns)
    logged = spark.createDataFrame(
        [("x1", "t1", "e2", "e1", "b", "a"), ("x2", "t2", "e1", "e2", "a", "b"), ("x3", "t9", "e7", "e8", "a", "b")], f"comparison_id string, created_at string, {columns}"
    )
    found = {r["left_experiment_id"]: (r["comparison_id"], r["match_level"]) for r in records.best_comparisons(wanted, logged).collect()}
    assert found == {"e1": ("x2", "experiment"), "e3": ("x3", "factor"), "e5": (None, None)}


def test_means_leave_nulls_out(spark):
    rows = spark.createDataFrame([("a", "b", 0.5, None), ("a", "b", None, 4), ("a", "b", 1.0, 2), ("a", "c", None, None)], "left_factor string, right_factor string, pearson_corr double, top_overlap_count long")
    assert {r["right_factor"]: (r["mean_pearson_corr"], r["mean_top_overlap"]) for r in records.pair_means(rows).collect()} == {"b": (0.75, 3.0), "c": (None, None)}


def test_edges_with_their_tests_and_matrix(spark):
    te = spark.createDataFrame([("a", "b", 0.5, 9, 3), ("b", "a", 0.2, 9, 3), ("a", "c", 0.9, 9, 3), ("c", "a", 0.1, 9, 3)], "source string, target string, te double, observations long, bins long")
    tests = spark.createDataFrame([("a", "b", 0.01, True), ("b", "a", 0.5, False), ("a", "c", 0.2, False)], "source string, target string, p_value double, significant boolean")
    edges = information.lead_edges(te, tests)
    assert [(r["source"], r["target"]) for r in information.ordered_by_edge(edges.where("source = 'a'")).collect()] == [("a", "b"), ("a", "c")]
    matrix = {r["source"]: (r["a"], r["b"], r["c"]) for r in information.lead_matrix(edges, ["a", "b", "c"]).collect()}
    assert matrix == {"a": (None, 0.5, 0.9), "b": (0.2, None, None), "c": (0.1, None, None)}


def test_artifacts_newest_first(spark, tmp_path):
    for run in ("score_1", "score_3", "score_2", "pre_9"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "s.json").write_text(json.dumps({"id": run}, indent=1))
    found = records.artifacts(spark, str(tmp_path), "score", "s.json").collect()
    assert [r["run"] for r in found] == ["score_3", "score_2", "score_1"] and json.loads(found[0]["payload"]) == {"id": "score_3"}


def test_profiles():
    record = {"family_name": "f", "mechanism": "m", "current_members": ["a", "b"], "current_best_variant": "b", "known_failure_modes": "weak_ic, redundant", "baseline_refs": ["x"], "extension_lane_eligibility": "default_lane_only"}
    family = profiles.family_profile("fam", record)
    assert family["mechanism_hypothesis"] == "m" and family["common_variants"] == ["a", "b"] and family["current_best_variants"] == ["b"]
    assert family["known_failure_patterns"] == ["weak_ic", "redundant"] and family["regime_sensitivity"] == ["unknown"] and family["redundancy_pattern"] == "not_recorded"
    card = {"years": ["2025", "2026", "2020"], "timing": {"mode": "fine_ok"}, "holding_horizon": "1d", "horizon_scope": "1d", "failure_modes": ["low_coverage", "weak_ic"], "baseline_refs": ["x", "y"], "semantics": {"TradeDir": "unused"}}
    factor = profiles.factor_profile(BY_NAME["close_vwap_gap_intensity"], card, family)
    assert factor["required_year_grade"] == ["coarse_only", "fine_ok"] and factor["evaluation_horizons"] == ["1d"] and factor["baseline_comparators"] == ["x", "y"]
    assert factor["known_failure_modes"] == ["low_coverage", "weak_ic", "redundant"] and factor["required_data_lane"] == "daily_agg"
    assert factor["supports_default_lane"] and not factor["supports_extension_lane"] and not factor["contains_caveat_fields"] and factor["family_expand_direction"] == "monitor"
    other = profiles.factor_profile(BY_NAME["trade_dir_buy_ratio"], {}, {}, source="peers")
    assert other["contains_caveat_fields"] and other["requires_cross_security_mapping"] and not other["supports_default_lane"] and other["supports_extension_lane"] and other["required_data_lane"] == "verified_raw"


def test_registry_and_submissions(tmp_path):
    path = tmp_path / "r.toml"
    path.write_text('default_baselines = ["a"]\n[groups.one]\nfactors = ["a", "b"]\n[groups.two]\nfactors = ["b", "c"]\n')
    registry = profiles.baseline_registry(str(path))
    assert registry["default_baselines"] == ["a"] and [profiles.baseline_group(f, registry) for f in "bcz"] == ["one", "two", ""]
    assert profiles.baseline_group("a", profiles.baseline_registry()) == ""
    assert profiles.submission_errors({"years": ["2026"], "timing_mode": "fine_ok"}) == []
    assert len(profiles.submission_errors({"years": ["1999"], "timing_mode": "exact"})) == 2
    chosen = Selection.of({"selection": {"min_abs_rank_ic_keep": 0.1, "max_mean_abs_peer_corr": "0.2"}})
    assert (chosen.ic_keep, chosen.most_peer_corr, chosen.ic_review) == (0.1, 0.2, 0.02)


@pytest.fixture(scope="module")
def root(spark, sf, tmp_path_factory):
    """Tick tables of lane E's first days, with whole-second ties broken by the row as in the lane."""
    path = str(tmp_path_factory.mktemp("lane"))
    frame = lanes.event_ticks(spark, sf).where("date < '2024-01-12'").withColumn("source_file", F.concat(F.lit("trade/"), "instrument_key", F.lit(".csv"))).drop("instrument_key", "ts").withColumn("year", F.year("date"))
    frame.drop("OrderId", "is_order").write.partitionBy("year", "date").parquet(f"{path}/verified_trades")
    frame.where("is_order").drop("is_order").write.partitionBy("year", "date").parquet(f"{path}/verified_orders")
    return path


def test_tick_lane_equals_lane_with_and_without_its_cache(spark, sf, root, tmp_path):
    universe = lanes.event_universe(spark, sf)
    lane, bare = Lane(spark, sf), TickLane(spark, root, [2024], universe)
    days = bare.days()
    assert days and days[-1] < "2024-01-12" and not bare.cached("verified_trades_daily")
    assert bare.regimes().columns == ["date", "year_grade"] and "market_turnover_regime" not in regimes.slice_summary(bare.per_date(), bare.regimes()).columns
    rows = lambda frame: sorted(map(tuple, frame.where(F.col("date").isin(days)).select("date", "instrument_key", "order_event_count", "unique_order_ids", F.round("churn_ratio", 9)).collect()))
    assert rows(bare.orders_daily()) == rows(lane.orders_daily())
    levels = lambda x: sorted(map(tuple, x.levels().where(F.col("date").isin(days)).select("date", "instrument_key", F.round("avg_trade_notional_bias", 8), F.round("session_activity_shift", 8), F.round("order_trade_event_ratio", 8)).collect()), key=str)
    assert levels(bare) == levels(lane)
    for table, frame in (("verified_trades_daily", ticks.load(spark, root, "verified_trades", days)), ("verified_orders_daily", ticks.load(spark, root, "verified_orders", days))):
        ticks.write_daily(spark, root, table, frame)
    held = TickLane(spark, root, [2024], universe)
    assert held.cached("verified_trades_daily") and levels(held) == levels(lane)
    cached = TickLane(spark, root, [2024], universe)
    assert cached.trades_daily().count() > 0 and "ticks" not in cached._held and "entropy_quantile" in held.regimes().columns
    summary = cycle.export_labels(held, str(tmp_path), 2024)
    assert summary["row_count"] == held.labels().count() > 0 and summary["dates"] == days[:-1]
    assert json.loads(spark.read.text(f"{tmp_path}/{summary['export_id']}/labels_summary").first()["value"])["row_count"] == summary["row_count"]
