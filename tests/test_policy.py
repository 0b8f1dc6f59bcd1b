import pytest
from pyspark.sql import functions as F

from tickloom.operators.universe import UNIVERSE_VERSION
from tickloom.plans import policy
from tickloom.plans.cards import evaluate_card

STATS = "factor string, evaluated_count long, mean_rank_ic double, mean_abs_rank_ic double, mean_nmi double, mean_nmi_ic_gap double, mean_coverage_ratio double, sign_consistency double, mi_significant_date_ratio double"


def test_gate(spark):
    rows = [("p", 3, -.1, .1, .02, -.05, .9, 1.0, None), ("m", 3, .05, .05, .006, .0, .8, .6, .4), ("f", 2, .05, .05, .006, .03, .8, .6, .4)]
    got = {r["factor"]: r for r in policy.gate_decision(spark.createDataFrame(rows, STATS)).collect()}
    assert [got[k]["decision"] for k in "pmf"] == ["pass", "monitor", "fail"]
    assert got["p"]["direction_hint"] == "inverse_candidate" and got["p"]["signal_shape_hint"] == "mostly_monotonic"
    assert got["f"]["reasons"] == "below_monitor:evaluated_date_count"
    assert got["m"]["reasons"].startswith("below_pass:mean_abs_rank_ic,below_pass:mean_normalized_mutual_info")


BOARD = "factor string, mean_rank_ic double, mean_abs_rank_ic double, mean_nmi double, mean_top_bottom_spread double, mean_coverage_ratio double, mi_significant_date_ratio double, mean_mi_p_value double, mean_abs_baseline_corr double, sign_consistency double, entropy_values array<double>, contains_caveat_fields boolean, target_instrument_universe string, source_instrument_universe string, universe_filter_version string"
TAIL = (False, "stock_research_candidate", "target_only", UNIVERSE_VERSION)


def test_universes_and_other_securities(spark):
    spec = "factor string, target_instrument_universe string, source_instrument_universe string, universe_filter_version string, contains_caveat_fields boolean, contains_cross_security_source boolean"
    metrics = ("mean_abs_rank_ic", "mean_rank_ic", "mean_top_bottom_spread", "mean_coverage_ratio", "mi_significant_date_ratio", "mean_mi_p_value", "mean_nmi", "sign_consistency", "mean_abs_baseline_corr")
    rows = [("fine", "stock_research_candidate", "target_only", "", None, None), ("absent", None, "target_only", "", False, False), ("source", "stock_research_candidate", None, "", False, False), ("crossed", "stock_research_candidate", "target_only", "", False, True)]
    board = spark.createDataFrame(rows, spec).select("*", *[F.lit(None).cast("double").alias(m) for m in metrics], F.lit(None).cast("array<double>").alias("entropy_values"))
    got = {r["factor"]: (r["primary_reject_reason"], r["secondary_reject_reasons"]) for r in policy.reject_reasons(board, backtest=False).collect()}
    assert got == {"fine": ("none", ""), "absent": ("universe_mismatch", ""), "source": ("universe_mismatch", "caveat_dependence_too_high"), "crossed": ("caveat_dependence_too_high", "")}


def test_recommendations_and_reasons(spark):
    rows = [(None, None, None, 0.0), (0.5, -0.5, None, 0.0), (0.5, 0.5, None, 0.0), (0.0, 0.0, 0.9, 0.0), (0.5, 0.5, None, 1.0), (0.0, 0.0, 0.0, 0.0)]
    board = spark.createDataFrame(rows, "mean_abs_rank_ic double, mean_rank_ic double, mean_nmi double, mean_abs_peer_corr double")
    got = [(r["recommendation"], r["recommendation_reason"]) for r in policy.recommendation(board.coalesce(1)).collect()]
    assert got == [("missing_pre_eval", "no_evaluation"), ("consider_inverse", "ic_above_keep_and_negative"), ("keep_candidate", "ic_or_nmi_above_keep"), ("keep_candidate", "nmi_above_keep"), ("keep_but_crowded", "above_keep_and_correlated_with_peers"), ("discard_candidate", "below_review")]


def test_reject_reasons(spark):
    rows = [
        ("inverse", -.08, .08, .03, -.01, 1.0, 1.0, .01, .2, 1.0, [.1, .09], *TAIL),
        ("ready", .08, .08, .03, .01, 1.0, 1.0, .01, .2, 1.0, [.1, .09], *TAIL),
        ("weak", .01, .01, .001, .01, .5, .1, .5, .9, .5, [.2, .05], *TAIL),
        ("narrow", .08, .08, .03, .01, 1.0, 1.0, .01, None, 1.0, [.2, .05, None], *TAIL),
    ]
    out = {r["factor"]: r for r in policy.reject_reasons(spark.createDataFrame(rows, BOARD), backtest=False).collect()}
    assert (out["inverse"]["primary_reject_reason"], out["inverse"]["promotion_readiness"]) == ("inverse_candidate_only", "watch")
    assert (out["ready"]["primary_reject_reason"], out["ready"]["promotion_readiness"]) == ("none", "ready")
    assert out["weak"]["primary_reject_reason"] == "low_coverage" and out["weak"]["promotion_readiness"] == "reject"
    assert out["weak"]["secondary_reject_reasons"].split(",") == ["insufficient_significance", "weak_ic", "weak_nmi", "unstable_across_dates", "narrow_entropy_regime_only", "high_redundancy_to_baseline"]
    assert out["narrow"]["primary_reject_reason"] == "narrow_entropy_regime_only"


def test_hints(spark):
    rows = [(None, None, "missing_pre_eval"), (.1, None, "missing_baseline_compare"), (.06, .3, "potential_incremental"), (.01, .9, "likely_redundant"), (.01, .7, "review_overlap"), (.01, .1, "mixed")]
    frame = spark.createDataFrame(rows, "ic double, corr double, want string")
    for r in frame.select("want", policy.incremental_hint(F.lit("challenger"), F.col("ic"), F.col("corr")).alias("got")).collect():
        assert r["got"] == r["want"]
    assert policy.next_steps({}, 0) == ["no_candidates"] and policy.next_steps({"weak_ic": 3}, 6) == ["retire_weak_variants"]


CARD = """+++
card_id = "c"
name = "n"
owner = "o"
status = "draft"
years = ["2026"]
universe = "phase_a_core"
target_instrument_universe = "stock_research_candidate"
source_instrument_universe = "target_only"
contains_cross_security_source = false
universe_filter_version = "stock_research_candidate_filter_v1"
holding_horizon = "1d"
research_modules = ["order_trade_coverage_profile"]
required_fields = ["Time", "Price", "Volume"]
hypothesis = "h"
mechanism = "m"
info_boundary = "i"
failure_modes = ["f"]
expected_risks = ["r"]
[timing]
mode = "fine_ok"
uses_precise_lag = false
uses_strict_ordering = false
uses_queue_semantics = false
[semantics]
TradeDir = "unused"
BrokerNo = "unused"
OrderType = "unused"
Level = "unused"
VolumePre = "unused"
Type = "unused"
Ext = "unused"
+++
text
"""


@pytest.mark.parametrize(
    ("change", "decision"),
    [
        (("", ""), "pass"),
        (('years = ["2026"]', 'years = ["2025"]'), "fail"),
        (("uses_precise_lag = false", "uses_precise_lag = true"), "allow_with_caveat"),
        (("uses_queue_semantics = false", "uses_queue_semantics = true"), "fail"),
        (('"Time", "Price"', '"Time", "Level"'), "fail"),
        (('"Time", "Price"', '"Time", "OrderType"'), "fail"),
        (('TradeDir = "unused"', 'TradeDir = "vendor_aggressor_proxy_only"'), "fail"),
        (('"order_trade_coverage_profile"', '"queue_position_or_depletion"'), "fail"),
        (('"order_trade_coverage_profile"', '"nobody_knows"'), "fail"),
        (('target_instrument_universe = "stock_research_candidate"', 'instrument_universe = "stock_research_candidate"'), "pass"),
        (("contains_cross_security_source = false", "contains_cross_security_source = true"), "fail"),
        (("+++\ncard_id", "card_id"), "fail"),
    ],
)
def test_cards(change, decision):
    assert evaluate_card(CARD.replace(*change, 1)).decision == decision


def test_caveat_lane_card():
    card = CARD.replace('TradeDir = "unused"', 'TradeDir = "vendor_aggressor_proxy_only"').replace("phase_a_core", "phase_a_caveat_lane").replace('"Time", "Price"', '"Dir", "Price"')
    result = evaluate_card(card)
    assert result.decision == "allow_with_caveat" and result.manual_review_required
