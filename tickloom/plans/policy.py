"""Decision rules over one row a factor, as column expressions.

``stats`` frames carry the means of evaluate.summary with sign counts joined in. Thresholds are fixed values of the policies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.factors import SPECS
from tickloom.operators.universe import UNIVERSE_VERSION

#: What a factor must reach, metric by metric, to pass or to be monitored.
GATE_PASS = {"evaluated_count": 3, "mean_abs_rank_ic": 0.08, "mean_nmi": 0.015, "mean_coverage_ratio": 0.85, "sign_consistency": 2 / 3, "mi_significant_date_ratio": 0.50}
GATE_MONITOR = {"evaluated_count": 3, "mean_abs_rank_ic": 0.04, "mean_nmi": 0.005, "mean_coverage_ratio": 0.75, "sign_consistency": 0.50, "mi_significant_date_ratio": 1 / 3}
#: Names that reasons use for metrics.
GATE_NAMES = {"evaluated_count": "evaluated_date_count", "mean_nmi": "mean_normalized_mutual_info"}
#: A metric that may be absent.
GATE_OPTIONAL = "mi_significant_date_ratio"

#: Reject reasons, hard ones first, and their thresholds.
HARD_REASONS = ("universe_mismatch", "caveat_dependence_too_high", "low_coverage", "insufficient_significance", "weak_ic", "weak_nmi")
SOFT_REASONS = ("inverse_candidate_only", "unstable_across_dates", "narrow_entropy_regime_only", "high_redundancy_to_baseline")
TRIAGE = {
    "min_coverage_ratio": 0.85, "min_mean_abs_rank_ic": 0.04, "min_mean_nmi": 0.005, "min_sign_consistency": 0.6, "min_mi_significant_date_ratio": 0.50, "max_p_value": 0.05,
    "max_baseline_redundancy": 0.60, "min_backtest_hit_rate": 0.55, "min_backtest_spread_return": 0.0, "max_backtest_turnover_proxy": 0.75, "min_backtest_stability_proxy": 0.6, "narrow_entropy_dispersion": 0.05,
}


@dataclass(frozen=True)
class Selection:
    """Thresholds of a research cycle's recommendations."""

    ic_keep: float = 0.05
    ic_review: float = 0.02
    nmi_keep: float = 0.03
    nmi_review: float = 0.015
    most_peer_corr: float = 0.50

    @classmethod
    def of(cls, config: dict) -> Selection:
        """From a cycle configuration's ``selection``; what it lacks keeps its default."""
        held = config.get("selection", {})
        return cls(**{field: float(held[name]) for field, name in SELECTION_NAMES.items() if name in held})


#: How a cycle configuration calls the thresholds.
SELECTION_NAMES = {
    "ic_keep": "min_abs_rank_ic_keep", "ic_review": "min_abs_rank_ic_review", "nmi_keep": "min_normalized_mi_keep", "nmi_review": "min_normalized_mi_review", "most_peer_corr": "max_mean_abs_peer_corr",
}


def _failed(limits: dict[str, float]) -> Column:
    """Names of the metrics below their limits, in order."""
    tests = []
    for metric, limit in limits.items():
        below = F.col(metric) < F.lit(float(limit))
        missing = F.lit(False) if metric == GATE_OPTIONAL else F.col(metric).isNull()
        tests.append(F.when(missing | F.coalesce(below, F.lit(False)), F.lit(GATE_NAMES.get(metric, metric))))
    return F.filter(F.array(*tests), lambda m: m.isNotNull())


def gate_decision(stats: DataFrame) -> DataFrame:
    """factor, decision (pass, monitor, fail), reasons (comma-joined), shape and direction hints."""
    tried = stats.withColumns({"__pass": _failed(GATE_PASS), "__monitor": _failed(GATE_MONITOR)})
    passed, watched = F.size("__pass") == 0, F.size("__monitor") == 0
    gap, ic = F.col("mean_nmi_ic_gap"), F.col("mean_rank_ic")
    prefixed = lambda c, p: F.array_join(F.transform(c, lambda m: F.concat(F.lit(p), m)), ",")
    return tried.select(
        "factor",
        F.when(passed, "pass").when(watched, "monitor").otherwise("fail").alias("decision"),
        F.when(passed, "stable_statistical_relationship").when(watched, prefixed("__pass", "below_pass:")).otherwise(prefixed("__monitor", "below_monitor:")).alias("reasons"),
        F.when(gap.isNull(), "undetermined").when(gap > 0.02, "nonlinear_candidate").when(gap < -0.02, "mostly_monotonic").otherwise("mixed_or_linear").alias("signal_shape_hint"),
        F.when(ic.isNull() | (ic == 0), "undetermined").when(ic > 0, "as_is_candidate").otherwise("inverse_candidate").alias("direction_hint"),
    )


def incremental_hint(role: Column, ic: Column, corr: Column) -> Column:
    return (
        F.when(role == "baseline_anchor", "baseline_anchor").when(ic.isNull(), "missing_pre_eval").when(corr.isNull(), "missing_baseline_compare")
        .when((ic >= 0.05) & (corr <= 0.35), "potential_incremental").when(corr >= 0.85, "likely_redundant").when(corr >= 0.60, "review_overlap").otherwise("mixed")
    )


def narrow_entropy(values: Column) -> Column:
    """Whether one entropy slice alone is strong: the best clears the floor, leads by the dispersion, and no other has half of it."""
    high = F.sort_array(F.filter(values, lambda v: v.isNotNull()), asc=False)
    best, second = F.try_element_at(high, F.lit(1)), F.try_element_at(high, F.lit(2))
    return (F.size(high) >= 2) & (best >= TRIAGE["min_mean_abs_rank_ic"]) & (best - second >= TRIAGE["narrow_entropy_dispersion"]) & (second < best * 0.5)


def inverse_only() -> Column:
    return (F.col("mean_abs_rank_ic") >= TRIAGE["min_mean_abs_rank_ic"]) & (F.col("mean_rank_ic") < 0) & (F.col("mean_top_bottom_spread") < 0)


def reject_reasons(board: DataFrame, backtest: bool = True) -> DataFrame:
    """Adds primary_reject_reason, secondary_reject_reasons (comma-joined), promotion_readiness.

    ``board`` has the evaluation's means, sign_consistency, mean_abs_baseline_corr, entropy_values (array), the universe's columns
    and, with ``backtest``, the backtest's. Absent metrics raise no reason; an absent universe is no match, since what a row is about must
    be stated. The flags ``contains_caveat_fields`` and ``contains_cross_security_source`` count as not set where they are absent.
    """
    t = TRIAGE
    c = F.col
    yes = lambda test: F.coalesce(test, F.lit(False))
    flag = lambda name: yes(c(name)) if name in board.columns else F.lit(False)
    beside = ~c("source_instrument_universe").eqNullSafe(F.lit("target_only"))
    weak = yes(c("mean_abs_rank_ic") < t["min_mean_abs_rank_ic"])
    tests = {
        "universe_mismatch": ~c("target_instrument_universe").eqNullSafe(F.lit("stock_research_candidate")) | beside | yes((c("universe_filter_version") != "") & (c("universe_filter_version") != UNIVERSE_VERSION)),
        "caveat_dependence_too_high": flag("contains_caveat_fields") | flag("contains_cross_security_source") | beside,
        "low_coverage": yes(c("mean_coverage_ratio") < t["min_coverage_ratio"]),
        "insufficient_significance": yes(c("mi_significant_date_ratio") < t["min_mi_significant_date_ratio"]) | yes(c("mean_mi_p_value") > t["max_p_value"]),
        "weak_ic": weak,
        "weak_nmi": yes(c("mean_nmi") < t["min_mean_nmi"]),
        "inverse_candidate_only": ~weak & yes(inverse_only()),
        "unstable_across_dates": yes(c("sign_consistency") < t["min_sign_consistency"]),
        "narrow_entropy_regime_only": yes(narrow_entropy(c("entropy_values"))),
        "high_redundancy_to_baseline": yes(c("mean_abs_baseline_corr") >= t["max_baseline_redundancy"]),
    }
    if backtest:
        tests["unstable_across_dates"] |= yes(c("hit_rate") < t["min_backtest_hit_rate"]) | yes(c("stability_proxy") < t["min_backtest_stability_proxy"])
        tests["weak_ic"] |= yes(c("spread_return") <= t["min_backtest_spread_return"])
        tests["high_redundancy_to_baseline"] |= yes(c("turnover_proxy") > t["max_backtest_turnover_proxy"])
    listed = lambda names: F.filter(F.array(*[F.when(tests[n], F.lit(n)) for n in names]), lambda r: r.isNotNull())
    out = board.withColumns({"__hard": listed(HARD_REASONS), "__soft": listed(SOFT_REASONS)}).withColumn("__all", F.concat("__hard", "__soft"))
    return out.withColumns({
        "primary_reject_reason": F.coalesce(F.try_element_at("__all", F.lit(1)), F.lit("none")),
        "secondary_reject_reasons": F.array_join(F.slice("__all", F.lit(2), F.greatest(F.size("__all") - 1, F.lit(0))), ","),
        "promotion_readiness": F.when(F.size("__hard") > 0, "reject").when(F.size("__soft") > 0, "watch").otherwise("ready"),
    }).drop("__hard", "__soft", "__all")


def reason_histogram(triaged: DataFrame) -> DataFrame:
    """How often each reason was given, first or later; the commonest comes first, ties by name."""
    every = F.concat(F.array("primary_reject_reason"), F.split("secondary_reject_reasons", ","))
    return triaged.select(F.explode(every).alias("reason")).where((F.col("reason") != "none") & (F.col("reason") != "")).groupBy("reason").count().orderBy(F.desc("count"), "reason")


def family_summary(triaged: DataFrame) -> DataFrame:
    """By family: counts by readiness, shortlist rate, means of redundancy, entropy dispersion and significance, and the commonest first reason."""
    ready = F.col("promotion_readiness")
    out = triaged.groupBy("family").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.count_if(ready == "ready").alias("shortlisted_count"), F.count_if(ready == "watch").alias("watch_count"), F.count_if(ready == "reject").alias("rejected_count"),
        F.avg("mean_abs_baseline_corr").alias("average_redundancy_profile"), F.avg("entropy_regime_dispersion").alias("entropy_regime_sensitivity"), F.avg("mi_significant_date_ratio").alias("significance_quality"),
    )
    reasons = triaged.where(F.col("primary_reject_reason") != "none").groupBy("family", "primary_reject_reason").count()
    modes = reasons.groupBy("family").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "primary_reject_reason", F.col("count").cast("string")))), ",").alias("common_failure_modes"))
    return out.withColumn("shortlist_rate", F.col("shortlisted_count") / F.col("candidate_count")).join(modes, "family", "left").withColumn("common_failure_modes", F.coalesce("common_failure_modes", F.lit("")))


def recommendation(board: DataFrame, policy: Selection = Selection()) -> DataFrame:
    """Adds the cycle's recommendation, one of six actions, and recommendation_reason, what led to it."""
    ic, signed, nmi, crowd = F.col("mean_abs_rank_ic"), F.col("mean_rank_ic"), F.col("mean_nmi"), F.col("mean_abs_peer_corr")
    at = lambda c, x: F.coalesce(c >= x, F.lit(False))
    strong = at(ic, policy.ic_keep) | at(nmi, policy.nmi_keep)
    action = (
        F.when(ic.isNull() & nmi.isNull(), "missing_pre_eval").when(at(ic, policy.ic_keep) & F.coalesce(signed < 0, F.lit(False)), "consider_inverse")
        .when(strong & (crowd <= policy.most_peer_corr), "keep_candidate").when(strong, "keep_but_crowded")
        .when(at(ic, policy.ic_review) | at(nmi, policy.nmi_review), "monitor").otherwise("discard_candidate")
    )
    by_nmi = lambda least, word: F.when(at(nmi, least[1]) & ~at(ic, least[0]), f"nmi_{word}").otherwise(f"ic_or_nmi_{word}")
    reason = (
        F.when(action == "missing_pre_eval", "no_evaluation").when(action == "consider_inverse", "ic_above_keep_and_negative")
        .when(action == "keep_candidate", by_nmi((policy.ic_keep, policy.nmi_keep), "above_keep")).when(action == "keep_but_crowded", "above_keep_and_correlated_with_peers")
        .when(action == "monitor", by_nmi((policy.ic_review, policy.nmi_review), "above_review")).otherwise("below_review")
    )
    return board.withColumns({"recommendation": action, "recommendation_reason": reason})


def next_steps(histogram: dict[str, int], candidates: int) -> list[str]:
    """Hints for the next batch from the reasons' counts (a dozen numbers on the driver)."""
    if not candidates:
        return ["no_candidates"]
    often = lambda reason, share: histogram.get(reason, 0) >= max(2, candidates // share)
    some = lambda reason: histogram.get(reason, 0) > 0
    rules = (
        (often("low_coverage", 3), "tighten_lane_or_label_coverage"), (often("high_redundancy_to_baseline", 3), "search_other_families"), (often("weak_ic", 3), "retire_weak_variants"),
        (some("inverse_candidate_only"), "review_inverse_candidates"), (often("narrow_entropy_regime_only", 4), "add_regime_variants"),
        (some("caveat_dependence_too_high"), "keep_caveat_ideas_in_extension_lane"), (some("insufficient_significance"), "require_stronger_evidence"),
    )
    return [step for test, step in rules if test] or ["prioritise_ready_candidates"]


def catalogue(spark, specs=SPECS, names: list[str] | None = None, target: str = "stock_research_candidate", version: str = UNIVERSE_VERSION, source: str = "target_only", cross_security: bool = False) -> DataFrame:
    """One row a factor of the catalogue, or of ``names``: family, caveat flag, and the universe columns as the lane applied them."""
    rows = [(name, spec.family, spec.caveat, cross_security, target, source, version) for spec in specs for name in (spec.name, spec.change) if names is None or name in names]
    return spark.createDataFrame(rows, "factor string, family string, contains_caveat_fields boolean, contains_cross_security_source boolean, target_instrument_universe string, source_instrument_universe string, universe_filter_version string")


def board_order(board: DataFrame) -> DataFrame:
    """Best first: evaluated ones, then |IC|, NMI, lower baseline and peer correlation, more instruments, name."""
    return board.orderBy(
        (F.col("mean_abs_rank_ic").isNull() & F.col("mean_nmi").isNull()), F.desc(F.coalesce("mean_abs_rank_ic", F.lit(0.0))), F.desc(F.coalesce("mean_nmi", F.lit(0.0))),
        F.coalesce("mean_abs_baseline_corr", F.lit(0.0)), "mean_abs_peer_corr", F.desc("distinct_instruments"), "factor",
    )
