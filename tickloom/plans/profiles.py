"""Profiles of factors and families, the registry of baselines, and the check of submissions: configuration, a few values each."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from tickloom.functions.columns import YEAR_GRADES
from tickloom.operators.factors import BASELINES, FactorSpec
from tickloom.operators.universe import UNIVERSE_VERSION
from tickloom.plans.cards import YEARS, parse_card
from tickloom.sources import logs, ticks

TARGET, SOURCE, LABEL = "stock_research_candidate", "target_only", "forward_return_1d_close_like"


def listed(value: Any) -> list[str]:
    """A list's items, or those of a comma-separated text, as texts; blank ones are left out."""
    items = value if isinstance(value, list | tuple) else [] if value is None else str(value).split(",")
    return [text for item in items if (text := str(item).strip())]


def _merged(*values: Any) -> list[str]:
    return list(dict.fromkeys(item for value in values for item in listed(value)))


#: A family profile's fields, the keys of the family's file that may hold each (the first one present counts), and the value without any.
FAMILY_TEXTS: dict[str, tuple[tuple[str, ...], str]] = {
    "mechanism_hypothesis": (("mechanism_hypothesis", "mechanism"), ""),
    "allowed_input_lane": (("allowed_input_lane",), "phase_a_core"),
    "redundancy_pattern": (("redundancy_pattern",), "not_recorded"),
    "extension_lane_eligibility": (("extension_lane_eligibility",), "default_lane_only"),
    "whether_to_expand_further": (("whether_to_expand_further",), "monitor"),
    "status": (("status",), "unknown"),
    "notes": (("notes",), ""),
}
FAMILY_LISTS: dict[str, tuple[tuple[str, ...], str]] = {
    "common_variants": (("common_variants", "current_members", "approved_factor_ids"), ""),
    "known_failure_patterns": (("known_failure_patterns", "known_failure_modes"), ""),
    "regime_sensitivity": (("regime_sensitivity", "expected_regime"), "unknown"),
    "baseline_refs": (("baseline_refs",), ""),
    "approved_factor_ids": (("approved_factor_ids",), ""),
    "rejected_factor_ids": (("rejected_factor_ids",), ""),
    "core_observables": (("core_observables",), ""),
    "forbidden_semantic_assumptions": (("forbidden_semantic_assumptions",), ""),
}
#: What of a family's profile a factor's profile repeats, and under which name.
FROM_FAMILY = {
    "family_allowed_input_lane": "allowed_input_lane", "family_common_variants": "common_variants", "family_current_best_variants": "current_best_variants",
    "family_redundancy_pattern": "redundancy_pattern", "family_regime_sensitivity": "regime_sensitivity", "family_expand_direction": "whether_to_expand_further",
}
#: Fields whose use makes a card one of the caveat lane, and lane eligibilities that close the extension lane.
CAVEAT_USES = ("TradeDir", "BrokerNo", "OrderType", "Type", "Ext")
CLOSED = ("default_lane_only", "not_allowed", "blocked")


def family_profile(family: str, record: dict[str, Any]) -> dict[str, Any]:
    """A family's profile from its record (logs.read_flat_yaml): texts and lists under one name each, whatever the record called them."""

    def first(keys: tuple[str, ...], default: str) -> Any:
        return next((record[k] for k in keys if k in record), default)

    out: dict[str, Any] = {"family_id": family, "family_name": str(record.get("family_name", family))}
    out |= {name: str(first(*rule)) for name, rule in FAMILY_TEXTS.items()}
    out |= {name: listed(first(*rule)) for name, rule in FAMILY_LISTS.items()}
    return out | {"current_best_variants": listed(record.get("current_best_variants")) or listed(record.get("current_best_variant"))}


def factor_profile(
    spec: FactorSpec, card: dict[str, Any], family: dict[str, Any], target: str = TARGET, source: str = SOURCE, cross_security: bool = False, version: str = UNIVERSE_VERSION, transform: str = "level", card_path: str = "", family_path: str = "",
) -> dict[str, Any]:
    """A factor's profile from its spec, research card and family profile: its lanes, horizons, known failures and comparators."""
    mapped = bool(cross_security or source != SOURCE or card.get("requires_cross_security_mapping"))
    uses = card.get("semantics", {})
    raw = "raw" in spec.lanes
    return {
        "factor_name": spec.name if transform == "level" else spec.change,
        "factor_id": spec.name if transform == "level" else spec.change,
        "module_name": spec.name,
        "transform_name": transform,
        "transform_chain": ["daily_aggregate", "level", *([transform] if transform != "level" else [])],
        "expected_regime": listed(card.get("expected_regime")),
        "forbidden_semantic_assumptions": _merged(card.get("forbidden_semantic_assumptions"), family.get("forbidden_semantic_assumptions")),
        "research_card_path": card_path,
        "family_registry_path": family_path,
        "family_id": spec.family or str(card.get("factor_family", "")),
        "family_name": family.get("family_name") or spec.family,
        "mechanism_hypothesis": str(card.get("mechanism", "")),
        "target_universe_scope": target,
        "source_universe_scope": source,
        "contains_cross_security_source": cross_security,
        "universe_filter_version": version,
        "label_definition": LABEL,
        "required_data_lane": "verified_raw" if raw else "daily_agg",
        "input_dependencies": list(spec.lanes),
        "required_year_grade": [YEAR_GRADES[int(year)] for year in card.get("years", []) if int(year) in YEAR_GRADES],
        "time_grade_requirement": str(card.get("timing", {}).get("mode", "coarse_only")),
        "contains_caveat_fields": spec.caveat or card.get("universe") == "phase_a_caveat_lane" or any(uses.get(field, "unused") != "unused" for field in CAVEAT_USES),
        "requires_cross_security_mapping": mapped,
        "supports_default_lane": target == TARGET and not mapped,
        "supports_extension_lane": source != SOURCE or family.get("extension_lane_eligibility", CLOSED[0]) not in CLOSED,
        "evaluation_horizons": _merged(card.get("holding_horizon"), card.get("horizon_scope")),
        "known_failure_modes": _merged(card.get("failure_modes"), family.get("known_failure_patterns")),
        "baseline_comparators": _merged(card.get("baseline_refs"), family.get("baseline_refs")),
        "promotion_target": str(card.get("promotion_target", "")),
    } | {name: family.get(key, "") for name, key in FROM_FAMILY.items()}


#: What of a profile a scoreboard's row shows; lists are joined by commas.
ON_BOARD = (
    "family_name", "module_name", "transform_name", "transform_chain", "mechanism_hypothesis", "required_data_lane", "required_year_grade", "time_grade_requirement", "baseline_comparators", "known_failure_modes", "forbidden_semantic_assumptions",
    "expected_regime", "research_card_path", "label_definition", "evaluation_horizons", "family_registry_path", "promotion_target", *FROM_FAMILY,
)
FLAGS_ON_BOARD = ("contains_caveat_fields", "requires_cross_security_mapping", "supports_default_lane", "supports_extension_lane")


def of_candidates(spark, lane: Any, cards: dict[str, str], families: str, registry: dict[str, Any]) -> dict[str, dict[str, Any]]:
    """A profile for each of a lane's factors, with its baseline group: from its card, and its family's record (``<families>/<family>.yaml``) where there is one."""
    held: dict[str, dict[str, Any]] = {}
    out = {}
    for spec in lane.specs:
        if spec.family not in held:
            path = f"{families}/{spec.family}.yaml" if families and spec.family else ""
            there = bool(path) and ticks.exists(spark, path)
            held[spec.family] = family_profile(spec.family, logs.read_flat_yaml(path, spark) if there else {}) | {"path": path if there else ""}
        for column, transform in ((spec.name, "level"), (spec.change, "one_day_difference")):
            if column not in lane.names:
                continue
            card_path = cards.get(column, "")
            card = parse_card(logs.read_text(spark, card_path)) if card_path else {}
            profile = factor_profile(spec, card, held[spec.family], lane.target, lane.source, lane.cross_security, lane.version, transform, card_path, held[spec.family]["path"])
            out[column] = profile | {"baseline_group": baseline_group(column, registry) or baseline_group(spec.name, registry)}
    return out


def board_rows(spark, profiles: dict[str, dict[str, Any]]):
    """(factor, ...) of what a scoreboard shows of profiles: a row a factor."""
    text = lambda v: ",".join(map(str, v)) if isinstance(v, list | tuple) else str(v)
    rows = [(name, p["baseline_group"], *(text(p.get(c, "")) for c in ON_BOARD), *(bool(p[c]) for c in FLAGS_ON_BOARD)) for name, p in sorted(profiles.items())]
    return spark.createDataFrame(rows, ", ".join(["factor string", "baseline_group string", *(f"{c} string" for c in ON_BOARD), *(f"{c} boolean" for c in FLAGS_ON_BOARD)]))


def baseline_registry(path: str | None = None) -> dict[str, Any]:
    """The registry of baselines: ``default_baselines`` and ``groups`` (name: factors) of a TOML file; the catalogue's own without one."""
    if path is None:
        return {"default_baselines": list(BASELINES), "groups": {}}
    held = logs.read_toml(path)
    return held | {"default_baselines": list(held.get("default_baselines", [])), "groups": {name: list(group.get("factors", [])) for name, group in held.get("groups", {}).items()}}


def baseline_group(factor: str, registry: dict[str, Any]) -> str:
    """The first group that has a factor; empty without one."""
    return next((name for name, factors in registry["groups"].items() if factor in factors), "")


#: What a submission must keep to, and the message where it does not.
SUBMISSION_RULES: tuple[tuple[Callable[[dict[str, Any], Iterable[str]], bool], str], ...] = (
    (lambda s, years: set(map(str, s.get("years", ()))) <= set(years), "years outside the baseline"),
    (lambda s, years: s.get("timing_mode") in YEAR_GRADES.values(), "unknown timing mode"),
)


def submission_errors(submission: dict[str, Any], years: Iterable[str] = YEARS) -> list[str]:
    """What speaks against a submission (years, timing_mode); none if it may be run."""
    return [message for keeps, message in SUBMISSION_RULES if not keeps(submission, tuple(years))]
