"""Research cards and their admissibility rules (gate A), tested on a handful of driver-side documents.

A rule is a row: a test of the card, the verdict it gives (an error or a caveat), and its reason. Cards with an error fail; with
caveats only they are allowed with caveat and need review; others pass.
"""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from tickloom.operators.universe import UNIVERSE_VERSION

#: Fields by how far they may be used.
SAFE_FIELDS = ("date", "table_name", "source_file", "ingest_ts", "row_num_in_file", "SeqNum", "OrderId", "Time", "Price", "Volume", "TickID")
BLOCKED_FIELDS = ("Level", "VolumePre", "BidOrderID", "AskOrderID", "BidVolume", "AskVolume")
CAVEAT_FIELDS = ("OrderType", "Type", "OrderSideVendor")
OTHER_FIELDS = ("TradeDir", "BrokerNo", "Ext")
ALIASES = {"Dir": "TradeDir"}

#: Research modules by year: allowed, allowed_with_caveat or blocked (2025, 2026).
MODULES = {
    "order_trade_coverage_profile": ("allowed", "allowed"),
    "matched_edge_session_profile": ("allowed", "allowed"),
    "order_trade_consistency_same_second": ("allowed_with_caveat", "allowed"),
    "order_lifecycle_shape_by_event_count": ("allowed", "allowed"),
    "trade_dir_weak_consistency_check": ("allowed_with_caveat", "allowed"),
    "trade_dir_candidate_signal_profile": ("blocked", "allowed_with_caveat"),
    "broker_weak_consistency_check": ("allowed_with_caveat", "allowed"),
    "ordertype_weak_consistency_check": ("allowed_with_caveat", "allowed_with_caveat"),
    "coarse_lag_bucket": ("allowed_with_caveat", "allowed"),
    "post_trade_drift_coarse_window": ("allowed_with_caveat", "allowed"),
    "waiting_time_distribution": ("blocked", "allowed"),
    "precise_order_to_trade_lag": ("blocked", "allowed"),
    "strict_ordering_sensitive_causality": ("blocked", "allowed_with_caveat"),
    "queue_position_or_depletion": ("blocked", "blocked"),
    "execution_realism_or_fill_simulation": ("blocked", "allowed_with_caveat"),
    "latency_like_metrics": ("blocked", "allowed_with_caveat"),
    "signed_flow_directional_factor": ("blocked", "blocked"),
}
YEARS = ("2025", "2026")

#: What a card must have, and its lists that must not be empty.
CARD_KEYS = ("card_id", "name", "owner", "status", "years", "universe", "target_instrument_universe", "source_instrument_universe", "contains_cross_security_source", "universe_filter_version", "holding_horizon", "research_modules", "required_fields", "hypothesis", "mechanism", "info_boundary", "failure_modes", "expected_risks", "timing", "semantics")
CARD_LISTS = ("years", "research_modules", "required_fields", "failure_modes", "expected_risks")
TIMING_KEYS = ("mode", "uses_precise_lag", "uses_strict_ordering", "uses_queue_semantics")
SEMANTIC_KEYS = ("TradeDir", "BrokerNo", "OrderType", "Level", "VolumePre", "Type", "Ext")
UNIVERSES = ("phase_a_core", "phase_a_caveat_lane")

#: The meanings that caveat-lane fields may be given (with caveat).
ALLOWED_MEANINGS = {"BrokerNo": ("reference_lookup_only",), "OrderType": ("weak_event_code_only", "stable_vendor_event_code_only"), "Type": ("vendor_code_descriptive_only", "vendor_public_trade_type_bucket_only")}
STRUCTURE_ONLY = "stable_code_structure_only"
DIRECTION_MEANINGS = ("candidate_directional_signal", "vendor_aggressor_proxy_only")
FALSE_DIRECTIONS = ("confirmed_signed_side", "signed_flow_truth", "aggressor_truth")
SIDE_MEANING = "bit0_order_side_proxy_only"

Verdict = tuple[str, str]


@dataclass(frozen=True)
class GateResult:
    decision: str
    reasons: tuple[str, ...]

    @property
    def manual_review_required(self) -> bool:
        return self.decision == "allow_with_caveat"


def parse_card(text: str) -> dict[str, Any]:
    """The TOML between the leading pair of +++ lines; an old name of the target universe is accepted."""
    head, *rest = text.split("\n")
    marks = [i for i, line in enumerate(rest) if line.strip() == "+++"]
    if head.strip() != "+++" or not marks:
        raise ValueError("a card starts with TOML between two lines of +++")
    card = tomllib.loads("\n".join(rest[: marks[0]]))
    return {"target_instrument_universe": card["instrument_universe"], **card} if "instrument_universe" in card else card


def _shape(card: dict[str, Any]) -> Iterator[Verdict]:
    if lacking := sorted(set(CARD_KEYS) - set(card)):
        yield "error", f"missing keys: {', '.join(lacking)}"
        return
    for part, keys in (("timing", TIMING_KEYS), ("semantics", SEMANTIC_KEYS)):
        if lacking := sorted(set(keys) - set(card[part])):
            yield "error", f"missing {part} keys: {', '.join(lacking)}"
    tests: list[tuple[bool, str]] = [(not isinstance(card[k], list) or not card[k], f"{k} must be a non-empty list") for k in CARD_LISTS]
    tests += [
        (card["universe"] not in UNIVERSES, "unsupported universe"),
        (card.get("instrument_universe", card["target_instrument_universe"]) != card["target_instrument_universe"], "the two target universes disagree"),
        (card["target_instrument_universe"] != "stock_research_candidate", "unsupported target universe"),
        (card["source_instrument_universe"] != "target_only", "unsupported source universe"),
        (card["contains_cross_security_source"] is not False, "cross-security sources are not supported"),
        (card["universe_filter_version"] != UNIVERSE_VERSION, "another universe filter version"),
    ]
    yield from (("error", reason) for failed, reason in tests if failed)


def _timing(card: dict[str, Any], years: list[str]) -> Iterator[Verdict]:
    if unknown := sorted(set(years) - set(YEARS)):
        yield "error", f"unsupported years: {', '.join(unknown)}"
        return
    timing = card["timing"]
    coarse, fine = "2025" in years, "2026" in years
    precise, strict = timing["uses_precise_lag"], timing["uses_strict_ordering"]
    tests = [
        (timing["mode"] not in ("coarse_only", "fine_ok"), "error", "timing.mode must be coarse_only or fine_ok"),
        (coarse and timing["mode"] != "coarse_only", "error", "2025 is coarse_only"),
        (coarse and precise, "error", "2025 cannot use precise lag"),
        (coarse and strict, "error", "2025 cannot use strict ordering"),
        (timing["uses_queue_semantics"], "error", "queue semantics are blocked"),
        (fine and precise, "caveat", "2026 precise lag needs review"),
        (fine and strict, "caveat", "2026 strict ordering is caveated"),
    ]
    yield from ((kind, reason) for hit, kind, reason in tests if hit)


def _modules(card: dict[str, Any], years: list[str]) -> Iterator[Verdict]:
    kinds = {"blocked": "error", "allowed_with_caveat": "caveat"}
    for module in card["research_modules"]:
        if module not in MODULES:
            yield "error", f"unknown module {module}"
            continue
        for year, status in zip(YEARS, MODULES[module], strict=True):
            if year in years and status in kinds:
                yield kinds[status], f"{module} is {status} for {year}"


@dataclass(frozen=True)
class MeaningRule:
    """What a field may mean, as a row: where it applies, which meanings it is about, and the verdict on them.

    applies: ``listed`` (the field is among the card's), ``used`` (it has a meaning), or ``either``. inside: whether the verdict is on the meanings or on all
    others. of: the field whose meaning counts, if another; without: a field that must not be listed. A reason may name the meaning.
    """

    field: str
    applies: str
    meanings: tuple[str, ...]
    inside: bool
    verdict: str
    reason: str
    year: str = ""
    of: str = ""
    without: str = ""

    def hits(self, listed: set[str], meanings: dict[str, str], years: list[str]) -> bool:
        meaning = meanings[self.of or self.field]
        known, used = self.field in listed, meaning != "unused"
        there = {"listed": known, "used": used, "either": known or used}[self.applies]
        return there and (not self.year or self.year in years) and (not self.without or self.without not in listed) and (meaning in self.meanings) == self.inside


#: The meanings of fields beyond the safe ones, a row a verdict.
MEANING_RULES = (
    MeaningRule("TradeDir", "listed", ("unused",), True, "error", "TradeDir is listed but unused"),
    MeaningRule("TradeDir", "used", FALSE_DIRECTIONS, True, "error", "TradeDir is no confirmed side"),
    MeaningRule("TradeDir", "either", (STRUCTURE_ONLY,), True, "caveat", "2025 TradeDir is structure only", "2025"),
    MeaningRule("TradeDir", "either", (STRUCTURE_ONLY,), False, "error", "2025 TradeDir is limited to structure", "2025"),
    MeaningRule("TradeDir", "used", (*DIRECTION_MEANINGS, STRUCTURE_ONLY), True, "caveat", "2026 TradeDir is vendor-defined", "2026"),
    MeaningRule("TradeDir", "used", (*DIRECTION_MEANINGS, STRUCTURE_ONLY), False, "error", "2026 TradeDir cannot exceed a vendor proxy", "2026"),
    *(MeaningRule(field, "either", allowed, True, "caveat", f"{field} is caveat-only: {{}}") for field, allowed in ALLOWED_MEANINGS.items()),
    *(MeaningRule(field, "either" if field == "BrokerNo" else "used", allowed, False, "error", f"{field} cannot mean {{}}") for field, allowed in ALLOWED_MEANINGS.items()),
    MeaningRule("Ext", "listed", (), False, "error", "Ext as a whole is outside the caveat lane"),
    MeaningRule("Ext", "used", (), False, "error", "Ext cannot be used directly", without="OrderSideVendor"),
    MeaningRule("OrderSideVendor", "listed", (SIDE_MEANING,), True, "caveat", "OrderSideVendor is a vendor proxy", of="Ext"),
    MeaningRule("OrderSideVendor", "listed", (SIDE_MEANING,), False, "error", f"OrderSideVendor needs Ext = {SIDE_MEANING}", of="Ext"),
    *(MeaningRule(field, "used", (), False, "error", f"{field} is blocked") for field in ("Level", "VolumePre")),
)
#: Fields whose use makes a card one of the caveat lane.
LANE_FIELDS = ("TradeDir", *ALLOWED_MEANINGS)


def _fields(card: dict[str, Any], years: list[str]) -> Iterator[Verdict]:
    listed, meanings = {ALIASES.get(str(f), str(f)) for f in card["required_fields"]}, card["semantics"]
    if unknown := sorted(listed - {*SAFE_FIELDS, *BLOCKED_FIELDS, *CAVEAT_FIELDS, *OTHER_FIELDS}):
        yield "error", f"unknown fields: {', '.join(unknown)}"
    yield from (("error", f"{f} is blocked") for f in BLOCKED_FIELDS if f in listed)
    yield from (("caveat", f"{f} is caveat-only") for f in CAVEAT_FIELDS if f in listed)
    yield from ((r.verdict, r.reason.format(meanings[r.of or r.field])) for r in MEANING_RULES if r.hits(listed, meanings, years))
    if card["universe"] != "phase_a_caveat_lane" and (listed & {*CAVEAT_FIELDS, *LANE_FIELDS} or any(meanings[f] != "unused" for f in LANE_FIELDS)):
        yield "error", "caveat fields need the caveat lane"


def evaluate_card(text: str) -> GateResult:
    """pass, allow_with_caveat or fail, with reasons: errors first."""
    try:
        card = parse_card(text)
    except (ValueError, tomllib.TOMLDecodeError) as problem:
        return GateResult("fail", (str(problem),))
    verdicts = list(_shape(card))
    if not verdicts:
        years = [str(y) for y in card["years"]]
        rules: tuple[Callable, ...] = (_timing, _modules, _fields)
        for rule in rules:
            verdicts += rule(card, years)
            if rule is _timing and any("unsupported years" in reason for _, reason in verdicts):
                break
    errors, caveats = ([r for k, r in verdicts if k == kind] for kind in ("error", "caveat"))
    if errors:
        return GateResult("fail", (*errors, *caveats))
    return GateResult("allow_with_caveat", tuple(caveats)) if caveats else GateResult("pass", ("no admissibility issue found",))
