"""A research cycle end to end: runs that are not in the store yet, the scoreboard from stored runs, triage, reports and logs.

A cycle scores its candidates on its dates, writes what each candidate's run gives (plans.store), compares the pairs that were never
compared, and derives everything else from what is stored. A cycle over equal input reads all of it and evaluates nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import compare, evaluate, factors
from tickloom.plans import policy, profiles, records, sql, triage
from tickloom.plans.cards import evaluate_card, parse_card
from tickloom.plans.store import Run, Store
from tickloom.plans.views import FRACTION, TOP, Lane
from tickloom.sources import logs, ticks

REPORT_COLUMNS = ("factor", "family", "mean_rank_ic", "mean_abs_rank_ic", "mean_nmi", "mean_abs_peer_corr", "incremental_hint", "recommendation", "promotion_readiness", "primary_reject_reason")
SLICE_COLUMNS = ("factor", "slice_name", "slice_value", "date_count", "labeled_rows", "mean_rank_ic", "mean_abs_rank_ic", "mean_top_bottom_spread", "mean_coverage_ratio", "mean_nmi", "mean_mi_p_value", "mi_significant_date_ratio")
DATE_COLUMNS = ("factor", "date", "labeled_rows", "coverage_ratio", "rank_ic", "pearson_corr", "mi", "nmi", "mi_p_value", "top_mean_return", "bottom_mean_return", "top_bottom_spread")
PAIR_COLUMNS = ("left_factor", "right_factor", "date", "common_rows", "pearson_corr", "top_overlap_count")

#: Names of transforms, and a candidate's name that is not its level's name with ``_change`` behind it.
LEVEL, CHANGE = "level", "one_day_difference"
OTHER_NAMES = {"structural_activity_change": "structural_activity_proxy_change"}


@dataclass(frozen=True)
class Candidate:
    """One factor of a cycle: the catalogue's column, how it is made, and its research card (a path, or empty)."""

    column: str
    transform: str
    card: str = ""


@dataclass(frozen=True)
class CycleConfig:
    """A cycle's configuration. Without candidates it takes the whole catalogue, without anchor dates every date."""

    version: str = ""
    name: str = ""
    owner: str = ""
    anchor_dates: tuple[str, ...] = ()
    selection: policy.Selection = policy.Selection()
    candidates: tuple[Candidate, ...] = ()
    specs: tuple[factors.FactorSpec, ...] = factors.SPECS
    registry: dict[str, Any] = field(default_factory=profiles.baseline_registry)
    families: str = ""

    @classmethod
    def of(cls, spark: SparkSession, config: dict[str, Any]) -> CycleConfig:
        """From a TOML configuration's values.

        Candidates have factor and, at will, card, module and transform. ``batches`` lists files of further level expressions (logs.factor_specs), ``baselines``
        names a registry of baselines, ``families`` a folder of family records. Unknown factors, modules and transforms are errors, and so are
        cards that the card gate fails.
        """
        specs = factors.SPECS + tuple(s for path in config.get("batches", ()) for s in logs.factor_specs(path, spark))
        registry = profiles.baseline_registry(config.get("baselines"))
        candidates = tuple(_candidate(item, specs) for item in config.get("candidates", ()))
        if double := sorted({c.column for c in candidates if sum(d.column == c.column for d in candidates) > 1}):
            raise ValueError(f"candidates named twice: {', '.join(double)}")
        for candidate in candidates:
            if candidate.card and (result := evaluate_card(logs.read_text(spark, candidate.card))).decision == "fail":
                raise ValueError(f"the card of {candidate.column} fails: {'; '.join(result.reasons)}")
        return cls(
            str(config.get("version", "")), str(config.get("name", "")), str(config.get("owner", "")), tuple(sorted(set(map(str, config.get("anchor_dates", ()))))),
            policy.Selection.of(config), candidates, specs, registry, str(config.get("families", "")),
        )

    def options(self) -> dict[str, Any]:
        """What a lane takes of it."""
        baselines = tuple(b for b in (OTHER_NAMES.get(b, b) for b in self.registry["default_baselines"]))
        return {"specs": self.specs, "names": [c.column for c in self.candidates] or None, "anchors": list(self.anchor_dates) or None, "baselines": baselines}


def _candidate(item: dict[str, Any], specs: tuple[factors.FactorSpec, ...]) -> Candidate:
    """A configured candidate as the catalogue's column: named so, or by its module and transform."""
    names, module = {s.name for s in specs}, str(item.get("module", item["factor"]))
    transform = str(item.get("transform", ""))
    if transform not in ("", LEVEL, CHANGE):
        raise ValueError(f"unknown transform {transform}")
    column = OTHER_NAMES.get(item["factor"], item["factor"])
    if column not in factors.factor_names(specs):
        if module not in names:
            raise ValueError(f"unknown factor {item['factor']}")
        column = f"{module}_change" if transform == CHANGE else module
    is_change = column not in names
    if transform and (transform == CHANGE) != is_change:
        raise ValueError(f"{item['factor']} is no {transform}")
    return Candidate(column, CHANGE if is_change else LEVEL, str(item.get("card", "")))


class StoredLane(Lane):
    """A lane whose frames are read from the store: nothing is scored or evaluated."""

    def __init__(self, lane: Lane, store: Store, keys: dict[str, str], regimes: str):
        super().__init__(lane.spark, lane.sf_dir, lane.specs, sorted(keys), lane.anchors, lane.baselines)
        self.target, self.version, self.source, self.cross_security, self.profiles = lane.target, lane.version, lane.source, lane.cross_security, lane.profiles
        self.store, self.keys, self.regime_key = store, keys, regimes

    def scores(self) -> DataFrame:
        return self._once("scores", lambda: self.store.get("scores", self.keys.values()))

    def evaluated(self) -> DataFrame:
        return self._once("evaluated", lambda: self.store.get("evaluated", self.keys.values()))

    def per_date(self) -> DataFrame:
        return self.evaluated()

    def backtest(self) -> DataFrame:
        return self._once("backtest", lambda: self.store.get("backtest", self.keys.values()))

    def regimes(self) -> DataFrame:
        return self._once("regimes", lambda: self.store.get("regimes", [self.regime_key]))

    def correlations(self) -> DataFrame:
        return self.store.compared(self.keys).where(F.col("common_rows").isNotNull()).drop("top_overlap_count")

    def overlaps(self) -> DataFrame:
        return self.store.compared(self.keys).where(F.col("top_overlap_count").isNotNull()).drop("common_rows", "pearson_corr")


def markdown(frame: DataFrame, columns: tuple[str, ...], title: str) -> str:
    """A result as a Markdown table, all its rows: a catalogue's factors, by pair, slice or date."""
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    shown = [c for c in columns if c in frame.columns]
    lines = [f"# {title}", "", "| " + " | ".join(shown) + " |", "|" + "---|" * len(shown)]
    return "\n".join([*lines, *("| " + " | ".join(cell(r[c]) for c in shown) + " |" for r in frame.select(*shown).toLocalIterator())]) + "\n"


def status(spark: SparkSession, root: str) -> dict[str, object]:
    """Experiments by status, and the newest row of each log."""
    out: dict[str, object] = {}
    experiments = logs.read_log(spark, root, "experiment_log")
    counts = experiments.agg(F.count(F.lit(1)).alias("experiments"), *[F.count_if(F.col("status") == s).alias(s) for s in ("keep", "manual_review", "discard")]).first()
    out |= counts.asDict()
    for name in logs.LOGS:
        last = logs.read_log(spark, root, name).agg(F.max_by(F.struct("*"), "created_at").alias("row")).first()["row"]
        out[f"latest_{name}"] = last.asDict() if last else None
    return out


def recent(spark: SparkSession, root: str, n: int = records.RECENT) -> list[dict[str, str]]:
    """The factors that were materialised last, newest first, from the experiment log."""
    return [r.asDict() for r in records.recent_factors(logs.read_log(spark, root, "experiment_log"), n).collect()]


def export_labels(lane: Lane, root: str, year: int, notes: str = "") -> dict[str, object]:
    """Writes a year's forward labels under ``root`` with a summary beside them; returns the summary."""
    made = datetime.now(UTC)
    export_id = f"labels_{year}_{made:%Y%m%dT%H%M%SZ}"
    path = f"{root}/{export_id}/forward_labels"
    lane.labels().where(F.year("date") == year).repartitionByRange("date").sortWithinPartitions("date", "instrument_key").write.parquet(path)
    written = lane.spark.read.parquet(path)
    counts = written.agg(F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set(F.col("date").cast("string"))).alias("dates")).first()
    summary = {
        "export_id": export_id, "created_at": made.isoformat(), "year": str(year), "label_name": evaluate.LABEL, "target_instrument_universe": lane.target, "source_instrument_universe": lane.source,
        "contains_cross_security_source": lane.cross_security, "universe_filter_version": lane.version, "dates": counts["dates"], "date_count": len(counts["dates"]), "row_count": counts["rows"], "columns": written.columns, "labels_path": path, "notes": notes,
    }
    lane.spark.createDataFrame([(json.dumps(summary),)], "value string").coalesce(1).write.text(f"{root}/{export_id}/labels_summary")
    return summary


def _runs(lane: Lane, config: CycleConfig, version: str) -> dict[str, Run]:
    """What each factor's run depends on."""
    cards = {c.column: c.card for c in config.candidates}
    dates = ",".join(lane.anchors) if lane.anchors is not None else "all"
    parameters = json.dumps({"fraction": FRACTION, "top": TOP, "permutations": sql.PERMUTATIONS, "places": factors.PLACES, "label": evaluate.LABEL}, sort_keys=True)
    out = {}
    for spec in lane.specs:
        for column, transform in ((spec.name, LEVEL), (spec.change, CHANGE)):
            if column in lane.names:
                out[column] = Run(column, spec.family, cards.get(column, ""), transform, spec.expression, dates, version, f"{lane.target}:{lane.version}", parameters)
    return out


def materialise(lane: Lane, store: Store, runs: dict[str, Run], regimes: str, run_id: str, made: str, reuse: bool = True) -> tuple[list[dict[str, str]], int]:
    """Runs and compares what the store lacks; returns the inventory (factor, key, run_id, mode: new or reused) and the number of new comparisons."""
    spark = lane.spark
    keys = {name: run.key for name, run in runs.items()}
    held = store.made_by(keys.values()) if reuse else {}
    absent = [name for name in runs if keys[name] not in held]
    if absent:
        named = F.broadcast(spark.createDataFrame([(name, keys[name]) for name in absent], "factor string, key string"))
        part = lane.restricted(absent)
        for name, frame in (("scores", part.scores()), ("evaluated", part.evaluated()), ("backtest", part.backtest())):
            store.put(name, frame.join(named, "factor"))
        part.close()
    if not ticks.exists(spark, f"{store.path('regimes')}/key={regimes}"):
        store.put("regimes", lane.regimes().withColumn("key", F.lit(regimes)))
    lacking = store.missing_pairs(keys) if reuse else [(a, b) for a in sorted(keys) for b in sorted(keys) if a < b]
    if lacking:
        asked = spark.createDataFrame(lacking, "left_factor string, right_factor string")
        involved = sorted({name for pair in lacking for name in pair})
        scores = store.get("scores", [keys[n] for n in involved])
        merged = compare.merged_by_date(compare.correlation_by_date(scores, asked), compare.top_overlap_by_date(scores, TOP))
        store.put_pairs(merged, keys, lacking)
    store.commit([runs[name] for name in absent], run_id, made)
    inventory = [{"factor": name, "key": keys[name], "run_id": held.get(keys[name], run_id), "mode": "reused" if keys[name] in held else "new"} for name in runs]
    return inventory, len(lacking)


def run(spark: SparkSession, sf_dir: str, root: str, selection: policy.Selection | None = None, lane: Lane | None = None, config: CycleConfig | None = None, reuse: bool = True, labels_path: str | None = None, notes: str = "") -> dict[str, object]:
    """Runs a cycle over a lane (lane E of ``sf_dir`` without one): runs, scoreboard, triage, reports and logs under ``root``.

    The lane's names, dates and baselines are those of the configuration if it was made with its ``options``. Factors that need caveat fields are carried
    with their flag; the triage rejects them by policy instead of stopping the cycle. ``labels_path``: exported labels for the triage's backtest, instead of
    the lane's own.
    """
    made, run_id = datetime.now(UTC).isoformat(), f"cycle_{uuid.uuid4().hex[:12]}"
    config = config or CycleConfig()
    lane = lane or Lane(spark, sf_dir, **config.options())
    lane.profiles = profiles.of_candidates(spark, lane, {c.column: c.card for c in config.candidates}, config.families, config.registry)
    store = Store(spark, root)
    version = ticks.data_version(spark, lane.inputs())
    runs = _runs(lane, config, version)
    regimes = Run("", "", "", "", "", ",".join(lane.anchors or ["all"]), version, f"{lane.target}:{lane.version}", "regimes").key
    inventory, compared = materialise(lane, store, runs, regimes, run_id, made, reuse)
    lane.close()

    stored = StoredLane(lane, store, {name: r.key for name, r in runs.items()}, regimes)
    run_keys = F.broadcast(spark.createDataFrame(sorted(stored.keys.items()), "factor string, run_key string"))
    board = policy.board_order(policy.recommendation(stored.board(), selection or config.selection).join(run_keys, "factor"))
    path = f"{root}/{run_id}/board"
    board.coalesce(1).write.mode("overwrite").parquet(path)  # a row a factor
    board = spark.read.parquet(path)
    summary = f"{root}/{run_id}/scoreboard_summary.json"
    logs.write_json(records.scoreboard_payload(run_id, made, board, stored), summary, spark)
    found = triage.run(spark, root, summary, labels_path, notes, store, {name: r.key for name, r in runs.items()})

    stamp = lambda frame, **values: frame.withColumns({"created_at": F.lit(made), **{k: F.lit(v) for k, v in values.items()}})
    named = board.drop("family_name").withColumnsRenamed({"factor": "factor_name", "family": "family_name"})
    stats = board.select("factor", "mean_abs_rank_ic", F.col("mean_nmi").alias("mean_normalized_mutual_info"), "mean_coverage_ratio", "sign_consistency")
    gates = policy.gate_decision(board).join(stats, "factor").withColumnRenamed("factor", "factor_name")
    experiments = spark.createDataFrame([(e["key"], made, config.owner, e["factor"], runs[e["factor"]].card, config.version, "keep", e["run_id"], e["mode"]) for e in inventory if e["mode"] == "new"], "experiment_id string, created_at string, owner string, factor_name string, card_path string, config_version string, status string, run_dir string, notes string")
    counts = stamp(board.agg(F.count(F.lit(1)).alias("factor_count")), scoreboard_id=run_id, cycle_id=run_id, comparison_count=len(runs) * (len(runs) - 1) // 2, summary_path=summary, config_version=config.version, notes=notes)
    first = found["shortlisted"][0] if found["shortlisted"] else None
    top = board.select("factor", "recommendation").first()
    best = {"best_factor": first or (top["factor"] if top else "none"), "best_action": "ready" if first else (top["recommendation"] if top else "none")}
    entries = {
        "experiment_log": experiments,
        "pre_eval_log": stamp(named, pre_eval_id=run_id, score_column="score", label_name=evaluate.LABEL, summary_path=path, notes=notes),
        "gate_b_log": stamp(gates, gate_b_id=run_id, pre_eval_id=run_id, summary_path=path, notes=notes),
        "scoreboard_log": counts,
        "autoresearch_cycle_log": counts.withColumns({"best_factor": F.lit(best["best_factor"]), "best_action": F.lit(best["best_action"]), "pre_eval_count": F.col("factor_count"), "experiment_count": F.lit(len(inventory))}),
    }
    for name, rows in entries.items():
        logs.append_log(rows, root, name, run_id)
    reports = {
        "leaderboard": markdown(policy.board_order(board), REPORT_COLUMNS, f"Factor board {run_id}"),
        "regimes": markdown(stored.slices().orderBy("factor", "slice_name", "slice_value"), SLICE_COLUMNS, f"Regime slices {run_id}"),
        "by_date": markdown(stored.evaluated().orderBy("factor", "date"), DATE_COLUMNS, f"Evaluation by date {run_id}"),
        "comparisons": markdown(store.compared({name: r.key for name, r in runs.items()}).orderBy(*PAIR_COLUMNS[:3]), PAIR_COLUMNS, f"Comparisons {run_id}"),
    }
    for name, text in reports.items():
        logs.write_text(spark, text, f"{root}/{run_id}/{name}.md")
    return {
        "run_id": run_id, "board": path, "summary": summary, "factors": len(runs), "inventory": inventory, "new_comparisons": compared, "reasons": found["reasons"], "next_steps": found["next_steps"],
        "triage_id": found["triage_id"], "report": reports["leaderboard"], "reports": sorted(f"{root}/{run_id}/{name}.md" for name in reports), **best,
    }


__all__ = ["Candidate", "CycleConfig", "StoredLane", "evaluate_card", "export_labels", "markdown", "materialise", "parse_card", "recent", "run", "status"]
