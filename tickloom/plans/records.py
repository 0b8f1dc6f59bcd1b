"""Which of the logged runs and comparisons are current: the latest of each factor, of a pair, of the whole log."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.compare import latest
from tickloom.sources import logs

RECENT = 12


def recent_factors(runs: DataFrame, n: int = RECENT) -> DataFrame:
    """The n factors that were materialised last, newest first: (factor_name, created_at) of each one's last run with an output.

    A run with a null or empty ``run_dir`` has no output; ties of time go to the name.
    """
    made = runs.where((F.col("run_dir") != "") & (F.col("factor_name") != ""))
    return latest(made, ["factor_name"], "created_at", "run_dir").select("factor_name", "created_at").orderBy(F.desc("created_at"), "factor_name").limit(n)


def best_comparisons(wanted: DataFrame, logged: DataFrame) -> DataFrame:
    """For each wanted pair of runs the comparison to show, with match_level: experiment (the same two runs) before factor (the same two factors).

    ``wanted`` and ``logged`` have left_ and right_ experiment_id and factor; which side is left does not matter. Within a level the
    newest comparison wins. A pair that was never compared has nulls. Two equi-joins, no scan of all pairs.
    """

    def keyed(rows: DataFrame) -> DataFrame:
        for level, column in (("e", "experiment_id"), ("f", "factor")):
            rows = rows.withColumn(f"__{level}", F.array_sort(F.array(f"left_{column}", f"right_{column}")))
        return rows

    asked = keyed(wanted.select("left_experiment_id", "right_experiment_id", "left_factor", "right_factor").distinct())
    held = keyed(logged).select("__e", "__f", "comparison_id", "created_at")
    levels = (("__e", "experiment"), ("__f", "factor"))
    out = asked
    for key, level in levels:
        newest = latest(held, [key], "created_at", "comparison_id").select(key, F.struct("comparison_id", F.lit(level).alias("match_level")).alias(f"__{level}"))
        out = out.join(newest, key, "left")
    return out.withColumn("__best", F.coalesce(*[f"__{level}" for _, level in levels])).select("left_experiment_id", "right_experiment_id", "left_factor", "right_factor", "__best.comparison_id", "__best.match_level")


def pair_means(merged: DataFrame) -> DataFrame:
    """By pair: means of the correlations and overlaps that are there (null where none is), over rows of compare.merged_by_date."""
    return merged.groupBy("left_factor", "right_factor").agg(F.avg("pearson_corr").alias("mean_pearson_corr"), F.avg("top_overlap_count").alias("mean_top_overlap"))


def artifacts(spark: SparkSession, root: str, prefix: str, name: str) -> DataFrame:
    """run and payload (JSON text) of each ``<root>/<prefix>_*/<name>``, newest first: run ids carry their time."""
    found = spark.read.text(f"{root}/{prefix}_*/{name}", wholetext=True)
    run = F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1)
    return found.select(run.alias("run"), F.col("value").alias("payload")).orderBy(F.desc("run"))


#: A scoreboard's columns by type: what a stored board may have. Lists of texts are texts joined by commas.
TEXTS = (
    "factor", "family", "family_name", "module_name", "transform_name", "transform_chain", "mechanism_hypothesis", "baseline_group", "baseline_role", "incremental_hint", "recommendation", "recommendation_reason",
    "strongest_slice", "weakest_slice", "primary_reject_reason", "secondary_reject_reasons", "promotion_readiness", "target_instrument_universe", "source_instrument_universe", "universe_filter_version", "required_data_lane",
    "required_year_grade", "time_grade_requirement", "baseline_comparators", "known_failure_modes", "forbidden_semantic_assumptions", "expected_regime", "research_card_path", "label_definition", "evaluation_horizons",
    "family_allowed_input_lane", "family_common_variants", "family_current_best_variants", "family_redundancy_pattern", "family_regime_sensitivity", "family_expand_direction", "family_registry_path", "promotion_target", "run_key",
)
NUMBERS = (
    "mean_rank_ic", "mean_abs_rank_ic", "mean_pearson", "mean_top_bottom_spread", "mean_coverage_ratio", "mean_mutual_info", "mean_nmi", "mean_nmi_ic_gap", "mean_mi_p_value", "mean_mi_excess_over_null", "mi_significant_date_ratio",
    "sign_consistency", "mean_abs_baseline_corr", "mean_baseline_top_overlap", "mean_abs_peer_corr", "mean_top_overlap_count", "entropy_regime_dispersion", "overall_score_mean", "hit_rate", "stability_proxy", "spread_return", "turnover_proxy",
)
COUNTS = ("evaluated_dates", "joined_rows", "evaluated_count", "sign_switch_count", "baseline_peer_count", "distinct_instruments", "output_rows")
FLAGS = ("contains_caveat_fields", "contains_cross_security_source", "requires_cross_security_mapping", "supports_default_lane", "supports_extension_lane")
BOARD = [*((n, "string") for n in TEXTS), *((n, "double") for n in NUMBERS), *((n, "long") for n in COUNTS), *((n, "boolean") for n in FLAGS), ("entropy_values", "array<double>")]
SLICE = "factor: string, slice_name: string, slice_value: string, date_count: long, labeled_rows: long, mean_rank_ic: double, mean_abs_rank_ic: double, mean_top_bottom_spread: double, mean_coverage_ratio: double, mean_nmi: double, mean_mi_p_value: double, mi_significant_date_ratio: double"
DATE = "date: date, labeled_rows: long, coverage_ratio: double, rank_ic: double, pearson_corr: double, mi: double, nmi: double, mi_p_value: double, top_bottom_spread: double"
SCOREBOARD = f"scoreboard_id string, created_at string, factor_count long, columns array<string>, per_date_path string, comparisons_path string, factor_board array<struct<{', '.join(f'{n}: {k}' for n, k in BOARD)}>>, regime_slices array<struct<{SLICE}>>"
PER_DATE = f"factor string, per_date array<struct<{DATE}>>"
COMPARISON = "left_factor string, right_factor string, per_date_corr array<struct<date: date, common_rows: long, pearson_corr: double>>, top_overlap array<struct<date: date, top_overlap_count: long>>"


def _fields(struct: str) -> list[str]:
    return [part.split(":")[0].strip() for part in struct.split(", ")]


def scoreboard_payload(scoreboard_id: str, created_at: str, board: DataFrame, lane: Any) -> dict[str, Any]:
    """A scoreboard as one JSON object: a row a factor, its regime slices, and where the lists by date lie.

    Those are written by Spark beside it: one object a factor with its dates, one a pair with its correlations and overlaps.
    """
    root = f"{lane.store.root}/{scoreboard_id}"
    evaluated, pairs = lane.evaluated(), lane.store.compared(lane.keys)
    evaluated.groupBy("factor").agg(F.sort_array(F.collect_list(F.struct(*_fields(DATE)))).alias("per_date")).write.mode("overwrite").json(f"{root}/per_date")
    some = lambda test, *fields: F.sort_array(F.filter(F.collect_list(F.when(test, F.struct(*fields))), lambda x: x.isNotNull()))
    pairs.groupBy("left_factor", "right_factor").agg(
        some(F.col("common_rows").isNotNull(), "date", "common_rows", "pearson_corr").alias("per_date_corr"), some(F.col("top_overlap_count").isNotNull(), "date", "top_overlap_count").alias("top_overlap"),
    ).write.mode("overwrite").json(f"{root}/comparisons")
    known = [n for n, _ in BOARD if n in board.columns]
    rows = [json.loads(r) for r in board.select(*known).toJSON().collect()]  # a row a factor
    slices = [json.loads(r) for r in lane.slices().select(*[f for f in _fields(SLICE) if f in lane.slices().columns]).orderBy("factor", "slice_name", "slice_value").toJSON().collect()]  # a dozen rows a factor
    return {"scoreboard_id": scoreboard_id, "created_at": created_at, "factor_count": len(rows), "columns": known, "per_date_path": f"{root}/per_date", "comparisons_path": f"{root}/comparisons", "factor_board": rows, "regime_slices": slices}


def scoreboard(spark: SparkSession, path: str) -> dict[str, Any]:
    """A stored scoreboard, typed: scoreboard_id, and frames board, regime_slices, per_date and comparisons (by pair and date).

    What follows the JSON object's end is ignored. A board has the columns that it was written with.
    """
    text = json.dumps(logs.read_json(path, spark=spark))
    held = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", SCOREBOARD).alias("s")).select("s.*")
    head = held.select("scoreboard_id", "columns", "per_date_path", "comparisons_path").first()
    board = held.select(F.inline("factor_board"))
    out: dict[str, Any] = {"scoreboard_id": head["scoreboard_id"], "board": board.select(*head["columns"]) if head["columns"] else board, "regime_slices": held.select(F.inline("regime_slices"))}
    if head["per_date_path"]:
        out["per_date"] = spark.read.schema(PER_DATE).json(head["per_date_path"]).select("factor", F.inline("per_date"))
    if head["comparisons_path"]:
        pairs = spark.read.schema(COMPARISON).json(head["comparisons_path"])
        key = ["left_factor", "right_factor"]
        out["comparisons"] = pairs.select(*key, F.inline("per_date_corr")).join(pairs.select(*key, F.inline("top_overlap")), [*key, "date"], "full_outer")
    return out
