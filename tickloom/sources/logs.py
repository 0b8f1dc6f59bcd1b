"""Append-only logs as tab-separated tables, JSON artifacts, and TOML and YAML configuration."""

from __future__ import annotations

import json
import os
import tomllib
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of each log, in order.
LOGS = {
    "experiment_log": ("experiment_id", "created_at", "owner", "factor_name", "card_path", "config_version", "harness_version", "gate_a_decision", "result_summary", "status", "parent_experiment_id", "run_dir", "notes"),
    "comparison_log": ("comparison_id", "created_at", "left_experiment_id", "right_experiment_id", "left_factor", "right_factor", "common_dates", "common_rows", "summary_path", "notes"),
    "pre_eval_log": ("pre_eval_id", "created_at", "experiment_id", "factor_name", "score_column", "label_name", "evaluated_dates", "joined_rows", "mean_rank_ic", "mean_abs_rank_ic", "mean_top_bottom_spread", "summary_path", "notes"),
    "gate_b_log": ("gate_b_id", "created_at", "pre_eval_id", "experiment_id", "factor_name", "decision", "direction_hint", "mean_abs_rank_ic", "mean_normalized_mutual_info", "mean_coverage_ratio", "sign_consistency", "summary_path", "notes"),
    "scoreboard_log": ("scoreboard_id", "created_at", "factor_count", "comparison_count", "summary_path", "notes"),
    "autoresearch_cycle_log": ("cycle_id", "created_at", "config_version", "factor_count", "experiment_count", "pre_eval_count", "comparison_count", "scoreboard_id", "best_factor", "best_action", "summary_path", "notes"),
    "reject_reason_log": ("triage_id", "created_at", "factor_name", "family_name", "primary_reject_reason", "secondary_reject_reasons_json", "promotion_readiness", "target_instrument_universe", "source_instrument_universe", "contains_cross_security_source", "universe_filter_version", "run_dir", "pre_eval_id", "scoreboard_id", "backtest_id", "metrics_snapshot_json", "notes"),
    "family_performance_summary": ("triage_id", "created_at", "family_name", "candidate_count", "shortlisted_count", "shortlist_rate", "common_failure_modes_json", "average_redundancy_profile", "entropy_regime_sensitivity", "significance_quality", "promotion_ready_count", "notes"),
}


def log_schema(name: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in LOGS[name]])


def _path(spark: SparkSession, path: str):
    """A path of any store, and the store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, from any store."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small file in any store: written beside its place and moved there, so a reader meets all of it or nothing; what was there is replaced."""
    at, store = _path(spark, path)
    staged, _ = _path(spark, f"{at.getParent()}/.{at.getName()}-{uuid.uuid4().hex}")
    out = store.create(staged, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if store.exists(at):
        store.delete(at, False)
    store.rename(staged, at)


def read_log(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A log's rows as strings; a log that was never written is empty."""
    at, store = _path(spark, f"{root}/{name}")
    if not store.exists(at):
        return spark.createDataFrame([], log_schema(name))
    return spark.read.schema(log_schema(name)).option("sep", "\t").option("header", True).option("escape", '"').csv(f"{root}/{name}")


def append_log(rows: DataFrame, root: str, name: str, entry: str | None = None) -> bool:
    """Appends rows to a log as one file with a header; columns the rows lack are null. Returns whether anything was added.

    ``entry`` names what is appended, and is the file's name: rows of an entry that the log has already are not appended again, so a repeated
    job changes nothing. The file is written elsewhere first and moved to its place at once. Without an entry every call appends.
    """
    spark, have = rows.sparkSession, set(rows.columns)
    at, store = _path(spark, f"{root}/{name}/{entry or uuid.uuid4().hex}.tsv")
    if store.exists(at):
        return False
    staged, _ = _path(spark, f"{root}/.staged/{uuid.uuid4().hex}")
    rows.select(*[(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in LOGS[name]]).coalesce(1).write.option("sep", "\t").option("header", True).option("escape", '"').csv(staged.toString())
    made = [f.getPath() for f in store.listStatus(staged) if f.getPath().getName().startswith("part-")]
    store.mkdirs(at.getParent())
    added = bool(made) and not store.exists(at) and store.rename(made[0], at)
    store.delete(staged, True)
    return added


def as_json(*columns: str):
    """A struct of columns as JSON text."""
    return F.to_json(F.struct(*columns))


def read_json(path: str, missing_ok: bool = False, spark: SparkSession | None = None) -> dict[str, Any]:
    """A JSON object; what follows its end is ignored, and a file that may be missing gives an empty one. With a session, from any store."""
    there = _path(spark, path)[1].exists(_path(spark, path)[0]) if spark else os.path.exists(path)
    if missing_ok and not there:
        return {}
    if spark:
        return json.JSONDecoder().raw_decode(read_text(spark, path).lstrip())[0]
    with open(path, encoding="utf-8") as f:
        return json.JSONDecoder().raw_decode(f.read().lstrip())[0]


def write_json(payload: Any, path: str, spark: SparkSession | None = None) -> None:
    """A JSON file; with a session, in any store."""
    text = json.dumps(payload, indent=2, ensure_ascii=False, default=str)
    if spark:
        return write_text(spark, text, path)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def read_toml(path: str, spark: SparkSession | None = None) -> dict[str, Any]:
    """A TOML file; with a session, from any store."""
    if spark:
        return tomllib.loads(read_text(spark, path))
    with open(path, "rb") as f:
        return tomllib.load(f)


def read_flat_yaml(path: str, spark: SparkSession | None = None) -> dict[str, Any]:
    """The simple YAML of family profiles: scalars, and lists of scalars with dashes. With a session, from any store."""
    if spark:
        lines = read_text(spark, path).split("\n")
    else:
        with open(path, encoding="utf-8") as f:
            lines = f.read().split("\n")
    out: dict[str, Any] = {}
    key = None
    for line in lines:
        text = line.split(" #")[0].rstrip()
        if not text or text.lstrip().startswith("#"):
            continue
        if text.lstrip().startswith("- "):
            if not isinstance(out.get(key), list):
                out[key] = []
            out[key].append(_scalar(text.lstrip()[2:]))
        else:
            key, _, value = text.partition(":")
            key = key.strip()
            out[key] = _scalar(value) if value.strip() else None
    return out


def _scalar(text: str) -> Any:
    value = text.strip()
    if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1:
        return value[1:-1]
    return {"true": True, "false": False, "null": None, "[]": []}.get(value, value)


def factor_specs(path: str, spark: SparkSession | None = None) -> list:
    """Factor specs from a TOML batch: each prototype's level expression, in Spark SQL over the daily columns, becomes an entry of the catalogue; no code is generated.

    With a session the expressions are resolved against the daily schemas: an unknown column or function is an error, and a
    factor's input tables follow from the columns that it reads (``factors.lanes_of``). Without one they are as declared.
    """
    from tickloom.operators.factors import FactorSpec, lanes_of

    batch = read_toml(path, spark)
    specs = []
    for item in batch.get("prototypes", []):
        missing = {"slug", "level_expression"} - set(item)
        if missing:
            raise ValueError(f"a spec lacks {', '.join(sorted(missing))}")
        lanes = lanes_of(spark, item["level_expression"]) if spark else tuple(item.get("input_tables", ("trades", "orders")))
        specs.append(FactorSpec(item["slug"], item["level_expression"], lanes, batch.get("family", ""), batch.get("universe") == "phase_a_caveat_lane"))
    if double := sorted({s.name for s in specs if sum(t.name == s.name for t in specs) > 1}):
        raise ValueError(f"specs of one name: {', '.join(double)}")
    return specs
