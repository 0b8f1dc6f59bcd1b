"""Triage of a stored scoreboard: reject reasons, readiness, families and next steps, from the scoreboard's artifact alone or with exported labels."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import backtest
from tickloom.plans import policy, records
from tickloom.plans.store import Store
from tickloom.sources import logs

FRACTION = 0.1
BACKTEST = ("hit_rate", "stability_proxy", "spread_return", "turnover_proxy")
SNAPSHOT = ("mean_rank_ic", "mean_abs_rank_ic", "mean_nmi", "mean_top_bottom_spread", "mean_coverage_ratio", "mean_abs_baseline_corr", "mi_significant_date_ratio", "mean_mi_p_value", "entropy_regime_dispersion", "sign_consistency", *("spread_return", "turnover_proxy", "hit_rate", "stability_proxy"))


def retested(board: DataFrame, scores: DataFrame, labels: DataFrame) -> DataFrame:
    """The board with its backtest columns made anew from scores and labels."""
    tested = backtest.summary(scores, backtest.by_date(scores, labels, FRACTION)).select("factor", *BACKTEST)
    return board.drop(*BACKTEST).join(tested, "factor", "left")


def run(spark: SparkSession, root: str, summary: str, labels_path: str | None = None, notes: str = "", store: Store | None = None, keys: dict[str, str] | None = None) -> dict[str, Any]:
    """Triages the scoreboard of a summary file; writes its rows, report and log entries under ``root``.

    With a labels path the backtest is run over the stored scores of the board's runs, whose keys the summary names. Without one the backtest's columns
    are the board's own; a board without them is triaged without a backtest.
    """
    payload = records.scoreboard(spark, summary)
    board = payload["board"]
    if board.isEmpty():
        raise ValueError(f"{summary} has no factors")
    scoreboard_id = payload["scoreboard_id"]
    if labels_path:
        store = store or Store(spark, root)
        held = keys or {r["factor"]: r["run_key"] for r in board.select("factor", "run_key").where("run_key is not null").collect()}
        board = retested(board, store.get("scores", held.values()), spark.read.parquet(labels_path))
    tested = all(c in board.columns for c in BACKTEST)
    rows = policy.reject_reasons(board.drop("primary_reject_reason", "secondary_reject_reasons", "promotion_readiness"), tested)
    triage_id, made = f"triage_{uuid.uuid4().hex[:12]}", datetime.now(UTC).isoformat()
    path = f"{root}/{triage_id}/triage"
    policy.board_order(rows).coalesce(1).write.parquet(path)  # a row a factor
    rows = spark.read.parquet(path)
    histogram = {r["reason"]: r["count"] for r in policy.reason_histogram(rows).collect()}
    by_state = {state: [r["factor"] for r in policy.board_order(rows.where(F.col("promotion_readiness") == state)).select("factor").collect()] for state in ("ready", "watch", "reject")}
    total = sum(map(len, by_state.values()))
    stamp = lambda frame, **values: frame.withColumns({"created_at": F.lit(made), "notes": F.lit(notes), **{k: F.lit(v) for k, v in values.items()}})
    listed = lambda c: F.to_json(F.filter(F.split(c, ","), lambda r: r != ""))
    reasons = rows.drop("family_name").withColumnsRenamed({"factor": "factor_name", "family": "family_name"}).withColumns({"secondary_reject_reasons_json": listed("secondary_reject_reasons"), "metrics_snapshot_json": logs.as_json(*[c for c in SNAPSHOT if c in rows.columns])})
    logs.append_log(stamp(reasons, triage_id=triage_id, pre_eval_id=scoreboard_id, scoreboard_id=scoreboard_id, run_dir=f"{root}/{scoreboard_id}"), root, "reject_reason_log", triage_id)
    families = policy.family_summary(rows).withColumnsRenamed({"family": "family_name", "common_failure_modes": "common_failure_modes_json"}).withColumn("promotion_ready_count", F.col("shortlisted_count"))
    logs.append_log(stamp(families.withColumn("common_failure_modes_json", listed("common_failure_modes_json")), triage_id=triage_id), root, "family_performance_summary", triage_id)
    out = {"triage_id": triage_id, "scoreboard_id": scoreboard_id, "path": path, "shortlisted": by_state["ready"], "watched": by_state["watch"], "rejected": by_state["reject"], "reasons": histogram, "next_steps": policy.next_steps(histogram, total)}
    logs.write_json(out | {"created_at": made, "notes": notes, "scoreboard_summary_path": summary, "candidate_count": total}, f"{root}/{triage_id}/triage_summary.json", spark)
    lines = [f"# Triage {triage_id}", "", f"- scoreboard: `{scoreboard_id}`", f"- candidates: {total}", *(f"- {state}: {', '.join(names) or 'none'}" for state, names in by_state.items()), "", "| reason | count |", "|---|---|", *(f"| {r} | {n} |" for r, n in histogram.items()), "", *(f"- {step}" for step in out["next_steps"])]
    logs.write_text(spark, "\n".join(lines) + "\n", f"{root}/{triage_id}/triage_report.md")
    return out
