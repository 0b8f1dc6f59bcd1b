"""The queries over the test tables, by name, and their SQL twins. Computed numbers are rounded alike on both sides (sql.places)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import columns
from tickloom.operators import compare, daily, dates, diagnostics, evaluate, factors, information, regimes
from tickloom.operators.universe import restrict
from tickloom.plans import policy, records, sql
from tickloom.plans.views import FRACTION, TOP, Lane
from tickloom.sources import lanes

Query = Callable[[SparkSession, str], DataFrame]
KEY = ["date", "instrument_key"]


def _out(frame: DataFrame, keys: list[str], numbers: list[str]) -> DataFrame:
    return frame.select(*keys, *[F.round(n, sql.places(n)).alias(n) for n in numbers])


def _entry(make: Callable[[Lane], DataFrame], keys: list[str], numbers: list[str], step: str, where: str = "") -> tuple[Query, str]:
    """A query of lane E and its twin, which reads one SQL step."""
    return (lambda spark, sf_dir: _out(make(Lane(spark, sf_dir)), keys, numbers)), sql.rounded(step, keys, numbers, where)


TRADES = ["turnover", "avg_trade_size", "close_like_price", "vwap"]
ORDERS = ["total_order_notional", "churn_ratio"]
STATS = ["mean_rank_ic", "mean_abs_rank_ic", "mean_pearson", "mean_top_bottom_spread", "mean_coverage_ratio", "mean_mutual_info", "mean_nmi", "mean_nmi_ic_gap", "mean_mi_p_value", "mean_mi_excess_over_null", "mi_significant_date_ratio", "sign_consistency"]
PAIR = ["left_factor", "right_factor"]


def _factor(name: str) -> tuple[Query, str]:
    level = next(s for s in factors.SPECS if name in (s.name, s.change))
    needs = set(level.lanes)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lane = Lane(spark, sf_dir)
        found = factors.levels(lane.trades_daily() if "trades" in needs else None, lane.orders_daily() if "orders" in needs else None, lane.raw_daily() if "raw" in needs else None, (level,))
        found = found.where(F.col(level.name).isNotNull())
        if name == level.name:
            return _out(found, KEY, [name])
        return _out(factors.one_day_change(found, lane.steps(), [level.name]), [*KEY, "previous_date"], [level.name, f"previous_{level.name}", level.change])

    if name == level.name:
        return run, sql.rounded("levels", KEY, [name], f"where {name} is not null")
    text = f"""select l.date, l.instrument_key, s.previous_date, round(l.{level.name}, 10) as {level.name}, round(p.{level.name}, 10) as previous_{level.name}, round(l.{level.name} - p.{level.name}, 10) as {level.change}
from levels l join steps s on s.date = l.date join levels p on p.date = s.previous_date and p.instrument_key = l.instrument_key where l.{level.name} is not null and p.{level.name} is not null"""
    return run, sql.query(text)


def _catalogue() -> dict[str, tuple[Query, str | None]]:
    q: dict[str, tuple[Query, str | None]] = {}
    q["daily_trades"] = _entry(Lane.trades_daily, [*KEY, "trade_count", "share_volume"], TRADES, "trades")
    q["daily_orders"] = _entry(Lane.orders_daily, [*KEY, "order_event_count", "unique_order_ids"], ORDERS, "orders_d")
    q["daily_raw"] = _entry(Lane.raw_daily, [*KEY, "trade_count", "buy_count"], ["turnover", "morning_turnover", "afternoon_turnover", "buy_notional", "sell_notional", "trade_size_gini", "interval_cv"], "(select * from raw join gini using (date, instrument_key) join gaps using (date, instrument_key))")
    q["order_trade_daily_join"] = _entry(lambda x: daily.joined_daily(x.trades_daily(), x.orders_daily()), [*KEY, "trade_count", "order_event_count", "unique_order_ids"], [*TRADES, *ORDERS], "(select * from trades join orders_d using (date, instrument_key))")
    q["daily_close_like"] = _entry(lambda x: daily.close_like(x.trades(), F.struct("ts", "row_num_in_file")), KEY, ["close_like_price"], "(select date, instrument_key, last(price order by ts, event_id) as close_like_price from ticks group by all)")
    q["universe_semi_join"] = (
        lambda spark, sf_dir: restrict(lanes.event_trades(spark, sf_dir), lanes.event_universe(spark, sf_dir)).select("date", "instrument_key", "row_num_in_file", "Time", "Price", "Volume", "TradeDir"),
        sql.query('select date, instrument_key, event_id as row_num_in_file, sec as "Time", price as "Price", volume as "Volume", side as "TradeDir" from ticks'),
    )
    q["missing_dates_anti"] = (
        lambda spark, sf_dir: dates.calendar(dates.between(lanes.event_trades(spark, sf_dir))).join(Lane(spark, sf_dir).trades_daily().where(F.dayofmonth("date") % 3 != 0).select("date").distinct(), "date", "left_anti"),
        sql.query("select distinct cast(ts as date) as date from events where cast(ts as date) not in (select date from trades where day(date) % 3 <> 0)"),
    )
    q["calendar_steps"] = (lambda spark, sf_dir: Lane(spark, sf_dir).steps(), sql.query("select * from steps"))

    def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
        ticks = restrict(lanes.line_trades(spark, sf_dir), lanes.line_universe(spark, sf_dir))
        # Sums of cents are cents: rounded first, their ratio is the same on every engine.
        found = daily.trades_daily(ticks, F.col("at")).withColumns({"turnover": F.round("turnover", 4), "share_volume": F.round("share_volume", 4)})
        found = found.withColumn("vwap", F.col("turnover") / F.col("share_volume"))
        return found.select(*KEY, "trade_count", "turnover", "share_volume", "avg_trade_size", "close_like_price", "vwap")

    q["daily_trades_lineitem"] = (lineitem, """select cast(date_trunc('month', l_shipdate) as date) as date, lpad(cast(l_suppkey as varchar), 5, '0') as instrument_key, count(*) as trade_count, round(sum(l_quantity), 4) as share_volume,
  round(sum(l_extendedprice / l_quantity * l_quantity), 4) as turnover, avg(l_quantity) as avg_trade_size,
  last(l_extendedprice / l_quantity order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as close_like_price, round(sum(l_extendedprice / l_quantity * l_quantity), 4) / round(sum(l_quantity), 4) as vwap
from lineitem join supplier on s_suppkey = l_suppkey where s_acctbal > 0 group by all having sum(l_quantity) > 0""")

    def line_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _out(daily.orders_daily(restrict(lanes.line_orders(spark, sf_dir), lanes.line_universe(spark, sf_dir))), [*KEY, "order_event_count", "unique_order_ids"], ORDERS)

    q["daily_orders_lineitem"] = (line_orders, """select cast(date_trunc('month', o_orderdate) as date) as date, lpad(cast(l_suppkey as varchar), 5, '0') as instrument_key, count(*) as order_event_count, count(distinct l_orderkey) as unique_order_ids,
  round(sum(l_extendedprice / l_quantity * l_quantity), 8) as total_order_notional, round(count(*) / count(distinct l_orderkey), 8) as churn_ratio
from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey where s_acctbal > 0 group by all""")
    for name in factors.factor_names():
        q[f"f_{name}"] = _factor(name)
    # The raw lane keeps instruments without volume; what needs no volume-weighted price is the same there otherwise.
    raw = tuple(s for s in factors.SPECS if s.lanes == ("trades",))
    raw_names = [s.name for s in raw]
    q["raw_lane_daily"] = _entry(Lane.raw_lane, [*KEY, "trade_count", "share_volume"], TRADES, "trades_raw")
    q["raw_lane_levels"] = _entry(lambda x: factors.levels(x.raw_lane(), specs=raw), KEY, raw_names, "levels_raw")
    q["raw_lane_changes"] = (
        lambda spark, sf_dir: (lambda x: _out(factors.one_day_change(factors.levels(x.raw_lane(), specs=raw), x.steps(), raw_names), [*KEY, "previous_date"], [f"{n}_change" for n in raw_names]))(Lane(spark, sf_dir)),
        sql.query(f"select l.date, l.instrument_key, s.previous_date, {', '.join(f'round(l.{n} - p.{n}, {sql.places(n + "_change")}) as {n}_change' for n in raw_names)} from levels_raw l join steps s on s.date = l.date join levels_raw p on p.date = s.previous_date and p.instrument_key = l.instrument_key"),
    )
    q["factor_scores_long"] = _entry(Lane.long, ["factor", *KEY], ["score"], "scores")
    q["forward_labels"] = (
        lambda spark, sf_dir: _out(Lane(spark, sf_dir).labels(), ["date", "next_date", "instrument_key", "label_source"], ["close_like_price", "next_close_like_price", evaluate.LABEL]),
        sql.query(f"select date, next_date, instrument_key, 'close_like_price' as label_source, round(close_like_price, 8) as close_like_price, round(next_close_like_price, 8) as next_close_like_price, round(label, 8) as {evaluate.LABEL} from labels"),
    )
    q["score_ranks"] = _entry(lambda x: evaluate.ranked(x.placed()), ["factor", *KEY, "n", "from_top", "from_bottom"], ["score_rank", "label_rank"], "ranked")
    by = ["factor", "date"]
    q["rank_ic_by_date"] = _entry(Lane.per_date, [*by, "labeled_rows"], ["rank_ic"], "per_date")
    q["pearson_by_date"] = _entry(Lane.per_date, by, ["pearson_corr", "mean_label"], "per_date")
    q["top_bottom_spread"] = _entry(Lane.per_date, [*by, "bucket_size"], ["top_mean_return", "bottom_mean_return", "top_bottom_spread"], "per_date")
    q["coverage_by_date"] = _entry(Lane.per_date, [*by, "factor_rows", "labeled_rows"], ["coverage_ratio"], "per_date")
    q["skipped_dates"] = (lambda spark, sf_dir: evaluate.skipped_dates(Lane(spark, sf_dir).scores(), Lane(spark, sf_dir).labels()), sql.query("select distinct date from scores where date not in (select date from labels)"))
    q["factor_ic_summary"] = _entry(lambda x: evaluate.summary(x.per_date()), ["factor", "evaluated_dates", "joined_rows"], STATS[:5], "(select factor, count(*) as evaluated_dates, cast(sum(labeled_rows) as bigint) as joined_rows, avg(rank_ic) as mean_rank_ic, avg(abs(rank_ic)) as mean_abs_rank_ic, avg(pearson_corr) as mean_pearson, avg(top_bottom_spread) as mean_top_bottom_spread, avg(coverage_ratio) as mean_coverage_ratio from per_date group by factor)")
    q["pre_eval_summary"] = _entry(Lane.stats, ["factor", "evaluated_dates", "joined_rows", "evaluated_count", "sign_switch_count"], STATS, "stats")
    q["ic_t_stats"] = _entry(lambda x: evaluate.series_summary(x.per_date()), ["factor", "n", "passed"], ["mean", "std", "t_stat"], "(select factor, n, mean, std, case when n < 2 or std = 0 then 0 else mean / (std / sqrt(n)) end as t_stat, n >= 2 and abs(case when n < 2 or std = 0 then 0 else mean / (std / sqrt(n)) end) >= 2 as passed from (select factor, count(*) as n, avg(rank_ic) as mean, stddev_pop(rank_ic) as std from per_date where rank_ic is not null group by factor))")
    q["mi_by_date"] = _entry(Lane.information, [*by, "n", "bins"], ["mi"], "mi")
    q["nmi_by_date"] = _entry(Lane.information, by, ["nmi", "score_entropy", "label_entropy"], "mi")
    q["mi_permutation_pvalue"] = _entry(lambda x: x.significance().withColumnsRenamed({"p_value": "mi_p_value", "excess_over_null": "mi_excess_over_null"}), [*by, "draws"], ["observed", "mi_p_value", "null_mean", "null_std", "mi_excess_over_null"], "mi_tests")
    q["turnover_entropy_by_date"] = _entry(lambda x: information.turnover_entropy(x.trades_daily()), ["date"], ["market_turnover_entropy"], "entropy")
    q["transfer_entropy_pairs"] = _entry(lambda x: information.transfer_entropy(x.pairs()), ["source", "target", "observations", "bins"], ["te"], "te")
    q["transfer_entropy_pvalue"] = _entry(Lane.te_tests, ["source", "target", "draws"], ["observed", "p_value", "null_mean", "null_std", "excess_over_null"], "te_tests")
    q["lead_lag_edges"] = _entry(lambda x: information.lead_edges(information.transfer_entropy(x.pairs())), ["source", "target", "observations"], ["forward_te", "reverse_te", "lead_gap"], "(select a.source, a.target, a.observations, a.te as forward_te, b.te as reverse_te, a.te - b.te as lead_gap from te a join te b on a.source = b.target and a.target = b.source)")
    q["lead_lag_ranked"] = _entry(lambda x: information.ranked_edges(x.te_tests()), ["rank", "source", "target", "observations", "sample_days", "bins", "draws", "significant", "reverse_significant"], ["forward_te", "p_value", "null_mean", "null_std", "reverse_te", "reverse_p_value", "lead_gap"], "te_ranked")
    q["lead_lag_matrix"] = _entry(lambda x: information.lead_matrix(information.lead_edges(information.transfer_entropy(x.pairs())), factors.factor_names()), ["source"], factors.factor_names(), f"(select source, {', '.join(f"max(te) filter (where target = '{n}') as {n}" for n in factors.factor_names())} from te group by source)")
    q["unordered_pairs"] = (lambda spark, sf_dir: information.unordered_pairs(Lane(spark, sf_dir).long()), sql.query("select a.factor as left_factor, b.factor as right_factor from (select distinct factor from scores) a join (select distinct factor from scores) b on a.factor < b.factor"))
    q["market_stats"] = _entry(lambda x: regimes.market_stats(x.trades_daily()), ["date"], ["market_total_turnover", "market_abs_close_return", "market_turnover_entropy"], "market")
    labels = ["year_grade", "market_turnover_regime", "market_volatility_regime", "entropy_quantile"]
    q["regime_labels"] = _entry(Lane.regimes, ["date", *labels], ["market_total_turnover"], "regimes")
    q["regime_slice_summary"] = _entry(Lane.slices, ["factor", "slice_name", "slice_value", "date_count", "labeled_rows"], ["mean_rank_ic", "mean_abs_rank_ic", "mean_top_bottom_spread", "mean_coverage_ratio", "mean_nmi", "mean_nmi_ic_gap", "mean_mi_p_value", "mi_significant_date_ratio"], "slices")
    q["entropy_regime_digest"] = _entry(lambda x: regimes.entropy_digest(x.slices()), ["factor", "strongest_slice", "weakest_slice"], ["entropy_regime_dispersion"], "digest")
    q["factor_corr_by_date"] = _entry(Lane.correlations, [*PAIR, "date", "common_rows"], ["pearson_corr"], "corrs")
    q["top_overlap_by_date"] = _entry(Lane.overlaps, [*PAIR, "date", "top_overlap_count"], [], "over_counts")
    q["comparison_merge"] = _entry(lambda x: compare.merged_by_date(x.correlations(), x.overlaps()), [*PAIR, "date", "common_rows", "top_overlap_count"], ["pearson_corr"], "(select * from corrs full join over_counts using (left_factor, right_factor, date))")
    q["comparison_means"] = _entry(lambda x: records.pair_means(compare.merged_by_date(x.correlations(), x.overlaps())), PAIR, ["mean_pearson_corr", "mean_top_overlap"], "(select left_factor, right_factor, avg(pearson_corr) as mean_pearson_corr, avg(top_overlap_count) as mean_top_overlap from corrs full join over_counts using (left_factor, right_factor, date) group by all)")
    q["baseline_redundancy"] = _entry(Lane.baseline, ["factor", "baseline_role", "baseline_peer_count"], ["mean_abs_baseline_corr", "mean_baseline_top_overlap"], "baseline")
    q["peer_redundancy"] = _entry(Lane.peers, ["factor"], ["mean_abs_peer_corr", "mean_top_overlap_count"], "peers")
    summary = "count(*) as rows, count(distinct instrument_key) as distinct_instruments, avg(score) as score_mean, min(score) as score_min, max(score) as score_max"
    numbers = ["score_mean", "score_min", "score_max"]
    q["score_summary"] = _entry(lambda x: diagnostics.score_summary(x.scores(), ["factor"]), ["factor", "rows", "distinct_instruments"], numbers, f"(select factor, {summary} from scores group by factor)")
    q["score_summary_by_date"] = _entry(lambda x: diagnostics.score_summary(x.scores(), by), [*by, "rows", "distinct_instruments"], numbers, f"(select factor, date, {summary} from scores group by factor, date)")
    q["top_n_by_date"] = _entry(lambda x: compare.top_rows(x.scores(), 5), ["factor", *KEY, "place"], ["score"], "(select * from tops where place <= 5)")
    q["bottom_n_by_date"] = _entry(lambda x: compare.top_rows(x.scores(), 5, bottom=True), ["factor", *KEY, "place"], ["score"], "(select * from (select *, row_number() over (partition by factor, date order by score, instrument_key) as place from scores) where place <= 5)")

    def clipped(lane: Lane) -> DataFrame:
        z = lane.levels().select(*KEY, columns.zscore("structural_activity_proxy", ["date"]).alias("z")).where(F.col("z").isNotNull())
        return z.withColumn("clipped", columns.clip(F.col("z"), -1.5, 1.5))

    z = lambda c: f"(case when stddev_pop({c}) over (partition by date) = 0 then 0 else ({c} - avg({c}) over (partition by date)) / stddev_pop({c}) over (partition by date) end)"
    q["zscore_clip"] = _entry(clipped, KEY, ["z", "clipped"], f"(select *, least(greatest(z, -1.5), 1.5) as clipped from (select date, instrument_key, {z('structural_activity_proxy')} as z from levels) where z is not null)")
    q["equal_weight_combo"] = _entry(
        lambda x: x.levels().select(*KEY, columns.equal_weight(*[F.col(b) for b in factors.BASELINES]).alias("combo")).where(F.col("combo").isNotNull()), KEY, ["combo"],
        f"(select date, instrument_key, ({' + '.join(factors.BASELINES)}) / {len(factors.BASELINES)} as combo from levels where ({' + '.join(factors.BASELINES)}) is not null)",
    )
    q["backtest_by_date"] = _entry(Lane.backtest, [*by, "row_count", "bucket_size", "selected_count"], ["long_return", "short_return", "spread_return", "turnover_proxy"], "backtest")
    q["backtest_summary"] = _entry(Lane.backtest_summary, ["factor", "joined_rows", "evaluated_dates", "sign_switch_count"], ["coverage_ratio", "gross_long_return", "gross_short_return", "spread_return", "cost_adjusted_spread_return", "turnover_proxy", "hit_rate", "stability_proxy"], "bt_summary")
    q["sign_summary"] = _entry(lambda x: evaluate.sign_summary(x.per_date()), ["factor", "evaluated_count", "signed_count", "positive_count", "negative_count", "zero_count", "dominant_sign", "sign_switch_count"], ["sign_consistency"], "signs")
    q["regime_bucket_means"] = _entry(lambda x: evaluate.bucket_means(x.per_date().join(x.regimes(), "date"), "entropy_quantile", "rank_ic"), ["entropy_quantile"], ["bucket_mean"], "(select entropy_quantile, coalesce(avg(rank_ic), 0) as bucket_mean from per_date join regimes using (date) group by entropy_quantile)")
    q["regime_bucket_spread"] = _entry(lambda x: evaluate.bucket_spread(x.per_date().join(x.regimes(), "date"), "entropy_quantile", "rank_ic"), [], ["bucket_spread"], "(select max(m) - min(m) as bucket_spread from (select coalesce(avg(rank_ic), 0) as m from per_date join regimes using (date) group by entropy_quantile))")
    joined = lambda p: f"'below_{p}:' || array_to_string(below_{p}, ',below_{p}:')"
    q["gate_b_decision"] = (
        lambda spark, sf_dir: policy.gate_decision(Lane(spark, sf_dir).stats()),
        sql.query(f"""select factor, case when len(below_pass) = 0 then 'pass' when len(below_monitor) = 0 then 'monitor' else 'fail' end as decision,
  case when len(below_pass) = 0 then 'stable_statistical_relationship' when len(below_monitor) = 0 then {joined('pass')} else {joined('monitor')} end as reasons,
  case when mean_nmi_ic_gap is null then 'undetermined' when mean_nmi_ic_gap > 0.02 then 'nonlinear_candidate' when mean_nmi_ic_gap < -0.02 then 'mostly_monotonic' else 'mixed_or_linear' end as signal_shape_hint,
  case when mean_rank_ic is null or mean_rank_ic = 0 then 'undetermined' when mean_rank_ic > 0 then 'as_is_candidate' else 'inverse_candidate' end as direction_hint from gated"""),
    )
    reasons = ["factor", "family", "primary_reject_reason", "secondary_reject_reasons", "promotion_readiness"]
    q["reject_reasons"] = (lambda spark, sf_dir: Lane(spark, sf_dir).triaged().select(*reasons), sql.query(f"select {', '.join(reasons)} from triaged"))
    q["reject_histogram"] = (
        lambda spark, sf_dir: policy.reason_histogram(Lane(spark, sf_dir).triaged()),
        sql.query("select reason, count(*) as count from (select unnest(list_concat([primary_reject_reason], string_split(secondary_reject_reasons, ','))) as reason from triaged) where reason not in ('none', '') group by reason"),
    )
    q["family_summary"] = _entry(
        lambda x: policy.family_summary(x.triaged()), ["family", "candidate_count", "shortlisted_count", "watch_count", "rejected_count", "common_failure_modes"],
        ["average_redundancy_profile", "entropy_regime_sensitivity", "significance_quality", "shortlist_rate"],
        """(select t.*, coalesce(m.modes, '') as common_failure_modes from (select family, count(*) as candidate_count, count(*) filter (where promotion_readiness = 'ready') as shortlisted_count, count(*) filter (where promotion_readiness = 'watch') as watch_count,
  count(*) filter (where promotion_readiness = 'reject') as rejected_count, avg(mean_abs_baseline_corr) as average_redundancy_profile, avg(entropy_regime_dispersion) as entropy_regime_sensitivity, avg(mi_significant_date_ratio) as significance_quality,
  count(*) filter (where promotion_readiness = 'ready') / count(*) as shortlist_rate from triaged group by family) t
  left join (select family, string_agg(primary_reject_reason || '=' || n, ',' order by primary_reject_reason || '=' || n) as modes from (select family, primary_reject_reason, count(*) as n from triaged where primary_reject_reason <> 'none' group by all) group by family) m using (family))""",
    )
    hint = "case when baseline_role = 'baseline_anchor' then 'baseline_anchor' when mean_abs_rank_ic is null then 'missing_pre_eval' when mean_abs_baseline_corr is null then 'missing_baseline_compare' when mean_abs_rank_ic >= 0.05 and mean_abs_baseline_corr <= 0.35 then 'potential_incremental' when mean_abs_baseline_corr >= 0.85 then 'likely_redundant' when mean_abs_baseline_corr >= 0.60 then 'review_overlap' else 'mixed' end"
    action = "case when mean_abs_rank_ic is null and mean_nmi is null then 'missing_pre_eval' when mean_abs_rank_ic >= 0.05 and mean_rank_ic < 0 then 'consider_inverse' when (mean_abs_rank_ic >= 0.05 or mean_nmi >= 0.03) and mean_abs_peer_corr <= 0.5 then 'keep_candidate' when mean_abs_rank_ic >= 0.05 or mean_nmi >= 0.03 then 'keep_but_crowded' when mean_abs_rank_ic >= 0.02 or mean_nmi >= 0.015 then 'monitor' else 'discard_candidate' end"
    q["scoreboard"] = _entry(
        Lane.board, ["factor", "family", "baseline_role", "output_rows", "distinct_instruments", "incremental_hint", "recommendation", "promotion_readiness", "primary_reject_reason"],
        ["mean_rank_ic", "mean_abs_rank_ic", "mean_nmi", "mean_abs_baseline_corr", "mean_abs_peer_corr", "mean_top_overlap_count", "entropy_regime_dispersion", "sign_consistency"],
        f"(select *, {hint} as incremental_hint, {action} as recommendation from triaged)",
    )
    q["board_search"] = (
        lambda spark, sf_dir: diagnostics.search(Lane(spark, sf_dir).board(), "CLOSE_vwap", ["close_vwap_pressure", "order_trade_interaction_pressure"]).select("factor", "family"),
        sql.query("select factor, family from triaged where family in ('close_vwap_pressure', 'order_trade_interaction_pressure') and contains(lower(factor), 'close_vwap')"),
    )
    q["latest_rows"] = (
        lambda spark, sf_dir: compare.latest(lanes.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts", "event_id"),
        "select user_id, event_type, event_id, ts from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1",
    )
    return q


_HELD: dict[str, tuple[Query, str | None]] = {}


def _all() -> dict[str, tuple[Query, str | None]]:
    if not _HELD:
        _HELD.update(_catalogue())
    return _HELD


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _all().items() if text}


__all__ = ["FRACTION", "TOP", "oracle_sql", "queries"]
