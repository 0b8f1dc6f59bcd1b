"""DuckDB twins of the catalogue's queries, built from named steps.

``STEPS`` has each step's text; ``query`` puts the steps that a text needs before it. Numbers are rounded as in the Spark queries.
"""

from __future__ import annotations

import re

from tickloom.operators.factors import BASELINES, PLACES, SPECS, factor_names
from tickloom.operators.universe import UNIVERSE_VERSION
from tickloom.plans.policy import GATE_MONITOR, GATE_NAMES, GATE_OPTIONAL, GATE_PASS, HARD_REASONS, SOFT_REASONS

PERMUTATIONS = 100
TE_PERMUTATIONS = 200


def _duck(expression: str) -> str:
    """A factor's Spark SQL expression in DuckDB's words."""
    out = re.sub(r"(\d)D\b", r"\1", expression)
    out = re.sub(r"try_divide\(([^(),]+), ([^(),]+)\)", r"(cast(\1 as double) / nullif(\2, 0))", out)
    return re.sub(r"log1p\(", "ln(1 + ", out)


def _adaptive(n: str, least: int, most: int) -> str:
    bits = f"case when {n} <= 1 then 0 else length(bin({n} - 1)) end"
    wanted = f"greatest({least}, least({bits} + 1, {most}))"
    return f"case when {n} <= 1 then 1 else greatest(2, least({wanted}, {n}, greatest(2, {n} // 2))) end"


_WIDE_RAW = "d.turnover as raw_turnover, d.trade_count as raw_count, d.morning_turnover, d.afternoon_turnover, d.buy_count, d.buy_notional, d.sell_notional, g.trade_size_gini, b.interval_cv"
_LEVELS = ",\n  ".join(f"case when {' and '.join({'trades': 't_in', 'orders': 'o_in', 'raw': 'r_in'}[lane] for lane in s.lanes)} then round({_duck(s.expression)}, {PLACES}) end as {s.name}" for s in SPECS)
_RAW_LEVELS = ", ".join(f"round({_duck(s.expression)}, {PLACES}) as {s.name}" for s in SPECS if s.lanes == ("trades",))
_CHANGES = ", ".join(f"round(l.{s.name} - p.{s.name}, {PLACES}) as {s.change}" for s in SPECS)

STEPS = {
    "universe": "select lpad(cast(c_custkey as varchar), 5, '0') as instrument_key from customer where c_mktsegment <> 'MACHINERY'",
    "ticks": """select cast(ts as date) as date, lpad(cast(user_id as varchar), 5, '0') as instrument_key, ts, event_id, value as price,
  cast(json_extract_string(props, '$.k') as bigint) as volume, hour(ts) * 3600 + minute(ts) * 60 + second(ts) as sec,
  case event_type when 'purchase' then 1 when 'signup' then 2 else 0 end as side, event_type <> 'error' as is_order
  from events where lpad(cast(user_id as varchar), 5, '0') in (select instrument_key from universe)""",
    "trades": """select date, instrument_key, count(*) as trade_count, sum(price * volume) as turnover, cast(sum(volume) as bigint) as share_volume, avg(volume) as avg_trade_size,
  last(price order by ts, event_id) as close_like_price, sum(price * volume) / nullif(sum(volume), 0) as vwap from ticks group by all having sum(volume) > 0""",
    "trades_raw": """select date, instrument_key, count(*) as trade_count, coalesce(sum(price * volume), 0) as turnover, cast(coalesce(sum(volume), 0) as bigint) as share_volume, avg(volume) as avg_trade_size,
  last(price order by ts, event_id) as close_like_price, sum(price * volume) / nullif(sum(volume), 0) as vwap from ticks group by all""",
    "levels_raw": f"select date, instrument_key, {_RAW_LEVELS} from trades_raw",
    "orders_d": """select date, instrument_key, count(*) as order_event_count, count(distinct volume % 10) as unique_order_ids, sum(price * volume) as total_order_notional,
  count(*) / nullif(count(distinct volume % 10), 0) as churn_ratio from ticks where is_order group by all""",
    "raw": """select date, instrument_key, count(*) as trade_count, sum(price * volume) as turnover,
  coalesce(sum(price * volume) filter (where sec >= 34200 and sec < 43200), 0) as morning_turnover, coalesce(sum(price * volume) filter (where sec >= 46800 and sec < 57600), 0) as afternoon_turnover,
  count(*) filter (where side = 1) as buy_count, coalesce(sum(price * volume) filter (where side = 1), 0) as buy_notional, coalesce(sum(price * volume) filter (where side = 2), 0) as sell_notional
  from ticks group by all""",
    "gini": """select date, instrument_key, case when count(*) <= 1 or sum(v) <= 0 then 0 else (2 * sum(i * v) - (count(*) + 1) * sum(v)) / (count(*) * sum(v)) end as trade_size_gini
  from (select date, instrument_key, price * volume as v, row_number() over (partition by date, instrument_key order by price * volume) as i from ticks) group by all""",
    "gaps": """select date, instrument_key, case when count(*) < 3 or count(*) filter (where gap > 0) < 2 then 0 else stddev_samp(gap) filter (where gap > 0) / avg(gap) filter (where gap > 0) end as interval_cv
  from (select date, instrument_key, sec - lag(sec) over (partition by date, instrument_key order by sec) as gap from ticks) group by all""",
    "days": "select distinct date from ticks",
    "steps": "select date, lag(date) over (partition by year(date) order by date) as previous_date, lead(date) over (partition by year(date) order by date) as next_date from days",
    "levels": f"""select date, instrument_key,
  {_LEVELS} from (select coalesce(t.date, o.date, d.date) as date, coalesce(t.instrument_key, o.instrument_key, d.instrument_key) as instrument_key,
  t.date is not null as t_in, o.date is not null as o_in, d.date is not null as r_in, t.trade_count, t.turnover, t.close_like_price, t.vwap,
  o.order_event_count, o.unique_order_ids, o.total_order_notional, o.churn_ratio, {_WIDE_RAW}
  from raw d left join trades t using (date, instrument_key) left join orders_d o using (date, instrument_key) left join gini g using (date, instrument_key) left join gaps b using (date, instrument_key))""",
    "wide": f"select l.*, {_CHANGES} from levels l left join steps s on s.date = l.date left join levels p on p.date = s.previous_date and p.instrument_key = l.instrument_key",
    "scores": " union all ".join(f"select '{n}' as factor, date, instrument_key, cast({n} as double) as score from wide where {n} is not null" for n in factor_names()),
    "labels": """select c.date, s.next_date, c.instrument_key, c.close_like_price, n.close_like_price as next_close_like_price, n.close_like_price / c.close_like_price - 1 as label
  from trades c join steps s on s.date = c.date join trades n on n.date = s.next_date and n.instrument_key = c.instrument_key where c.close_like_price > 0 and n.close_like_price > 0""",
    "joined": "select factor, s.date, s.instrument_key, score, label from scores s join labels l on l.date = s.date and l.instrument_key = s.instrument_key",
    "ranked": """select *, count(*) over f as n, rank() over (partition by factor, date order by score) + (count(*) over (partition by factor, date, score) - 1) / 2.0 as score_rank,
  rank() over (partition by factor, date order by label) + (count(*) over (partition by factor, date, label) - 1) / 2.0 as label_rank,
  row_number() over (partition by factor, date order by score desc, instrument_key) as from_top, row_number() over (partition by factor, date order by score, instrument_key) as from_bottom,
  row_number() over (partition by factor, date order by score, instrument_key desc) as from_end, row_number() over (partition by factor, date order by label, instrument_key) as by_label
  from joined window f as (partition by factor, date)""",
    "per_date": """select r.*, r.labeled_rows / f.factor_rows as coverage_ratio, top_mean_return - bottom_mean_return as top_bottom_spread, factor_rows from (
  select factor, date, count(*) as labeled_rows, case when stddev_pop(score_rank) = 0 or stddev_pop(label_rank) = 0 then null else round(corr(score_rank, label_rank), 12) end as rank_ic,
  case when stddev_pop(score) = 0 or stddev_pop(label) = 0 then null else round(corr(score, label), 12) end as pearson_corr, avg(label) as mean_label, greatest(1, cast(ceil(max(n) * 0.1) as bigint)) as bucket_size,
  avg(label) filter (where from_top <= greatest(1, ceil(n * 0.1))) as top_mean_return, avg(label) filter (where from_bottom <= greatest(1, ceil(n * 0.1))) as bottom_mean_return from ranked group by all) r
  join (select factor, date, count(*) as factor_rows from scores group by all) f using (factor, date)""",
    "binned": f"""select factor, date, instrument_key, n, bins, least((from_bottom - 1) * bins // n, bins - 1) as score_bin, least((by_label - 1) * bins // n, bins - 1) as label_bin
  from (select *, {_adaptive("n", 4, 16)} as bins from ranked)""",
    "mi": """select factor, date, n, bins, case when n <= 1 then null when hs <= 1e-15 or hl <= 1e-15 then 0 else mi end as mi,
  case when n <= 1 then null when hs <= 1e-15 or hl <= 1e-15 then 0 else mi / greatest(hs, hl) end as nmi, abs(hs) as score_entropy, abs(hl) as label_entropy from (
  select factor, date, any_value(n) as n, any_value(bins) as bins, sum(c / n * ln(c * n / (cs * cl))) as mi, sum(-c / n * ln(cs / n)) as hs, sum(-c / n * ln(cl / n)) as hl from (
  select *, sum(c) over (partition by factor, date, score_bin) as cs, sum(c) over (partition by factor, date, label_bin) as cl from (
  select factor, date, score_bin, label_bin, any_value(n) as n, any_value(bins) as bins, count(*) as c from binned group by factor, date, score_bin, label_bin)) group by factor, date)""",
    "mi_nulls": f"""select factor, date, p, sum(c / n * ln(c * n / (cs * cl))) as mi from (
  select *, sum(c) over (partition by factor, date, p, score_bin) as cs, sum(c) over (partition by factor, date, p, label_bin) as cl from (
  select factor, date, p, score_bin, label_bin, any_value(n) as n, count(*) as c from (
  select factor, date, p, label_bin, n, least((row_number() over (partition by factor, date, p order by md5(p || ':' || cast(date as varchar) || ':' || instrument_key)) - 1) * bins // n, bins - 1) as score_bin
  from binned, range(1, {PERMUTATIONS + 1}) t(p) where n > 1) group by factor, date, p, score_bin, label_bin)) group by factor, date, p""",
    "mi_tests": """select factor, date, o.mi as observed, count(*) as draws, (count(*) filter (where u.mi >= o.mi - 1e-12) + 1) / (count(*) + 1.0) as mi_p_value, avg(u.mi) as null_mean,
  stddev_pop(u.mi) as null_std, o.mi - avg(u.mi) as mi_excess_over_null from mi o join mi_nulls u using (factor, date) group by factor, date, o.mi""",
    "evaluated": """select p.*, m.mi, m.nmi, t.mi_p_value, t.mi_excess_over_null, t.mi_p_value <= 0.05 as mi_significant from per_date p left join mi m using (factor, date) left join mi_tests t using (factor, date)""",
    "signs": """select factor, count(*) as evaluated_count, count(*) filter (where s <> 0) as signed_count, count(*) filter (where s > 0) as positive_count, count(*) filter (where s < 0) as negative_count,
  count(*) filter (where s = 0) as zero_count, case when count(*) filter (where s <> 0) = 0 then 'none' when count(*) filter (where s > 0) >= count(*) filter (where s < 0) then 'positive' else 'negative' end as dominant_sign,
  greatest(count(*) filter (where s > 0), count(*) filter (where s < 0)) / nullif(count(*) filter (where s <> 0), 0) as sign_consistency,
  count(*) filter (where s <> 0 and before is not null and before <> s) as sign_switch_count
  from (select *, case when s <> 0 then lag(s) over (partition by factor, s <> 0 order by date) end as before from (select factor, date, sign(rank_ic) as s from per_date where rank_ic is not null)) group by factor""",
    "stats": """select e.*, s.evaluated_count, s.sign_consistency, s.sign_switch_count from (select factor, count(*) as evaluated_dates, cast(sum(labeled_rows) as bigint) as joined_rows, avg(rank_ic) as mean_rank_ic,
  avg(abs(rank_ic)) as mean_abs_rank_ic, avg(pearson_corr) as mean_pearson, avg(top_bottom_spread) as mean_top_bottom_spread, avg(coverage_ratio) as mean_coverage_ratio, avg(mi) as mean_mutual_info, avg(nmi) as mean_nmi,
  avg(nmi - abs(rank_ic)) as mean_nmi_ic_gap, avg(mi_p_value) as mean_mi_p_value, avg(mi_excess_over_null) as mean_mi_excess_over_null, avg(cast(mi_significant as double)) as mi_significant_date_ratio
  from evaluated group by factor) e left join signs s using (factor)""",
    "entropy": """select date, case when count(*) filter (where turnover > 0) = 0 then null when count(*) filter (where turnover > 0) = 1 then 0 else sum(-p * ln(p)) / ln(count(*) filter (where turnover > 0)) end as market_turnover_entropy
  from (select date, turnover, case when turnover > 0 then turnover / sum(turnover) filter (where turnover > 0) over (partition by date) end as p from trades) group by date""",
    "market": """select d.date, t.market_total_turnover, r.market_abs_close_return, e.market_turnover_entropy from (select distinct date from trades) d
  left join (select date, sum(turnover) as market_total_turnover from trades group by date) t using (date) left join entropy e using (date)
  left join (select c.date, avg(abs(c.close_like_price / p.close_like_price - 1)) as market_abs_close_return from trades c
    join (select date, lag(date) over (order by date) as previous_date from (select distinct date from trades)) s on s.date = c.date
    join trades p on p.date = s.previous_date and p.instrument_key = c.instrument_key and p.close_like_price > 0 group by c.date) r using (date)""",
    "regimes": """select date, market_total_turnover, market_abs_close_return, market_turnover_entropy,
  case year(date) when 2025 then 'coarse_only' when 2026 then 'fine_ok' else 'unknown_year' end as year_grade,
  case when market_total_turnover is null then 'insufficient_history' when market_total_turnover >= median(market_total_turnover) over () then 'high_turnover' else 'low_turnover' end as market_turnover_regime,
  case when market_abs_close_return is null then 'insufficient_history' when market_abs_close_return >= median(market_abs_close_return) over () then 'high_vol' else 'low_vol' end as market_volatility_regime,
  case when market_turnover_entropy is null then 'insufficient_entropy_history' else (case when bins = 1 then ['q1_all_entropy'] when bins = 2 then ['q1_low_entropy', 'q2_high_entropy'] else ['q1_low_entropy', 'q2_mid_entropy', 'q3_high_entropy'] end)[least(place * bins // n, bins - 1) + 1] end as entropy_quantile
  from (select *, count(market_turnover_entropy) over () as n, case when count(market_turnover_entropy) over () <= 1 then 1 else greatest(2, least(3, count(market_turnover_entropy) over ())) end as bins,
  row_number() over (order by market_turnover_entropy nulls last, date) - 1 as place from market)""",
    "slices": """select factor, slice_name, slice_value, count(*) as date_count, cast(sum(labeled_rows) as bigint) as labeled_rows, avg(rank_ic) as mean_rank_ic, avg(abs(rank_ic)) as mean_abs_rank_ic,
  avg(top_bottom_spread) as mean_top_bottom_spread, avg(coverage_ratio) as mean_coverage_ratio, avg(nmi) as mean_nmi, avg(nmi - abs(rank_ic)) as mean_nmi_ic_gap, avg(mi_p_value) as mean_mi_p_value,
  avg(cast(mi_significant as double)) as mi_significant_date_ratio from (select e.*, unnest(['year_grade', 'market_turnover_regime', 'market_volatility_regime', 'entropy_quantile']) as slice_name,
  unnest([year_grade, market_turnover_regime, market_volatility_regime, entropy_quantile]) as slice_value from evaluated e left join regimes r using (date)) where slice_value is not null group by all""",
    "digest": """select factor, max(mean_abs_rank_ic) - min(mean_abs_rank_ic) as entropy_regime_dispersion, first(slice_value order by mean_abs_rank_ic desc, slice_value) as strongest_slice,
  first(slice_value order by mean_abs_rank_ic, slice_value) as weakest_slice, list(mean_abs_rank_ic order by mean_abs_rank_ic desc) as vs from slices where slice_name = 'entropy_quantile' and mean_abs_rank_ic is not null group by factor""",
    "corrs": """select a.factor as left_factor, b.factor as right_factor, a.date, count(*) as common_rows, case when stddev_pop(a.score) = 0 or stddev_pop(b.score) = 0 then null else corr(a.score, b.score) end as pearson_corr
  from scores a join scores b on a.date = b.date and a.instrument_key = b.instrument_key and a.factor < b.factor group by all""",
    "tops": "select * from (select *, row_number() over (partition by factor, date order by score desc, instrument_key) as place from scores) where place <= 20",
    "over_counts": "select a.factor as left_factor, b.factor as right_factor, a.date, count(*) as top_overlap_count from tops a join tops b on a.date = b.date and a.instrument_key = b.instrument_key and a.factor < b.factor group by all",
    "corr2": "select left_factor as factor, right_factor as peer, pearson_corr from corrs union all select right_factor, left_factor, pearson_corr from corrs",
    "over2": "select left_factor as factor, right_factor as peer, top_overlap_count from over_counts union all select right_factor, left_factor, top_overlap_count from over_counts",
    "baseline": f"""select n.factor, case when n.factor in {BASELINES} then 'baseline_anchor' else 'challenger' end as baseline_role,
  case when n.factor in {BASELINES} then {len(BASELINES) - 1} else coalesce(c.k, 0) end as baseline_peer_count, c.v as mean_abs_baseline_corr, o.v as mean_baseline_top_overlap
  from (select distinct factor from corr2) n left join (select factor, count(distinct peer) as k, avg(abs(pearson_corr)) as v from corr2 where peer in {BASELINES} and factor not in {BASELINES} group by factor) c using (factor)
  left join (select factor, avg(top_overlap_count) as v from over2 where peer in {BASELINES} and factor not in {BASELINES} group by factor) o using (factor)""",
    "peers": """select n.factor, coalesce(c.v, 0) as mean_abs_peer_corr, coalesce(o.v, 0) as mean_top_overlap_count from (select distinct factor from corr2) n
  left join (select factor, avg(v) as v from (select factor, peer, avg(abs(pearson_corr)) as v from corr2 group by all) group by factor) c using (factor)
  left join (select factor, avg(v) as v from (select factor, peer, avg(top_overlap_count) as v from over2 group by all) group by factor) o using (factor)""",
    "placed": "select *, greatest(1, cast(floor(n * 0.1) as bigint)) as bucket from ranked",
    "picked": "select factor, date, instrument_key from placed where from_top <= bucket or from_end <= bucket",
    "bt_days": """select d.*, lag(date) over (partition by factor order by date) as previous, lag(selected_count) over (partition by factor order by date) as previous_count from (
  select factor, date, count(*) as row_count, any_value(bucket) as bucket_size, avg(label) filter (where from_top <= bucket) as long_return, avg(label) filter (where from_end <= bucket) as short_return,
  count(*) filter (where from_top <= bucket or from_end <= bucket) as selected_count from placed group by factor, date) d""",
    "backtest": """select d.factor, d.date, row_count, bucket_size, long_return, short_return, round(long_return - short_return, 12) as spread_return,
  case when previous is null then 0 else 1 - coalesce(k.kept, 0) / (selected_count + previous_count - coalesce(k.kept, 0)) end as turnover_proxy, selected_count from bt_days d
  left join (select a.factor, a.date, count(*) as kept from picked a join bt_days d on d.factor = a.factor and d.date = a.date join picked b on b.factor = a.factor and b.date = d.previous and b.instrument_key = a.instrument_key group by all) k
  on k.factor = d.factor and k.date = d.date""",
    "bt_signs": """select factor, greatest(count(*) filter (where s > 0), count(*) filter (where s < 0)) / nullif(count(*) filter (where s <> 0), 0) as stability_proxy,
  count(*) filter (where s <> 0 and before is not null and before <> s) as sign_switch_count from (
  select *, case when s <> 0 then lag(s) over (partition by factor, s <> 0 order by date) end as before from (select factor, date, sign(spread_return) as s from backtest)) group by factor""",
    "bt_summary": """select b.*, joined_rows / t.n as coverage_ratio, stability_proxy, sign_switch_count from (select factor, cast(sum(row_count) as bigint) as joined_rows, count(*) as evaluated_dates, avg(long_return) as gross_long_return,
  avg(short_return) as gross_short_return, avg(spread_return) as spread_return, avg(spread_return) as cost_adjusted_spread_return, avg(turnover_proxy) as turnover_proxy, avg(cast(spread_return > 0 as double)) as hit_rate from backtest group by factor) b
  join (select factor, count(*) as n from scores group by factor) t using (factor) left join bt_signs s using (factor)""",
    "catalogue": " union all ".join(f"select '{n}' as factor, '{s.family}' as family, {str(s.caveat).lower()} as caveat" for s in SPECS for n in (s.name, s.change)),
    "instruments": "select factor, count(distinct instrument_key) as distinct_instruments, count(*) as output_rows from scores group by factor",
}


def _reasons() -> tuple[str, str]:
    tests = {
        "universe_mismatch": "false", "caveat_dependence_too_high": "caveat", "low_coverage": "mean_coverage_ratio < 0.85",
        "insufficient_significance": "coalesce(mi_significant_date_ratio < 0.5, false) or coalesce(mean_mi_p_value > 0.05, false)",
        "weak_ic": "coalesce(mean_abs_rank_ic < 0.04, false) or coalesce(spread_return <= 0, false)", "weak_nmi": "mean_nmi < 0.005",
        "inverse_candidate_only": "not coalesce(mean_abs_rank_ic < 0.04, false) and mean_abs_rank_ic >= 0.04 and mean_rank_ic < 0 and mean_top_bottom_spread < 0",
        "unstable_across_dates": "coalesce(sign_consistency < 0.6, false) or coalesce(hit_rate < 0.55, false) or coalesce(stability_proxy < 0.6, false)",
        "narrow_entropy_regime_only": "len(vs) >= 2 and vs[1] >= 0.04 and vs[1] - vs[2] >= 0.05 and vs[2] < vs[1] * 0.5",
        "high_redundancy_to_baseline": "coalesce(mean_abs_baseline_corr >= 0.6, false) or coalesce(turnover_proxy > 0.75, false)",
    }
    listed = lambda names: "list_filter([" + ", ".join(f"case when coalesce({tests[n]}, false) then '{n}' end" for n in names) + "], lambda x: x is not null)"
    return listed(HARD_REASONS), listed(SOFT_REASONS)


STEPS["triaged"] = f"""select *, coalesce(list_concat(hard, soft)[1], 'none') as primary_reject_reason, array_to_string(list_concat(hard, soft)[2:], ',') as secondary_reject_reasons,
  case when len(hard) > 0 then 'reject' when len(soft) > 0 then 'watch' else 'ready' end as promotion_readiness from (
  select c.factor, c.family, c.caveat, s.* exclude (factor), b.* exclude (factor), p.* exclude (factor), d.* exclude (factor), i.* exclude (factor), t.hit_rate, t.stability_proxy, t.spread_return, t.turnover_proxy, {_reasons()[0]} as hard, {_reasons()[1]} as soft
  from catalogue c join stats s using (factor) left join baseline b using (factor) left join peers p using (factor) left join digest d using (factor) left join instruments i using (factor) left join bt_summary t using (factor))"""


def _gate(limits: dict[str, float]) -> str:
    def test(metric: str, limit: float) -> str:
        missing = "" if metric == GATE_OPTIONAL else f"{metric} is null or "
        return f"case when {missing}coalesce({metric} < {limit!r}, false) then '{GATE_NAMES.get(metric, metric)}' end"

    return "list_filter([" + ", ".join(test(m, x) for m, x in limits.items()) + "], lambda x: x is not null)"


STEPS["gated"] = f"select *, {_gate(GATE_PASS)} as below_pass, {_gate(GATE_MONITOR)} as below_monitor from stats"
STEPS["series"] = "select factor, date, rank_ic as value from per_date where rank_ic is not null"
STEPS["pairs"] = """select a.factor as source, b.factor as target, a.date, a.value as x, b.value as y, row_number() over (partition by a.factor, b.factor order by a.date) as i, count(*) over (partition by a.factor, b.factor) as dates
  from series a join series b on a.date = b.date and a.factor <> b.factor"""


def _te(rows: str, by: str) -> str:
    place = lambda c: f"least((row_number() over (partition by {by} order by {c}, i) - 1) * bins // n, bins - 1)"
    return f"""select {by}, sum(c / n * ln(c * v / (vu * wv))) as te, any_value(n) as observations, any_value(bins) as bins from (
  select *, sum(c) over (partition by {by}, vb, ub) as vu, sum(c) over (partition by {by}, wb, vb) as wv, sum(c) over (partition by {by}, vb) as v from (
  select {by}, ub, vb, wb, any_value(n) as n, any_value(bins) as bins, count(*) as c from (
  select *, {place("u")} as ub, {place("v")} as vb, {place("w")} as wb from (select *, {_adaptive("n", 2, 8)} as bins from (select *, count(*) over (partition by {by}) as n from (
  select * from (select {by}, i, lag(x, 1) over o as u, lag(y, 1) over o as v, y as w from {rows} window o as (partition by {by} order by i)) where i > 1)))) group by {by}, ub, vb, wb)) group by {by}"""


STEPS["enough"] = "select * from pairs where dates >= 5"
STEPS["te"] = _te("enough", "source, target")
STEPS["te_drawn"] = f"select *, row_number() over (partition by source, target, p order by md5(p || ':' || source || ':' || cast(date as varchar))) as place from enough, range(1, {TE_PERMUTATIONS + 1}) t(p)"
STEPS["te_moved"] = "select a.source, a.target, a.p, a.i, a.y, b.x from te_drawn a join te_drawn b on a.source = b.source and a.target = b.target and a.p = b.p and a.i = b.place"
STEPS["te_nulls"] = _te("te_moved", "source, target, p")
STEPS["te_tests"] = """select source, target, o.te as observed, count(*) as draws, (count(*) filter (where u.te >= o.te - 1e-12) + 1) / (count(*) + 1.0) as p_value, avg(u.te) as null_mean,
  stddev_pop(u.te) as null_std, o.te - avg(u.te) as excess_over_null from te o join te_nulls u using (source, target) group by source, target, o.te"""

STEPS["te_ranked"] = """select row_number() over (order by significant desc, lead_gap desc, source, target) as rank, * from (
  select a.source, a.target, o.observations, o.observations + 1 as sample_days, o.bins, a.draws, a.p_value <= 0.05 as significant, b.p_value <= 0.05 as reverse_significant, a.observed as forward_te, a.p_value, a.null_mean, a.null_std,
  b.observed as reverse_te, b.p_value as reverse_p_value, round(a.observed - b.observed, 10) + 0 as lead_gap
  from te_tests a join te_tests b on b.source = a.target and b.target = a.source join te o on o.source = a.source and o.target = a.target)"""


def query(text: str) -> str:
    """The text behind the steps that it reads, directly or not."""
    order: list[str] = []

    def need(part: str) -> None:
        for name in re.findall(r"\b(?:from|join)\s+([a-z_0-9]+)", part):
            if name in STEPS and name not in order:
                need(STEPS[name])
                order.append(name)

    need(text)
    steps = ",\n".join(f"{name} as materialized ({STEPS[name]})" for name in order)
    return f"with {steps}\n{text}" if steps else text


#: Columns that come rounded already are not rounded to fewer places: a second rounding would meet ties.
_FINE = {"score_mean": 7, "score": PLACES, "score_min": PLACES, "score_max": PLACES, "combo": 12} | {p + n: PLACES for n in factor_names() for p in ("", "previous_")}


def places(column: str) -> int:
    """Decimal places that a query gives of a column."""
    return _FINE.get(column, 8)


def rounded(step: str, keys: list[str], numbers: list[str], where: str = "") -> str:
    return query(f"select {', '.join([*keys, *(f'round({n}, {places(n)}) as {n}' for n in numbers)])} from {step} {where}")


VERSION = UNIVERSE_VERSION
