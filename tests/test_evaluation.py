import datetime as dt

import pytest

from tickloom.operators import backtest, compare, dates, diagnostics, evaluate, information, regimes

D1, D2, D3 = dt.date(2026, 1, 5), dt.date(2026, 1, 6), dt.date(2026, 1, 7)
SCORES = "factor string, date date, instrument_key string, score double"
LABELS = "date date, next_date date, instrument_key string, forward_return_1d_close_like double, label_source string"


def frames(spark, scores, labels):
    s = spark.createDataFrame([("f", d, k, float(v)) for d, k, v in scores], SCORES)
    return s, spark.createDataFrame([(d, None, k, float(v), "x") for d, k, v in labels], LABELS)


def test_labels(spark):
    prices = spark.createDataFrame([(D1, "a", 10.0), (D2, "a", 11.0), (D1, "b", 20.0), (D2, "b", 18.0), (D1, "c", 0.0), (D2, "c", 1.0), (D1, "d", 1.0), (D3, "d", 2.0)], "date date, instrument_key string, close_like_price double")
    out = evaluate.forward_labels(prices, dates.stepped(dates.calendar(prices)))
    got = {(r["date"], r["instrument_key"]): r[evaluate.LABEL] for r in out.collect()}
    assert set(got) == {(D1, "a"), (D1, "b")} and got[D1, "a"] == pytest.approx(0.1) and got[D1, "b"] == pytest.approx(-0.1)


def test_perfect_order(spark):
    rows = [(D1, f"{i:02d}", i) for i in range(10)]
    s, lab = frames(spark, rows, rows)
    day = evaluate.per_date(s, lab, 0.25).first()
    assert day["rank_ic"] == pytest.approx(1) and day["coverage_ratio"] == 1 and day["bucket_size"] == 3
    assert day["top_bottom_spread"] == pytest.approx(8 - 1)
    binned = information.binned(evaluate.labelled(s, lab))
    mi = information.mutual_information(binned).first()
    assert mi["bins"] == 5 and mi["nmi"] == pytest.approx(1) and mi["mi"] > 0
    test = information.mi_significance(binned, 100).first()
    assert test["p_value"] < 0.05 and test["significant"]
    with pytest.raises(ValueError):
        evaluate.per_date(s, lab, 0.9)


def test_constant_and_single_rows_have_no_correlation(spark):
    s, lab = frames(spark, [(D1, "a", 1), (D1, "b", 1), (D2, "a", 1)], [(D1, "a", 1), (D1, "b", 2), (D2, "a", 1)])
    got = {r["date"]: r["rank_ic"] for r in evaluate.per_date(s, lab).collect()}
    assert got == {D1: None, D2: None}
    mi = {r["date"]: r["mi"] for r in information.mutual_information(information.binned(evaluate.labelled(s, lab))).collect()}
    assert mi[D2] is None


def test_weak_dependence_is_not_significant(spark):
    s, lab = frames(spark, [(D1, str(i), v) for i, v in enumerate([1, 2, 3, 4, 5, 6])], [(D1, str(i), v) for i, v in enumerate([2, 5, 1, 6, 3, 4])])
    assert not information.mi_significance(information.binned(evaluate.labelled(s, lab)), 100).first()["significant"]


def test_transfer_entropy_finds_the_leader(spark):
    x = [0, 1, 1, 0, 1, 0, 0, 1, 1, 0]
    rows = [(n, D1 + dt.timedelta(i), float(v)) for i, (a, b) in enumerate(zip(x, [0, *x[:-1]], strict=True)) for n, v in (("x", a), ("y", b))]
    pairs = information.aligned_pairs(spark.createDataFrame(rows, "factor string, date date, value double"))
    te = {(r["source"], r["target"]): r["te"] for r in information.transfer_entropy(pairs, bins=2).collect()}
    assert te["x", "y"] > te["y", "x"]
    edges = information.ordered_by_edge(information.lead_edges(information.transfer_entropy(pairs, bins=2))).first()
    assert (edges["source"], edges["target"]) == ("x", "y")
    p = {(r["source"], r["target"]): r["p_value"] for r in information.te_significance(pairs, 50, bins=2).collect()}
    assert 0 < p["x", "y"] <= 1
    assert information.transfer_entropy(pairs, min_overlap=50).count() == 0


def test_regimes(spark):
    stats = spark.createDataFrame([(D1, 100.0, None, 0.10), (D2, 200.0, 0.02, 0.55), (D3, 300.0, 0.10, 0.90)], "date date, market_total_turnover double, market_abs_close_return double, market_turnover_entropy double")
    rows = {r["date"]: r for r in regimes.regime_labels(stats).collect()}
    one, three = rows[D1], rows[D3]
    assert (one["year_grade"], one["market_turnover_regime"], one["market_volatility_regime"], one["entropy_quantile"]) == ("fine_ok", "low_turnover", "insufficient_history", "q1_low_entropy")
    assert (three["market_turnover_regime"], three["market_volatility_regime"], three["entropy_quantile"]) == ("high_turnover", "high_vol", "q3_high_entropy")
    assert regimes.regime_labels(stats.limit(0)).count() == 0
    dates_ = spark.createDataFrame([("f", D1, 10, 0.2, 0.1, 1.0), ("f", D2, 10, -0.4, 0.3, 0.5)], "factor string, date date, labeled_rows long, rank_ic double, top_bottom_spread double, coverage_ratio double")
    year = regimes.slice_summary(dates_, regimes.regime_labels(stats)).where("slice_name = 'year_grade'").first()
    assert year["date_count"] == 2 and year["mean_abs_rank_ic"] == pytest.approx(0.3) and year["mean_rank_ic"] == pytest.approx(-0.1)


def test_backtest(spark):
    day1 = [("A", 4, .09), ("B", 3, .01), ("C", 2, 0), ("D", 1, -.03)]
    day2 = [("B", 4, .04), ("C", 3, .01), ("D", 2, 0), ("A", 1, -.01)]
    s, lab = frames(spark, [(d, k, v) for d, rows in ((D1, day1), (D2, day2)) for k, v, _ in rows], [(d, k, r) for d, rows in ((D1, day1), (D2, day2)) for k, _, r in rows])
    days = backtest.by_date(s, lab, 0.25)
    got = {r["date"]: r for r in days.collect()}
    assert got[D1]["turnover_proxy"] == 0 and got[D2]["turnover_proxy"] == pytest.approx(2 / 3)
    assert got[D1]["spread_return"] == pytest.approx(.12) and got[D2]["spread_return"] == pytest.approx(.05)
    out = backtest.summary(s, days, 10).first()
    assert (out["joined_rows"], out["evaluated_dates"], out["coverage_ratio"], out["hit_rate"], out["stability_proxy"]) == (8, 2, 1.0, 1.0, 1.0)
    assert out["cost_adjusted_spread_return"] == pytest.approx(.085 - .001 / 3)


def test_comparison_and_redundancy(spark):
    rows = [("a", D1, "1", 1.0), ("a", D1, "2", 2.0), ("a", D2, "1", 1.0), ("b", D1, "1", 2.0), ("b", D1, "2", 4.0), ("b", D2, "1", 3.0)]
    scores = spark.createDataFrame(rows, SCORES)
    got = {r["date"]: (r["common_rows"], r["pearson_corr"]) for r in compare.correlation_by_date(scores).collect()}
    assert got[D1] == (2, pytest.approx(1.0)) and got[D2] == (1, None)
    corr = spark.createDataFrame([("base", "f", D1, 10, .8), ("base", "f", D2, 10, -.6)], "left_factor string, right_factor string, date date, common_rows long, pearson_corr double")
    over = spark.createDataFrame([("base", "f", D1, 9), ("base", "f", D2, 11)], "left_factor string, right_factor string, date date, top_overlap_count long")
    out = {r["factor"]: r for r in compare.baseline_redundancy(corr, over, ("base",)).collect()}
    assert out["f"]["mean_abs_baseline_corr"] == pytest.approx(.7) and out["f"]["mean_baseline_top_overlap"] == 10
    assert out["base"]["baseline_role"] == "baseline_anchor" and out["base"]["mean_abs_baseline_corr"] is None
    assert compare.merged_by_date(corr, over).count() == 2


def test_diagnostics(spark):
    scores = spark.createDataFrame([("f", D1, "a", 1.0), ("f", D1, "b", 3.0), ("f", D2, "a", 2.0)], SCORES)
    assert compare.top_rows(scores, 1).count() == 2 == compare.top_rows(scores, 1, bottom=True).count()
    whole = diagnostics.score_summary(scores, []).first()
    assert (whole["rows"], whole["distinct_instruments"], whole["score_mean"]) == (3, 2, 2.0)
    assert diagnostics.score_summary(scores.limit(0), []).first()["score_mean"] == 0.0


def test_signs(spark):
    rows = [("f", D1 + dt.timedelta(i), v) for i, v in enumerate([.1, 0.0, -.2, None, .3])]
    out = evaluate.sign_summary(spark.createDataFrame(rows, "factor string, date date, rank_ic double")).first()
    assert (out["evaluated_count"], out["positive_count"], out["negative_count"], out["zero_count"], out["dominant_sign"], out["sign_switch_count"]) == (4, 2, 1, 1, "positive", 2)
    assert out["sign_consistency"] == pytest.approx(2 / 3)


def test_queries_draw_as_often_as_the_operators():
    import inspect

    from tickloom.plans import sql

    drawn = lambda f: inspect.signature(f).parameters["permutations"].default
    assert sql.PERMUTATIONS == drawn(information.mi_significance) == 100 and sql.TE_PERMUTATIONS == drawn(information.te_significance) == 200
    assert f"range(1, {sql.PERMUTATIONS + 1}) t(p)" in "".join(sql.STEPS.values()) and f"range(1, {sql.TE_PERMUTATIONS + 1}) t(p)" in sql.STEPS["te_drawn"]


def test_permutations_are_dealt_once(spark):
    rows = spark.createDataFrame([("f", "2024-01-01", f"i{k}", k % 3, k % 2, 3, 9) for k in range(9)], "factor string, date string, instrument_key string, score_bin long, label_bin long, bins long, n long")
    found = information.mi_significance(rows, 5)
    exchanges = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
    assert exchanges and not any("permutation" in line for line in exchanges)
    assert found.first()["draws"] == 5


def test_latest_of_unordered_pairs(spark):
    rows = spark.createDataFrame([("a", "b", 1, "old"), ("b", "a", 2, "new"), ("a", "c", 1, "only")], "left_factor string, right_factor string, at int, what string")
    assert sorted(r["what"] for r in compare.latest_pairs(rows, "at").collect()) == ["new", "only"]
