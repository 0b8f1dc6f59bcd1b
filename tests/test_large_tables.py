import datetime as dt
import hashlib
import math
import random

import pytest

from tickloom.operators import compare, evaluate, factors, information
from tickloom.plans.views import Lane
from tickloom.sources import lanes

D1, D2 = dt.date(2026, 1, 5), dt.date(2026, 1, 6)


def judged(spark, factors=3):
    """Scores with ties and with labels, over factors of two sets of instruments."""
    draw = random.Random(7)
    rows = [(f"f{f}", d, f"i{k:03d}", float(draw.randrange(9)), float(draw.randrange(12))) for f in range(factors) for d in (D1, D2) for k in range(60 if f < 2 else 41)]
    label = {(d, k): v for _, d, k, _, v in rows}
    return spark.createDataFrame([(f, d, k, s, label[d, k]) for f, d, k, s, _ in rows], "factor string, date date, instrument_key string, score double, label double")


def test_rows_are_ordered_twice_in_tasks_that_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "ROWS_A_TASK", 20)
    rows = judged(spark)
    placed = evaluate.dealt(rows, rows.count())
    assert placed.rdd.getNumPartitions() == -(-rows.count() // 20)
    found = evaluate.ranked(placed)
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    assert sum("Sort [" in x for x in lines) == 2 and sum("Exchange" in x for x in lines) == 1
    got = {(r["factor"], r["date"], r["instrument_key"]): r for r in found.collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault((r["factor"], r["date"]), []).append(r)
    for (f, d), held in groups.items():
        up = sorted(held, key=lambda r: (r["score"], r["instrument_key"]))
        down = sorted(held, key=lambda r: (-r["score"], r["instrument_key"]))
        by_label = sorted(held, key=lambda r: (r["label"], r["instrument_key"]))
        for r in held:
            g = got[f, d, r["instrument_key"]]
            assert (g["n"], g["from_bottom"], g["from_top"], g["from_end"], g["by_label"]) == (len(held), up.index(r) + 1, down.index(r) + 1, len(held) - down.index(r), by_label.index(r) + 1)
            less, ties = sum(o["label"] < r["label"] for o in held), sum(o["label"] == r["label"] for o in held)
            assert g["label_rank"] == less + (ties + 1) / 2


def test_permutations_order_a_date_once_for_all_its_sets(spark, monkeypatch):
    """Nulls against brute force, with more tasks and blocks than dates; no sort by a set."""
    monkeypatch.setattr(information, "DRAWS_A_TASK", 50)
    binned = information.binned(evaluate.ranked(judged(spark))).cache()
    sets = information.instrument_sets(binned)
    assert {(r["factor"], r["representative"]) for r in sets.collect()} == {("f0", "f0"), ("f1", "f0"), ("f2", "f2")}
    nulls = information.permuted_information(binned, sets, 30, 120)
    assert not any("Sort [" in x and "__set" in x and "permutation" in x for x in nulls._jdf.queryExecution().executedPlan().toString().split("\n"))
    got = {(r["representative"], r["date"], r["permutation"]): r["mi"] for r in nulls.collect()}
    assert len(got) == 2 * 2 * 30
    groups = {}
    for r in binned.where("factor <> 'f1'").collect():
        groups.setdefault((r["factor"], r["date"]), []).append(r)
    for (f, d), held in groups.items():
        for p in (1, 17, 30):
            order = sorted(held, key=lambda r: hashlib.md5(f"{p}:{d}:{r['instrument_key']}".encode()).hexdigest())
            n, cells, left, right = len(held), {}, {}, {}
            for i, r in enumerate(order):
                b = min(i * r["bins"] // n, r["bins"] - 1)
                for at, key in ((cells, (b, r["label_bin"])), (left, b), (right, r["label_bin"])):
                    at[key] = at.get(key, 0) + 1
            mi = sum(c / n * math.log(c * n / (left[a] * right[b])) for (a, b), c in cells.items())
            assert got[f, d, p] == pytest.approx(mi, abs=1e-12)
    test = {(r["factor"], r["date"]): r for r in information.mi_significance(binned, 30).collect()}
    assert len(test) == 6 and all(r["draws"] == 30 for r in test.values()) and test["f0", D1]["null_mean"] == pytest.approx(test["f1", D1]["null_mean"])
    spark.catalog.clearCache()


def test_tasks_of_the_permutation_test_order_a_bounded_part(spark):
    """Of 100 permutations a block has two at most, and half a million draws go to a task, whatever the number of rows."""
    binned = information.binned(evaluate.ranked(judged(spark)))
    nulls = information.permuted_information(binned, information.instrument_sets(binned), 100, 10_000_000)
    plan = nulls._jdf.queryExecution().optimizedPlan().toString()
    assert "2000" in next(x for x in plan.split("\n") if "RepartitionByExpression" in x and "__block" in x)
    assert -(-100 // information.BLOCKS) <= 2


def test_pairs_are_counted_by_numbers(spark):
    rows = spark.createDataFrame([(D1, "a", 1.0, 2.0, None), (D1, "b", 2.0, 4.5, 1.0), (D1, "c", 4.0, 1.0, 1.0), (D2, "a", 3.0, 3.0, 3.0)], "date date, instrument_key string, z double, y double, x double")
    found = compare.correlation_of_columns(rows, ["z", "y", "x"])
    shuffled = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]
    assert shuffled and not any("factor" in x for x in shuffled)
    got = {(r["left_factor"], r["right_factor"], r["date"]): (r["common_rows"], r["pearson_corr"]) for r in found.collect()}
    assert set(got) == {(a, b, d) for a, b in (("x", "y"), ("x", "z"), ("y", "z")) for d in (D1, D2)}
    assert got["y", "z", D1] == (3, pytest.approx(-2.5 / math.sqrt(6.5 * 14 / 3))) and got["x", "y", D1] == (2, None) and got["x", "z", D2] == (1, None)
    asked = spark.createDataFrame([("x", "z")], "left_factor string, right_factor string")
    assert {(r["left_factor"], r["right_factor"]) for r in compare.correlation_of_columns(rows, ["x", "y", "z"], asked).collect()} == {("x", "z")}


def test_scores_are_read_in_tasks_that_follow_their_number(spark, sf, monkeypatch):
    """Tasks that deal the scores hold a bounded part of them; levels come from the daily rows without a join of their tables."""
    monkeypatch.setattr(evaluate, "ROWS_A_TASK", 1_000)
    lane = Lane(spark, sf)
    rows = lane.judged().count()
    assert rows > 5_000 and lane.judged().rdd.getNumPartitions() >= rows // 1_000
    assert lane.wide().count() * len(lane.names) >= rows
    plan = lane._levels({"trades", "orders", "raw"})._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan
    apart = factors.levels(lane.trades_daily(), lane.orders_daily(), lane.raw_daily())
    assert apart.exceptAll(lane.levels()).count() == 0 and lane.levels().exceptAll(apart).count() == 0
    some = tuple(s for s in factors.SPECS if s.lanes in (("trades",), ("trades", "orders")))
    apart = factors.levels(lane.trades_daily(), lane.orders_daily(), specs=some)
    side = factors.levels_of_tagged(lane.tagged(), some)
    assert apart.exceptAll(side).count() == 0 and side.exceptAll(apart).count() == 0
    lane.close()


def test_ticks_of_one_row_group_are_aggregated_in_several_tasks(spark, sf, tmp_path, monkeypatch):
    """A file that one task reads is dealt out by rows before it is aggregated; the daily rows are the same."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    rows = events.count()
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet(f"{sf}/customer.parquet").write.parquet(str(tmp_path / "customer.parquet"))
    daily = lambda lane: {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in lane.trades_daily().collect()}
    before = daily(Lane(spark, str(tmp_path)))
    assert lanes.event_ticks(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    spark.catalog.clearCache()
    monkeypatch.setattr(lanes, "TICKS_A_TASK", rows // 6)
    dealt = lanes.event_ticks(spark, str(tmp_path)).rdd.glom().map(len).collect()
    assert len(dealt) >= 6 and max(dealt) < rows / 3 and sum(dealt) == rows
    lane = Lane(spark, str(tmp_path))
    assert daily(lane) == before and before
    lane.close()


def test_sets_are_put_side_by_side_in_tasks_that_follow_their_rows(spark, monkeypatch):
    """The hash tables that make a date's instruments wide hold a bounded part of them; the exchange is not left to follow bytes."""
    monkeypatch.setattr(evaluate, "ROWS_A_TASK", 4)
    binned = information.binned(evaluate.ranked(judged(spark)))
    nulls = information.permuted_information(binned, information.instrument_sets(binned), 10, 120)
    plan = nulls._jdf.queryExecution().optimizedPlan().toString().split("\n")
    rows = 2 * (60 + 41)
    assert any("RepartitionByExpression [date" in x and "instrument_key" in x and f"], {-(-rows // 4)}" in x for x in plan)
