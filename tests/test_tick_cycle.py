"""Cycles over partitioned tick tables: dates from folders, daily tables kept by date, stored runs, configuration, triage, logs."""

import json
import os
import tomllib

import pytest
from pyspark.sql import functions as F

from tickloom import cli
from tickloom.operators import evaluate, factors, information, shape
from tickloom.plans import cycle, records, triage
from tickloom.plans.store import Store
from tickloom.plans.views import Lane, TickLane
from tickloom.sources import lanes, logs, ticks


def write_ticks(spark, sf, path, until):
    frame = lanes.event_ticks(spark, sf).where(f"date < '{until}'").withColumn("source_file", F.concat(F.lit("trade/"), "instrument_key", F.lit(".csv"))).drop("instrument_key", "ts").withColumn("year", F.year("date"))
    frame.drop("OrderId", "is_order").coalesce(1).write.partitionBy("year", "date").parquet(f"{path}/verified_trades")
    frame.where("is_order").drop("is_order").coalesce(1).write.partitionBy("year", "date").parquet(f"{path}/verified_orders")
    return path


@pytest.fixture(scope="module")
def root(spark, sf, tmp_path_factory):
    return write_ticks(spark, sf, str(tmp_path_factory.mktemp("tables")), "2024-01-08")


def rows(frame):
    return sorted(map(str, frame.collect()))


def test_dates_come_from_folders_and_manifests(spark, tmp_path):
    for day in ("2024-01-02", "2024-01-03"):
        os.makedirs(tmp_path / "verified_trades" / "year=2024" / f"date={day}")
        (tmp_path / "verified_trades" / "year=2024" / f"date={day}" / "part-00000.parquet").write_text("no parquet at all")
    root = str(tmp_path)
    assert ticks.partition_dates(spark, root, "verified_trades") == ["2024-01-02", "2024-01-03"]
    assert ticks.partition_dates(spark, root, "verified_trades", [2023]) == [] == ticks.partition_dates(spark, root, "verified_orders")
    os.makedirs(tmp_path / "manifests" / "year=2024")
    (tmp_path / "manifests" / "year=2024" / "summary.json").write_text(json.dumps({"tables": {"verified_trades": {"dates": ["2024-01-05", "2023-12-29"]}, "verified_orders": {"dates": ["2024-01-09"]}}}))
    listed = lambda table, year, manifest=None: [str(r["date"]) for r in ticks.available_dates(spark, root, table, year, manifest).collect()]
    assert listed("verified_trades", 2024) == ["2024-01-02", "2024-01-03", "2024-01-05"] and listed("verified_orders", 2024) == ["2024-01-09"]
    (tmp_path / "own.json").write_text(json.dumps({"dates": ["2023-05-05"]}))
    assert listed("verified_trades", 2023, f"file://{root}/own.json") == ["2023-05-05"]
    with pytest.raises(ValueError):
        ticks.available_dates(spark, root, "verified_trades", 1999)
    with pytest.raises(ValueError):
        ticks.partition_dates(spark, root, "nothing")


def test_versions_follow_the_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_text("1")
    first = ticks.data_version(spark, [str(tmp_path / "a")])
    assert first == ticks.data_version(spark, [f"file://{tmp_path}/a"])
    (tmp_path / "a" / "y").write_text("2")
    assert first != ticks.data_version(spark, [str(tmp_path / "a")])


def test_only_missing_dates_are_aggregated(spark, sf, tmp_path):
    root = write_ticks(spark, sf, str(tmp_path), "2024-01-06")
    days = ticks.partition_dates(spark, root, "verified_trades", [2024])
    universe = lanes.event_universe(spark, sf)
    for table in ticks.DAILY_TABLES:
        want = rows(ticks.aggregated(spark, root, table, days, universe))
        assert rows(ticks.daily_rows(spark, root, table, days, universe)) == want  # nothing is held
        ticks.write_daily(spark, root, table, ticks.load(spark, root, ticks.MADE_OF[table][0], [d for d in days if d != days[1]]))
        mixed = ticks.daily_rows(spark, root, table, days, universe)
        read = {f.split("date=")[1][:10] for f in mixed.inputFiles() if f"/{ticks.MADE_OF[table][0]}/" in f}
        assert read == {days[1]} and rows(mixed) == want
        before = {p: os.path.getmtime(p) for p in map(str, tmp_path.glob(f"{table}/*/*/part-*"))}
        filled = ticks.daily_rows(spark, root, table, days, universe, fill=True)
        assert not [f for f in filled.inputFiles() if f"/{ticks.MADE_OF[table][0]}/" in f] and rows(filled) == want
        after = {p: os.path.getmtime(p) for p in map(str, tmp_path.glob(f"{table}/*/*/part-*"))}
        assert before.items() <= after.items() and {p.split("date=")[1][:10] for p in set(after) - set(before)} == {days[1]}


def test_universe_sidecar(spark, tmp_path, root, capsys):
    path = str(tmp_path / "universe")
    assert ticks.universe_status(spark, path) == {"path": path, "ready": False, "instruments": 0, "members": 0}
    frame = spark.createDataFrame([("a", False), ("a", True), ("b", False), ("c", None), (None, True)], "instrument_key string, stock_research_candidate boolean")
    frame.write.parquet(str(tmp_path / "source"))
    assert cli.main(["universe", path, "--source", str(tmp_path / "source")]) == 0
    assert ticks.universe_status(spark, path)["members"] == 1 and ticks.universe_status(spark, path)["instruments"] == 3
    with pytest.raises(FileNotFoundError):
        cli.main(["ticks", root, str(tmp_path / "out"), "2024", "--universe", str(tmp_path / "absent")])
    bare = TickLane(spark, root, [2024])
    assert (bare.target, bare.version) == ("all_instruments", "")
    assert TickLane(spark, root, [2024], spark.read.parquet(path)).version


def test_counting_before_ordering(spark, sf):
    """Ticks are aggregated in their own partitions before any window orders them, and one instrument's values lie in several ranges."""
    frame = lanes.event_trades(spark, sf)
    for made in (shape.gini(frame), shape.burstiness(frame)):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        lines = plan.split("\n")
        last = lambda word: max(i for i, x in enumerate(lines) if word in x)
        assert last("Window") < last("partial_count") < last("Scan")
    values = spark.createDataFrame([(v,) for v in (-8.0, -1.0, -0.25, 0.0, 1e-300, 0.5, 0.51, 1.0, 3.0, 1e300)], "v double")
    found = [r["r"] for r in values.select("v", shape.value_range(F.col("v")).alias("r")).orderBy("v").collect()]
    assert found == sorted(found) and len(set(found)) > 7


def test_one_pass_makes_all_daily_tables(spark, sf):
    lane = Lane(spark, sf)
    plan = lane.tagged()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # events, and the universe
    assert lane.trades_daily().count() and lane.orders_daily().count() and lane.raw_daily().count()
    lane.close()
    assert not lane._persisted and not lane._paths


def test_permutations_are_made_once_for_equal_instruments(spark, sf):
    lane = Lane(spark, sf)
    binned = lane.binned().where("n > 1")
    sets = information.instrument_sets(binned)
    members = {(r["factor"], r["date"]): tuple(r["m"]) for r in binned.groupBy("factor", "date").agg(F.sort_array(F.collect_list("instrument_key")).alias("m")).collect()}
    held = {(r["factor"], r["date"]): r["representative"] for r in sets.collect()}
    assert all(members[f, d] == members[r, d] for (f, d), r in held.items())
    assert len({(r, d) for (_, d), r in held.items()}) == len({(m, d) for (_, d), m in members.items()}) < len(held) / 3
    lane.close()


def test_expressions_are_checked(spark, tmp_path):
    assert factors.lanes_of(spark, "log1p(turnover)") == ("trades",) and factors.lanes_of(spark, "churn_ratio / interval_cv") == ("orders", "raw")
    assert all(factors.lanes_of(spark, s.expression) == s.lanes for s in factors.SPECS)
    for wrong in ("turn_over + 1", "no_such_function(turnover)", "turnover +"):
        with pytest.raises(ValueError):
            factors.lanes_of(spark, wrong)
    (tmp_path / "s.toml").write_text('family = "f"\n[[prototypes]]\nslug = "s"\nlevel_expression = "churn_ratio"\n')
    assert logs.factor_specs(f"file://{tmp_path}/s.toml", spark)[0].lanes == ("orders",)


CONFIG = """
version = "v1"
owner = "o"
anchor_dates = ["2024-01-03", "2024-01-04"]
baselines = "{root}/registry.toml"
batches = ["{root}/batch.toml"]
families = "{root}/families"
[selection]
min_abs_rank_ic_keep = 0.01
[[candidates]]
factor = "structural_activity_proxy"
[[candidates]]
factor = "churn_twice"
[[candidates]]
factor = "gap"
module = "close_vwap_gap_intensity"
transform = "one_day_difference"
"""


@pytest.fixture(scope="module")
def made(spark, sf, root, tmp_path_factory):
    out = tmp_path_factory.mktemp("cycle")
    (out / "registry.toml").write_text('default_baselines = ["structural_activity_proxy"]\n[groups.base]\nfactors = ["structural_activity_proxy"]\n')
    (out / "batch.toml").write_text('family = "own"\n[[prototypes]]\nslug = "churn_twice"\nlevel_expression = "2 * log1p(churn_ratio)"\n')
    (out / "families").mkdir()
    (out / "families" / "own.yaml").write_text("family_name: Own\nknown_failure_modes:\n  - weak_ic\n")
    (out / "c.toml").write_text(CONFIG.format(root=out))
    lanes.event_universe(spark, sf).write.parquet(str(out / "universe"))
    days = ticks.partition_dates(spark, root, "verified_trades")
    for table in ticks.DAILY_TABLES:  # one date is not cached
        ticks.write_daily(spark, root, table, ticks.load(spark, root, ticks.MADE_OF[table][0], [d for d in days if d != "2024-01-04"]))
    lane, config = tick_lane(spark, root, out)
    return out, cycle.run(spark, root, str(out), lane=lane, config=config)


def tick_lane(spark, root, out, text=None):
    config = cycle.CycleConfig.of(spark, logs.read_toml(str(out / "c.toml")) if text is None else tomllib.loads(text))
    return TickLane(spark, root, [2024], spark.read.parquet(str(out / "universe")), True, **config.options()), config


def test_a_configured_cycle(spark, sf, root, made):
    out, found = made
    assert found["factors"] == 3 and {e["mode"] for e in found["inventory"]} == {"new"} and found["new_comparisons"] == 3
    assert "2024-01-04" in ticks.partition_dates(spark, root, "verified_trades_daily")
    board = {r["factor"]: r for r in spark.read.parquet(found["board"]).collect()}
    assert set(board) == {"structural_activity_proxy", "churn_twice", "close_vwap_gap_intensity_change"}
    assert board["structural_activity_proxy"]["baseline_role"] == "baseline_anchor" and board["structural_activity_proxy"]["baseline_group"] == "base"
    own = board["churn_twice"]
    assert own["family_name"] == "Own" and own["known_failure_modes"] == "weak_ic" and own["baseline_peer_count"] == 1 and own["universe_filter_version"]
    assert board["close_vwap_gap_intensity_change"]["transform_chain"].endswith("one_day_difference")
    scores = Store(spark, str(out)).get("scores", [e["key"] for e in found["inventory"]])
    assert {str(r["date"]) for r in scores.select("date").distinct().collect()} == {"2024-01-03", "2024-01-04"}
    full = Lane(spark, sf)
    want = full.long().where("factor = 'close_vwap_gap_intensity_change' and date in ('2024-01-03', '2024-01-04')").select("date", "instrument_key", F.round("score", 8))
    assert rows(scores.where("factor = 'close_vwap_gap_intensity_change'").select("date", "instrument_key", F.round("score", 8))) == rows(want)
    full.close()
    assert len(found["reports"]) == 4 and all(logs.read_text(spark, p).startswith("# ") for p in found["reports"])
    assert [r["factor_name"] for r in cycle.recent(spark, str(out))] == sorted(board)


def test_equal_cycles_reuse_their_runs(spark, root, made, monkeypatch):
    out, first = made
    lane, config = tick_lane(spark, root, out)

    def no(*_, **__):
        raise AssertionError("evaluated again")

    for module, name in ((evaluate, "per_date"), (information, "mi_significance"), (factors, "wide_factors"), (shape, "raw_statistics")):
        monkeypatch.setattr(module, name, no)
    again = cycle.run(spark, root, str(out), lane=lane, config=config)
    assert {e["mode"] for e in again["inventory"]} == {"reused"} and again["new_comparisons"] == 0
    assert {e["run_id"] for e in again["inventory"]} == {first["run_id"]}
    ignore = ("recommendation_reason",)
    assert rows(spark.read.parquet(again["board"]).drop(*ignore)) == rows(spark.read.parquet(first["board"]).drop(*ignore))


def test_one_new_factor_runs_alone(spark, root, made):
    out, _ = made
    text = (out / "c.toml").read_text() + '[[candidates]]\nfactor = "structural_activity_change"\n'
    lane, config = tick_lane(spark, root, out, text)
    more = cycle.run(spark, root, str(out), lane=lane, config=config)
    assert [e["factor"] for e in more["inventory"] if e["mode"] == "new"] == ["structural_activity_proxy_change"] and more["new_comparisons"] == 3
    assert spark.read.parquet(more["board"]).count() == 4


def test_triage_of_a_stored_scoreboard(spark, root, made):
    out, found = made
    columns = ["factor", "primary_reject_reason", "secondary_reject_reasons", "promotion_readiness"]
    own = spark.read.parquet(f"{out}/{found['triage_id']}/triage").select(*columns)
    again = triage.run(spark, str(out), found["summary"])
    assert again["reasons"] == found["reasons"] and rows(spark.read.parquet(again["path"]).select(*columns)) == rows(own) == rows(spark.read.parquet(found["board"]).select(*columns))
    lane, _ = tick_lane(spark, root, out)
    labels = f"{out}/labels"
    lane.labels().write.parquet(labels)
    lane.close()
    assert rows(spark.read.parquet(triage.run(spark, str(out), found["summary"], labels)["path"]).select(*columns)) == rows(own)
    held = records.scoreboard(spark, found["summary"])
    assert held["per_date"].count() == 6 and held["comparisons"].groupBy("left_factor", "right_factor").count().count() == 3 and held["regime_slices"].count() > 0
    assert logs.read_log(spark, str(out), "reject_reason_log").where(F.col("triage_id") == again["triage_id"]).count() == 3
    with pytest.raises(ValueError):
        logs.write_json({"scoreboard_id": "x", "factor_board": []}, f"{out}/none.json", spark)
        triage.run(spark, str(out), f"{out}/none.json")


@pytest.mark.parametrize("text", ['[[candidates]]\nfactor = "nothing"', '[[candidates]]\nfactor = "order_lifecycle_churn"\ntransform = "squared"', '[[candidates]]\nfactor = "order_lifecycle_churn"\n[[candidates]]\nfactor = "order_lifecycle_churn"', '[[candidates]]\nfactor = "order_lifecycle_churn"\ntransform = "one_day_difference"'])
def test_wrong_configurations(spark, text):
    with pytest.raises(ValueError):
        cycle.CycleConfig.of(spark, tomllib.loads(text))


def test_an_entry_is_appended_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    row = spark.createDataFrame([("g1", "t1")], "gate_b_id string, created_at string")
    assert logs.append_log(row, root, "gate_b_log", "run1") and not logs.append_log(row, root, "gate_b_log", "run1")
    assert logs.append_log(row, root, "gate_b_log", "run2") and logs.read_log(spark, root, "gate_b_log").count() == 2
    logs.write_json({"a": [1]}, f"{root}/deep/x.json", spark)
    logs.write_json({"a": [2]}, f"{root}/deep/x.json", spark)
    assert logs.read_json(f"{root}/deep/x.json", spark=spark) == {"a": [2]} and logs.read_json(f"{root}/no.json", True, spark) == {}
