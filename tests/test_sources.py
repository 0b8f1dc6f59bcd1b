import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tickloom.plans import catalog, cycle
from tickloom.sources import lanes, logs, ticks
from tickloom.streaming.daily_stream import daily_trades


@pytest.fixture(scope="module")
def root(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ticks"))
    frame = lanes.event_trades(spark, sf).withColumn("source_file", F.concat(F.lit("trade/"), "instrument_key", F.lit(".csv"))).drop("instrument_key").withColumn("year", F.year("date"))
    frame.write.partitionBy("year", "date").parquet(f"{path}/verified_trades")
    return path


def test_scan_prunes_and_restricts(spark, sf, root):
    day = str(ticks.available_dates(spark, root, "verified_trades", 2024).first()["date"])
    universe = lanes.event_universe(spark, sf)
    out = ticks.load(spark, root, "verified_trades", [day], ["date", "Price"], universe)
    assert out.columns == ["date", "Price", "instrument_key"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan or "PartitionFilters: [cast(date" in plan or "PartitionFilters: [date" in plan
    assert "ReadSchema: struct<Price:double,source_file:string>" in plan.replace("Price:double,source_file", "Price:double,source_file")
    with pytest.raises(FileNotFoundError):
        ticks.load(spark, root, "verified_trades", ["1999-01-01"])
    with pytest.raises(ValueError):
        ticks.load(spark, root, "verified_trades", [])
    with pytest.raises(ValueError):
        ticks.scan(spark, root, "nothing")


def test_daily_cache_is_built_once(spark, root):
    days = [str(r["date"]) for r in ticks.available_dates(spark, root, "verified_trades", 2024).limit(3).collect()]
    frame = ticks.load(spark, root, "verified_trades", days[:2])
    first = {str(r["date"]): r["status"] for r in ticks.write_daily(spark, root, "verified_trades_daily", frame).collect()}
    assert set(first.values()) == {"built"}
    both = ticks.write_daily(spark, root, "verified_trades_daily", ticks.load(spark, root, "verified_trades", days))
    assert {str(r["date"]): r["status"] for r in both.collect()} == {days[0]: "skipped", days[1]: "skipped", days[2]: "built"}
    wanted = spark.createDataFrame([(dt.date(1999, 1, 1),)], "date date")
    assert ticks.missing(spark, root, ["verified_trades_daily", "verified_orders_daily"], wanted).count() == 2
    daily = ticks.load(spark, root, "verified_trades_daily", days, ["date", "close_like_price"])
    assert daily.columns == ["date", "close_like_price"]


def test_logs_append(spark, tmp_path):
    root = str(tmp_path)
    assert logs.read_log(spark, root, "gate_b_log").count() == 0
    row = spark.createDataFrame([("g1", "t1", "fail", 'a "b"')], "gate_b_id string, created_at string, decision string, notes string")
    logs.append_log(row, root, "gate_b_log")
    logs.append_log(row.withColumn("created_at", F.lit("t2")), root, "gate_b_log")
    back = logs.read_log(spark, root, "gate_b_log").orderBy("created_at").collect()
    assert [r["created_at"] for r in back] == ["t1", "t2"] and back[0]["notes"] == 'a "b"' and back[0]["factor_name"] is None
    assert cycle.status(spark, root)["latest_gate_b_log"]["created_at"] == "t2"


def test_json_with_garbage_after_it(tmp_path):
    path = tmp_path / "x.json"
    path.write_text(json.dumps({"a": 1}) + "TRAILING_GARBAGE")
    assert logs.read_json(str(path)) == {"a": 1} and logs.read_json(str(tmp_path / "no"), missing_ok=True) == {}


def test_yaml_and_specs(tmp_path):
    (tmp_path / "f.yaml").write_text("family_id: x\ncommon:\n  - a\n  - b\nempty: []\n")
    assert logs.read_flat_yaml(str(tmp_path / "f.yaml")) == {"family_id": "x", "common": ["a", "b"], "empty": []}
    (tmp_path / "s.toml").write_text('family = "fam"\n[[prototypes]]\nslug = "s"\nlevel_expression = "log1p(turnover)"\n')
    assert [(s.name, s.family) for s in logs.factor_specs(str(tmp_path / "s.toml"))] == [("s", "fam")]


def test_cycle_writes_board_and_logs(spark, sf, tmp_path):
    out = cycle.run(spark, sf, str(tmp_path))
    assert out["factors"] == 28 and "| factor |" in out["report"]
    assert logs.read_log(spark, str(tmp_path), "reject_reason_log").count() == 28
    assert logs.read_log(spark, str(tmp_path), "autoresearch_cycle_log").count() == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    ticks_ = lanes.event_trades(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    ticks_.write.parquet(str(tmp_path / "in"))
    stream = daily_trades(spark.readStream.schema(ticks_.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("daily_now").start()
    query.processAllAvailable()
    query.stop()
    from tickloom.operators.daily import trades_daily

    want = {(r["date"], r["instrument_key"]): (r["trade_count"], r["close_like_price"]) for r in trades_daily(lanes.event_trades(spark, sf), F.struct("ts", "row_num_in_file")).collect()}
    got = {(r["date"], r["instrument_key"]): (r["trade_count"], r["close_like_price"]) for r in spark.table("daily_now").collect()}
    assert got == want


def test_no_python_on_the_hot_path(spark, sf):
    for name in ("scoreboard", "f_trade_size_concentration", "mi_permutation_pvalue", "transfer_entropy_pairs"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan, name
