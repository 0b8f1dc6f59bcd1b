"""Tick lanes over the test tables, in the layout of the tick tables.

Lane E binds ``events``: an event is a trade tick; those that are no errors are order ticks too; ``customer`` is the universe.
Lane L binds ``lineitem`` and ``orders``: a month is a date, a supplier an instrument; ``supplier`` is the universe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import instrument_key, seconds_of_day

#: Ticks that a task aggregates before they are exchanged: its memory follows neither the input nor how the input's files are cut.
TICKS_A_TASK = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The same rows, dealt by a row's own key to as many tasks as their number asks for; few rows stay as they were read.

    A Parquet file is read by one task a row group at most, so a large file of one group would be parsed and aggregated by a single task. Rows are dealt
    one by one, not by instrument: a hot instrument's ticks lie in all tasks. They are counted from the files' footers.
    """
    tasks = -(-rows.count() // TICKS_A_TASK)
    return rows.repartition(tasks, key) if tasks > 1 else rows


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ticks of lane E with both tables' columns; ``is_order`` marks order ticks."""
    events = dealt(table(spark, sf_dir, "events"), "event_id")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    file = F.concat(F.lit("trade/"), F.lpad(F.col("user_id").cast("string"), 5, "0"), F.lit(".csv"))
    return events.select(
        F.to_date("ts").alias("date"), instrument_key(file).alias("instrument_key"), "ts", seconds_of_day(F.col("ts")).alias("Time"), F.col("event_id").alias("row_num_in_file"),
        F.col("value").alias("Price"), k.alias("Volume"), F.when(kind == "purchase", 1).when(kind == "signup", 2).otherwise(0).alias("TradeDir"), (k % 10).alias("OrderId"), (kind != "error").alias("is_order"),
    )


def event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_ticks(spark, sf_dir).drop("OrderId", "is_order")


def event_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_ticks(spark, sf_dir).where("is_order").select("date", "instrument_key", "Time", "row_num_in_file", "OrderId", "Price", "Volume")


def event_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument_key, stock_research_candidate."""
    return table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("instrument_key"), (F.col("c_mktsegment") != "MACHINERY").alias("stock_research_candidate"))


def line_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lane L trades; the last columns order ticks within a month."""
    return table(spark, sf_dir, "lineitem").select(
        F.trunc("l_shipdate", "month").alias("date"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0").alias("instrument_key"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("Price"), F.col("l_quantity").alias("Volume"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("at"),
    )


def line_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.select(F.trunc("o_orderdate", "month").alias("date"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0").alias("instrument_key"), F.col("l_orderkey").alias("OrderId"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("Price"), F.col("l_quantity").alias("Volume"))


def line_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 5, "0").alias("instrument_key"), (F.col("s_acctbal") > 0).alias("stock_research_candidate"))
