"""Ticks to one row per date and instrument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio, session

KEY = ["date", "instrument_key"]


def trades_daily(trades: DataFrame, order_by: Column | None = None, positive_volume: bool = True) -> DataFrame:
    """trade_count, turnover, share_volume, avg_trade_size, close_like_price, vwap, instrument_key_source by date and instrument.

    The close-like price is the price of the last tick by ``order_by`` (time, then row). Instruments without volume on a date are
    dropped unless ``positive_volume`` is off, as the raw lanes want it. One aggregation, no sort.
    """
    at = F.struct("Time", "row_num_in_file") if order_by is None else order_by
    out = trades.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.coalesce(F.sum(F.col("Price") * F.col("Volume")), F.lit(0.0)).alias("turnover"),
        F.coalesce(F.sum("Volume"), F.lit(0)).alias("share_volume"),
        F.avg("Volume").alias("avg_trade_size"),
        F.max_by("Price", at).alias("close_like_price"),
    )
    if positive_volume:
        out = out.where(F.col("share_volume") > 0)
    return out.withColumn("vwap", ratio(F.col("turnover"), F.col("share_volume"))).withColumn("instrument_key_source", F.lit("source_file_stem"))


def orders_daily(orders: DataFrame) -> DataFrame:
    """order_event_count, unique_order_ids, total_order_notional, churn_ratio, instrument_key_source by date and instrument."""
    out = orders.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("order_event_count"),
        F.count_distinct("OrderId").alias("unique_order_ids"),
        F.coalesce(F.sum(F.col("Price") * F.col("Volume")), F.lit(0.0)).alias("total_order_notional"),
    )
    return out.withColumn("churn_ratio", ratio(F.col("order_event_count"), F.col("unique_order_ids"))).withColumn("instrument_key_source", F.lit("source_file_stem"))


def close_like(trades: DataFrame, order_by: Column | None = None) -> DataFrame:
    """The last price by date and instrument."""
    return trades.groupBy(*KEY).agg(F.max_by("Price", F.struct("Time", "row_num_in_file") if order_by is None else order_by).alias("close_like_price"))


def joined_daily(trades: DataFrame, orders: DataFrame) -> DataFrame:
    """Inner join of both daily tables; the source column, which both have, is the first that is not null."""
    orders = orders.withColumnRenamed("instrument_key_source", "__source")
    out = trades.join(orders, KEY)
    return out.withColumn("instrument_key_source", F.coalesce("instrument_key_source", "__source")).drop("__source")


def raw_daily(trades: DataFrame) -> DataFrame:
    """What the raw-tick factors need, in one conditional aggregation: counts, notionals by session and by direction."""
    notional, second, side = F.col("Price") * F.col("Volume"), F.col("Time"), F.col("TradeDir")
    some = lambda test: F.coalesce(F.sum(F.when(test, notional)), F.lit(0.0))
    return trades.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("trade_count"), F.coalesce(F.sum(notional), F.lit(0.0)).alias("turnover"),
        some(session(second, "morning")).alias("morning_turnover"), some(session(second, "afternoon")).alias("afternoon_turnover"),
        F.count_if(side == 1).alias("buy_count"), some(side == 1).alias("buy_notional"), some(side == 2).alias("sell_notional"),
    )


def tagged_daily(ticks: DataFrame, order_by: Column | None = None) -> DataFrame:
    """All three daily tables side by side, from one pass over ticks with ``is_order``: one aggregation, order ids counted in two steps.

    The columns of raw_daily, and those of trades_daily and orders_daily that it lacks. ``trades_of``, ``orders_of`` and ``raw_of`` take them apart.
    """
    at = F.struct("Time", "row_num_in_file") if order_by is None else order_by
    notional, second, side, order = F.col("Price") * F.col("Volume"), F.col("Time"), F.col("TradeDir"), F.col("is_order")
    some = lambda test: F.coalesce(F.sum(F.when(test, notional)), F.lit(0.0))
    return ticks.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("trade_count"), F.coalesce(F.sum(notional), F.lit(0.0)).alias("turnover"), F.coalesce(F.sum("Volume"), F.lit(0)).alias("share_volume"),
        F.avg("Volume").alias("avg_trade_size"), F.max_by("Price", at).alias("close_like_price"),
        some(session(second, "morning")).alias("morning_turnover"), some(session(second, "afternoon")).alias("afternoon_turnover"),
        F.count_if(side == 1).alias("buy_count"), some(side == 1).alias("buy_notional"), some(side == 2).alias("sell_notional"),
        F.count_if(order).alias("order_event_count"), F.count_distinct(F.when(order, F.col("OrderId"))).alias("unique_order_ids"), some(order).alias("total_order_notional"),
    )


def trades_of(tagged: DataFrame, positive_volume: bool = True) -> DataFrame:
    """trades_daily's rows of ``tagged_daily``."""
    out = tagged.select(*KEY, "trade_count", "turnover", "share_volume", "avg_trade_size", "close_like_price")
    out = out.where(F.col("share_volume") > 0) if positive_volume else out
    return out.withColumn("vwap", ratio(F.col("turnover"), F.col("share_volume"))).withColumn("instrument_key_source", F.lit("source_file_stem"))


def orders_of(tagged: DataFrame) -> DataFrame:
    """orders_daily's rows of ``tagged_daily``: where there is an order."""
    out = tagged.where(F.col("order_event_count") > 0).select(*KEY, "order_event_count", "unique_order_ids", "total_order_notional")
    return out.withColumn("churn_ratio", ratio(F.col("order_event_count"), F.col("unique_order_ids"))).withColumn("instrument_key_source", F.lit("source_file_stem"))


def raw_of(tagged: DataFrame) -> DataFrame:
    """raw_daily's rows of ``tagged_daily``."""
    return tagged.select(*KEY, "trade_count", "turnover", "morning_turnover", "afternoon_turnover", "buy_count", "buy_notional", "sell_notional")


def missing_dates(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Dates of the first that the second has no row of."""
    return wanted.select("date").distinct().join(held.select("date").distinct(), "date", "left_anti")
