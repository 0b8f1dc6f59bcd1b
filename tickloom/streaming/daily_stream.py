"""Daily trade aggregates kept current from a stream of ticks (an addition: the batch catalogue does not need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio


def daily_trades(ticks: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The columns of operators.daily.trades_daily from a streaming frame with ``ts``; a day closes once the watermark passes its end.

    State is one row an open day and instrument.
    """
    out = (
        ticks.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"), "instrument_key")
        .agg(
            F.count(F.lit(1)).alias("trade_count"), F.sum(F.col("Price") * F.col("Volume")).alias("turnover"), F.sum("Volume").alias("share_volume"),
            F.avg("Volume").alias("avg_trade_size"), F.max_by("Price", F.struct("ts", "row_num_in_file")).alias("close_like_price"),
        )
        .where(F.col("share_volume") > 0)
    )
    return out.select(F.to_date("window.start").alias("date"), "instrument_key", "trade_count", "turnover", "share_volume", "avg_trade_size", "close_like_price", ratio(F.col("turnover"), F.col("share_volume")).alias("vwap"))
