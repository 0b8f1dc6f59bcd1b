"""A minimal long/short backtest over all factors at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio
from tickloom.operators.evaluate import SIGN_PLACES, labelled, ranked, sign_summary

BY_DATE = ["factor", "date"]


def by_date(scores: DataFrame, labels: DataFrame, top_fraction: float = 0.1, placed: DataFrame | None = None) -> DataFrame:
    """By factor and date: rows, bucket (the floor of the fraction, one at least), long and short mean return, spread, turnover.

    Long is the top bucket, short the bottom one. Turnover is the Jaccard distance of the selected instruments to those of the
    factor's previous date, 0 on its first. It is counted by joining the selected rows, without arrays. placed: the ranked rows, where they are held.
    """
    if not 0 < top_fraction <= 0.5:
        raise ValueError("top_fraction must be in (0, 0.5]")
    placed = ranked(labelled(scores, labels)) if placed is None else placed
    placed = placed.withColumn("bucket_size", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(top_fraction))))
    long_, short = F.col("from_top") <= F.col("bucket_size"), F.col("from_end") <= F.col("bucket_size")
    days = placed.groupBy(*BY_DATE).agg(
        F.count(F.lit(1)).alias("row_count"), F.first("bucket_size").alias("bucket_size"),
        F.avg(F.when(long_, F.col("label"))).alias("long_return"), F.avg(F.when(short, F.col("label"))).alias("short_return"),
        F.count_if(long_ | short).alias("selected_count"),
    )
    order = Window.partitionBy("factor").orderBy("date")
    days = days.withColumns({"previous": F.lag("date").over(order), "previous_count": F.lag("selected_count").over(order)})
    selected = placed.where(long_ | short).select(*BY_DATE, "instrument_key")
    before = selected.select("factor", F.col("date").alias("previous"), "instrument_key")
    kept = selected.join(days.select(*BY_DATE, "previous"), BY_DATE).join(before, ["factor", "previous", "instrument_key"], "left_semi").groupBy(*BY_DATE).agg(F.count(F.lit(1)).alias("kept"))
    out = days.join(kept, BY_DATE, "left")
    both = F.coalesce("kept", F.lit(0))
    turnover = F.when(F.col("previous").isNull(), F.lit(0.0)).otherwise(1 - ratio(both, F.col("selected_count") + F.col("previous_count") - both))
    return out.select(*BY_DATE, "row_count", "bucket_size", "long_return", "short_return", F.round(F.col("long_return") - F.col("short_return"), SIGN_PLACES).alias("spread_return"), turnover.alias("turnover_proxy"), "selected_count")


def summary(scores: DataFrame, days: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """By factor: mean returns and spread, hit rate, mean turnover (first date included), costs taken off, pooled coverage, sign stability."""
    if cost_bps < 0:
        raise ValueError("cost_bps must not be negative")
    totals = scores.groupBy("factor").agg(F.count(F.lit(1)).alias("factor_rows"))
    means = days.groupBy("factor").agg(
        F.sum("row_count").alias("joined_rows"), F.count(F.lit(1)).alias("evaluated_dates"), F.avg("long_return").alias("gross_long_return"), F.avg("short_return").alias("gross_short_return"),
        F.avg("spread_return").alias("spread_return"), F.avg("turnover_proxy").alias("turnover_proxy"), F.avg((F.col("spread_return") > 0).cast("double")).alias("hit_rate"),
    )
    signs = sign_summary(days, "spread_return").select("factor", F.col("sign_consistency").alias("stability_proxy"), "sign_switch_count")
    out = means.join(totals, "factor").join(signs, "factor", "left")
    return out.select(
        "factor", "joined_rows", "evaluated_dates", ratio(F.col("joined_rows"), F.col("factor_rows")).alias("coverage_ratio"), "gross_long_return", "gross_short_return", "spread_return",
        (F.col("spread_return") - F.lit(cost_bps / 10_000) * F.coalesce("turnover_proxy", F.lit(0.0))).alias("cost_adjusted_spread_return"), "turnover_proxy", "hit_rate", "stability_proxy", "sign_switch_count",
    )
