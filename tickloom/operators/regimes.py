"""Market regimes by date, and metrics by regime slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import frequency_bin, ratio, year_grade
from tickloom.operators.dates import previous_requested
from tickloom.operators.information import turnover_entropy

#: Slice columns and the quantiles' names by number of bins.
SLICES = ("year_grade", "market_turnover_regime", "market_volatility_regime", "entropy_quantile")
QUANTILES = 3
QUANTILE_NAMES = {1: ("q1_all_entropy",), 2: ("q1_low_entropy", "q2_high_entropy"), 3: ("q1_low_entropy", "q2_mid_entropy", "q3_high_entropy")}


def market_stats(daily: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """By date: total turnover, mean absolute close return since the previous *requested* date, and turnover entropy."""
    days = daily.select("date").distinct() if days is None else days
    steps = F.broadcast(previous_requested(days))
    here = daily.join(steps, "date")
    before = daily.select(F.col("date").alias("previous_date"), "instrument_key", F.col("close_like_price").alias("before")).where(F.col("before") > 0)
    move = F.abs(ratio(F.col("close_like_price"), F.col("before")) - 1)
    returns = here.join(before, ["previous_date", "instrument_key"]).groupBy("date").agg(F.avg(move).alias("market_abs_close_return"))
    turnover = here.groupBy("date").agg(F.sum("turnover").alias("market_total_turnover"))
    entropy = turnover_entropy(here.select("date", "turnover"))
    out = days.join(turnover, "date", "left").join(returns, "date", "left").join(entropy, "date", "left")
    return out.select("date", "market_total_turnover", "market_abs_close_return", "market_turnover_entropy")


def _half(value: str, median: Column, high: str, low: str) -> Column:
    return F.when(F.col(value).isNull(), "insufficient_history").when(F.col(value) >= median, high).otherwise(low)


def regime_labels(stats: DataFrame) -> DataFrame:
    """Adds year_grade, turnover and volatility regimes (at least the median is high) and the entropy quantile to one row a date."""
    every = Window.partitionBy(F.lit(0))  # as many rows as there are dates
    out = stats.withColumns({"__t": F.median("market_total_turnover").over(every), "__v": F.median("market_abs_close_return").over(every)})
    known = F.col("market_turnover_entropy").isNotNull()
    n = F.count("market_turnover_entropy").over(every)
    bins = F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(2), F.least(F.lit(QUANTILES), n))).cast("long")
    place = F.row_number().over(every.orderBy(F.col("market_turnover_entropy").asc_nulls_last(), "date")) - 1
    out = out.withColumns({"__n": n, "__bins": bins, "__place": place})
    name = F.lit(None).cast("string")
    for count, names in QUANTILE_NAMES.items():
        at = frequency_bin(F.col("__place"), F.col("__bins"), F.col("__n")) + 1
        name = F.when(F.col("__bins") == count, F.try_element_at(F.array(*map(F.lit, names)), at.cast("int"))).otherwise(name)
    return out.select(
        *stats.columns, year_grade(F.col("date")).alias("year_grade"),
        _half("market_total_turnover", F.col("__t"), "high_turnover", "low_turnover").alias("market_turnover_regime"),
        _half("market_abs_close_return", F.col("__v"), "high_vol", "low_vol").alias("market_volatility_regime"),
        F.when(known, name).otherwise("insufficient_entropy_history").alias("entropy_quantile"),
    )


def year_only(days: DataFrame) -> DataFrame:
    """The labels that need no market data: date and year_grade. Summaries by slice then have that slice alone."""
    return days.select("date", year_grade(F.col("date")).alias("year_grade"))


def slice_summary(dates: DataFrame, labels: DataFrame) -> DataFrame:
    """Means of per-date metrics by factor and regime slice: the four slice columns are unpivoted, then one aggregation."""
    have = [c for c in SLICES if c in labels.columns]
    joined = dates.join(F.broadcast(labels.select("date", *have)), "date", "left")
    pairs = F.array(*[F.struct(F.lit(c).alias("slice_name"), F.col(c).alias("slice_value")) for c in have])
    sliced = joined.select(*dates.columns, F.inline(pairs)).where(F.col("slice_value").isNotNull())
    means = {"mean_rank_ic": F.avg("rank_ic"), "mean_abs_rank_ic": F.avg(F.abs("rank_ic")), "mean_top_bottom_spread": F.avg("top_bottom_spread"), "mean_coverage_ratio": F.avg("coverage_ratio")}
    if "nmi" in dates.columns:
        means |= {"mean_nmi": F.avg("nmi"), "mean_nmi_ic_gap": F.avg(F.col("nmi") - F.abs("rank_ic"))}
    if "mi_p_value" in dates.columns:
        means |= {"mean_mi_p_value": F.avg("mi_p_value"), "mi_significant_date_ratio": F.avg(F.col("mi_significant").cast("double"))}
    return sliced.groupBy("factor", "slice_name", "slice_value").agg(F.count(F.lit(1)).alias("date_count"), F.sum("labeled_rows").alias("labeled_rows"), *[c.alias(n) for n, c in means.items()])


def entropy_digest(slices: DataFrame) -> DataFrame:
    """By factor, over the entropy slices: largest less smallest mean absolute rank IC, and the slices that have them (0 for a single slice)."""
    scored = slices.where((F.col("slice_name") == "entropy_quantile") & F.col("mean_abs_rank_ic").isNotNull())
    value = F.col("mean_abs_rank_ic")
    first = lambda sign: F.min_by("slice_value", F.struct((value * sign).alias("v"), F.col("slice_value").alias("s")))
    return scored.groupBy("factor").agg((F.max(value) - F.min(value)).alias("entropy_regime_dispersion"), first(-1).alias("strongest_slice"), first(1).alias("weakest_slice"))
