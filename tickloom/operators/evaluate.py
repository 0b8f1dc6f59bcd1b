"""Forward-return labels and the evaluation of factors against them, over all factors at once.

Frames: ``scores`` (factor, date, instrument_key, score); ``labels`` (date, next_date, instrument_key, ..., the return).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import pearson, ratio

LABEL = "forward_return_1d_close_like"
#: Values whose sign is counted keep so many places: what is zero but for the order of a sum is zero.
SIGN_PLACES = 12
BY_DATE = ["factor", "date"]
GROUP = "__group"
#: So many rows a task are ordered at most, but for a factor's single date, so that a task's memory does not follow the input.
ROWS_A_TASK = 250_000


def forward_labels(prices: DataFrame, steps: DataFrame, source: str = "close_like_price") -> DataFrame:
    """Return from a date's close-like price to the next available date's; rows without a positive price on both are dropped."""
    priced = prices.where(F.col("close_like_price") > 0).select("date", "instrument_key", "close_like_price")
    days = steps.where(F.col("next_date").isNotNull()).select("date", "next_date")
    ahead = priced.select(F.col("date").alias("next_date"), "instrument_key", F.col("close_like_price").alias("next_close_like_price"))
    joined = priced.join(F.broadcast(days), "date").join(ahead, ["next_date", "instrument_key"])
    value = ratio(F.col("next_close_like_price"), F.col("close_like_price")) - 1
    return joined.select("date", "next_date", "instrument_key", "close_like_price", "next_close_like_price", value.alias(LABEL), F.lit(source).alias("label_source"))


def labelled(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores that have a label: factor, date, instrument_key, score, label."""
    return scores.join(labels.select("date", "instrument_key", F.col(LABEL).alias("label")), ["date", "instrument_key"]).where(F.col("label").isNotNull()).select(*BY_DATE, "instrument_key", "score", "label")


def with_labels(wide: DataFrame, labels: DataFrame) -> DataFrame:
    """Wide factors with each row's label, null where there is none: joined once, before factors become rows."""
    return wide.join(labels.select("date", "instrument_key", F.col(LABEL).alias("label")), ["date", "instrument_key"], "left")


def group_number() -> Column:
    """A number for factor and date: what rows are dealt and ordered by, since names are long to compare."""
    return F.xxhash64(*BY_DATE)


def tasks_for(frame: DataFrame, rows: int) -> int:
    """As many tasks as so many rows ask for, and as the session shuffles into at least."""
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def dealt(joined: DataFrame, rows: int) -> DataFrame:
    """The same rows, with their group's number, dealt by it to as many tasks as their number asks for."""
    return joined.withColumn(GROUP, group_number()).repartition(tasks_for(joined, rows), GROUP)


def ranked(joined: DataFrame) -> DataFrame:
    """Adds, within factor and date: n, average ranks of score and label, and places by score both ways and by label (ties by instrument).

    Rows are ordered once by score and once by label: ties and ranks read the same order, and places from the top follow from those from the bottom
    (the instruments of a tie keep their order). ``from_end`` is the place from the bottom with ties in descending order.
    """
    out = joined if GROUP in joined.columns else joined.withColumn(GROUP, group_number())
    within = Window.partitionBy(GROUP)
    for value, place in (("score", "from_bottom"), ("label", "by_label")):
        out = out.withColumn(place, F.row_number().over(within.orderBy(value, "instrument_key")))
        by = within.orderBy(value)
        out = out.withColumns({
            f"__{value}": F.rank().over(by), f"__{value}_upto": F.count(F.lit(1)).over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
            "n": F.count(F.lit(1)).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        })
    # Above a tie are n - upto rows; within it the first instrument comes first.
    from_top = F.col("n") - F.col("__score_upto") + F.col("from_bottom") - F.col("__score") + 1
    rank = lambda value: (F.col(f"__{value}") + F.col(f"__{value}_upto")) / F.lit(2.0)
    out = out.withColumns({"from_top": from_top.cast("int"), "score_rank": rank("score"), "label_rank": rank("label")})
    return out.withColumn("from_end", (F.col("n") + 1 - F.col("from_top")).cast("int")).drop(GROUP, "__score", "__score_upto", "__label", "__label_upto")


def per_date(scores: DataFrame, labels: DataFrame, top_fraction: float = 0.2, placed: DataFrame | None = None) -> DataFrame:
    """By factor and date: factor_rows, labeled_rows, coverage_ratio, rank_ic, pearson_corr, mean_label, bucket_size, top and bottom mean, spread.

    A bucket is the ceiling of the fraction, one row at least. Dates without labels have no row. placed: the ranked rows, where they are held.
    """
    if not 0 < top_fraction <= 0.5:
        raise ValueError("top_fraction must be in (0, 0.5]")
    bucket = F.greatest(F.ceil(F.col("n") * F.lit(top_fraction)), F.lit(1))
    placed = (ranked(labelled(scores, labels)) if placed is None else placed).withColumn("bucket_size", bucket)
    stats = placed.groupBy(*BY_DATE).agg(
        F.count(F.lit(1)).alias("labeled_rows"),
        F.round(pearson("score_rank", "label_rank"), SIGN_PLACES).alias("rank_ic"),
        F.round(pearson("score", "label"), SIGN_PLACES).alias("pearson_corr"),
        F.avg("label").alias("mean_label"),
        F.first("bucket_size").alias("bucket_size"),
        F.avg(F.when(F.col("from_top") <= F.col("bucket_size"), F.col("label"))).alias("top_mean_return"),
        F.avg(F.when(F.col("from_bottom") <= F.col("bucket_size"), F.col("label"))).alias("bottom_mean_return"),
    )
    rows = scores.groupBy(*BY_DATE).agg(F.count(F.lit(1)).alias("factor_rows"))
    out = stats.join(rows, BY_DATE)
    return out.withColumn("coverage_ratio", ratio(F.col("labeled_rows"), F.col("factor_rows"))).withColumn("top_bottom_spread", F.col("top_mean_return") - F.col("bottom_mean_return"))


def skipped_dates(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Dates with scores but without any label."""
    return scores.select("date").distinct().join(labels.select("date").distinct(), "date", "left_anti")


def summary(dates: DataFrame) -> DataFrame:
    """By factor, means over its dates of what ``per_date`` and the information measures give (nulls left out)."""
    have = set(dates.columns)
    means = {"mean_rank_ic": F.avg("rank_ic"), "mean_abs_rank_ic": F.avg(F.abs("rank_ic")), "mean_pearson": F.avg("pearson_corr"), "mean_top_bottom_spread": F.avg("top_bottom_spread"), "mean_coverage_ratio": F.avg("coverage_ratio")}
    if "nmi" in have:
        means |= {"mean_mutual_info": F.avg("mi"), "mean_nmi": F.avg("nmi"), "mean_nmi_ic_gap": F.avg(F.col("nmi") - F.abs("rank_ic"))}
    if "mi_p_value" in have:
        means |= {"mean_mi_p_value": F.avg("mi_p_value"), "mean_mi_excess_over_null": F.avg("mi_excess_over_null"), "mi_significant_date_ratio": F.avg(F.col("mi_significant").cast("double"))}
    return dates.groupBy("factor").agg(F.count(F.lit(1)).alias("evaluated_dates"), F.sum("labeled_rows").alias("joined_rows"), *[c.alias(n) for n, c in means.items()])


def sign_summary(dates: DataFrame, value: str = "rank_ic", by: str = "factor") -> DataFrame:
    """By factor: counts by sign, the dominant sign (ties: positive), its share among signed dates, and how often the sign switches.

    Zeros are counted, but switches are looked for between signed dates only.
    """
    valid = dates.where(F.col(value).isNotNull()).select(by, "date", F.signum(value).alias("sign"))
    signed = valid.where(F.col("sign") != 0).withColumn("before", F.lag("sign").over(Window.partitionBy(by).orderBy("date")))
    switches = signed.groupBy(by).agg(F.count_if(F.col("sign") != F.col("before")).alias("sign_switch_count"))
    counts = valid.groupBy(by).agg(F.count(F.lit(1)).alias("evaluated_count"), F.count_if(F.col("sign") > 0).alias("positive_count"), F.count_if(F.col("sign") < 0).alias("negative_count"), F.count_if(F.col("sign") == 0).alias("zero_count"))
    p, n = F.col("positive_count"), F.col("negative_count")
    return counts.join(switches, by, "left").select(
        by, "evaluated_count", (p + n).alias("signed_count"), "positive_count", "negative_count", "zero_count",
        F.when(p + n == 0, "none").when(p >= n, "positive").otherwise("negative").alias("dominant_sign"),
        ratio(F.greatest(p, n), p + n).alias("sign_consistency"), F.coalesce("sign_switch_count", F.lit(0)).cast("long").alias("sign_switch_count"),
    )


def series_summary(dates: DataFrame, value: str = "rank_ic", by: str = "factor", threshold: float = 2.0) -> DataFrame:
    """Count, mean, population deviation, and the t statistic on it (0 without variation; never passed below two values)."""
    out = dates.where(F.col(value).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    t = F.when((F.col("n") < 2) | (F.col("std") == 0), F.lit(0.0)).otherwise(F.try_divide("mean", F.col("std") / F.sqrt("n")))
    return out.withColumn("t_stat", t).withColumn("passed", (F.col("n") >= 2) & (F.abs("t_stat") >= threshold))


def bucket_means(frame: DataFrame, bucket: str, value: str) -> DataFrame:
    """Mean of the valid values by bucket; 0 for a bucket without any."""
    return frame.groupBy(bucket).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("bucket_mean"))


def bucket_spread(frame: DataFrame, bucket: str, value: str) -> DataFrame:
    """Largest less smallest bucket mean; 0 without buckets."""
    return bucket_means(frame, bucket, value).agg(F.coalesce(F.max("bucket_mean") - F.min("bucket_mean"), F.lit(0.0)).alias("bucket_spread"))
