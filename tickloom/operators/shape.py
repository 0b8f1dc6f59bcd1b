"""Statistics of a day's ticks that are no plain aggregates: concentration of sizes, burstiness of arrivals.

Ticks are counted by value before anything is ordered, so what is ordered is the distinct values of a day and instrument: at most 86,400
seconds, and the distinct notionals. Those are ordered by ranges, since an instrument may have very many: a place is the place in its range plus
the number of ticks in lower ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.daily import KEY, raw_daily

#: Ranges of values: so many for each doubling.
RANGES = 8


def value_range(value: Column) -> Column:
    """A number that never falls where the value rises: the sign, and within it the logarithm's part."""
    part = F.floor(F.log2(F.abs(value)) * RANGES) + 1_100 * RANGES
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * part).cast("long")


def gini(trades: DataFrame, value: str = "notional") -> DataFrame:
    """Gini coefficient of trade notionals by date and instrument; 0 for a single trade or a sum that is not positive.

    Equal values are counted first. Of a value's c ticks, after b ticks of smaller ones, the places add up to c * b + c * (c + 1) / 2.
    """
    v = F.col("Price") * F.col("Volume") if value == "notional" else F.col(value)
    counted = trades.select(*KEY, v.alias("__v")).where(F.col("__v").isNotNull()).groupBy(*KEY, "__v").agg(F.count(F.lit(1)).alias("__c")).withColumn("__r", value_range(F.col("__v")))
    lower = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    c = F.col("__c")
    placed = counted.withColumn("__b", F.coalesce(F.sum("__c").over(lower([*KEY, "__r"], "__v")), F.lit(0)))
    ranges = placed.groupBy(*KEY, "__r").agg(F.sum("__c").alias("n"), F.sum(c * F.col("__v")).alias("total"), F.sum(F.col("__v") * (c * F.col("__b") + c * (c + 1) / 2)).alias("placed"))
    ranges = ranges.withColumn("below", F.coalesce(F.sum("n").over(lower(KEY, "__r")), F.lit(0)))
    sums = ranges.groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.col("placed") + F.col("below") * F.col("total")).alias("placed"))
    value_ = (2 * F.col("placed") - (F.col("n") + 1) * F.col("total")) / (F.col("n") * F.col("total"))
    return sums.select(*KEY, F.when((F.col("n") <= 1) | (F.col("total") <= 0), F.lit(0.0)).otherwise(value_).alias("trade_size_gini"))


def burstiness(trades: DataFrame) -> DataFrame:
    """Sample deviation over mean of the positive gaps between ticks, in seconds; 0 with fewer than three ticks or two such gaps.

    The positive gaps are those between distinct seconds.
    """
    seconds = trades.select(*KEY, "Time").where(F.col("Time").isNotNull()).groupBy(*KEY, "Time").agg(F.count(F.lit(1)).alias("__c"))
    gaps = seconds.withColumn("__gap", (F.col("Time") - F.lag("Time").over(Window.partitionBy(*KEY).orderBy("Time"))).cast("double"))
    sums = gaps.groupBy(*KEY).agg(F.sum("__c").alias("n"), F.count("__gap").alias("positive"), F.stddev_samp("__gap").alias("sd"), F.avg("__gap").alias("mean"))
    return sums.select(*KEY, F.when((F.col("n") < 3) | (F.col("positive") < 2), F.lit(0.0)).otherwise(F.try_divide("sd", "mean")).alias("interval_cv"))


def shaped(raw: DataFrame, trades: DataFrame) -> DataFrame:
    """The columns of daily.raw_daily with both statistics of the same ticks; 0 where all of a day's sizes or times are null."""
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return raw.join(gini(trades), KEY, "left").join(burstiness(trades), KEY, "left").select(*raw.columns, zero("trade_size_gini"), zero("interval_cv"))


def raw_statistics(trades: DataFrame) -> DataFrame:
    """``shaped`` from ticks alone."""
    return shaped(raw_daily(trades), trades)
