"""The trading calendar: steps between available dates, never across a year's end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(*frames: DataFrame) -> DataFrame:
    """The distinct dates of the frames; its size is the number of days, whatever the number of ticks."""
    out = frames[0].select("date")
    for frame in frames[1:]:
        out = out.unionByName(frame.select("date"))
    return out.where(F.col("date").isNotNull()).distinct()


def stepped(days: DataFrame, steps: int = 1) -> DataFrame:
    """date, previous_date, next_date: so many available dates back and ahead within the year."""
    if steps < 1:
        raise ValueError("steps must be at least 1")
    by_year = Window.partitionBy(F.year("date")).orderBy("date")
    return days.select("date", F.lag("date", steps).over(by_year).alias("previous_date"), F.lead("date", steps).over(by_year).alias("next_date"))


def previous_requested(days: DataFrame) -> DataFrame:
    """date, previous_date: the date before it among the requested ones, however far back, across years too."""
    return days.select("date", F.lag("date").over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("previous_date"))


def between(frame: DataFrame, begin: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a date range, both ends included; partition pruning applies where the table is partitioned by date."""
    if begin:
        frame = frame.where(F.col("date") >= F.lit(begin).cast("date"))
    return frame.where(F.col("date") <= F.lit(end).cast("date")) if end else frame
