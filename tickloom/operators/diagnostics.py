"""Plain summaries of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """Rows, instruments, mean, least and largest score by ``by``; over everything (an empty list) an empty frame gives zeros."""
    zero = (lambda c: F.coalesce(c, F.lit(0.0))) if not by else (lambda c: c)
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("instrument_key").alias("distinct_instruments"),
        zero(F.avg("score")).alias("score_mean"), zero(F.min("score")).alias("score_min"), zero(F.max("score")).alias("score_max"),
    )


def search(board: DataFrame, text: str | None = None, families: list[str] | None = None, columns: tuple[str, ...] = ("factor", "family", "incremental_hint")) -> DataFrame:
    """Rows in one of the families, holding the text in one of the columns; letter case is ignored and the text is literal."""
    if families:
        board = board.where(F.col("family").isin(families))
    if text:
        found = F.lit(False)
        for column in columns:
            found = found | F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(text.lower()))
        board = board.where(found)
    return board
