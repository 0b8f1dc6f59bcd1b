"""Factors held against each other: correlation, overlap of their tops, redundancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import pearson

PAIR = ["left_factor", "right_factor"]


def correlation_of_columns(wide: DataFrame, names: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """By pair and date: common rows and Pearson correlation (null where undefined), over rows of date and instrument with a column a factor.

    Pairs are formed inside the row, not by a join of scores, and are numbers until they are counted: 378 a row for 28 factors.
    """
    names = sorted(names)
    asked = None if pairs is None else {(r["left_factor"], r["right_factor"]) for r in pairs.select(*PAIR).distinct().collect()}  # pairs of a catalogue
    places = [(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and (asked is None or (a, b) in asked)]
    one = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in places]).cast("array<struct<i:int,j:int>>")
    rows = wide.select("date", F.array(*[F.col(n).cast("double") for n in names]).cast("array<double>").alias("s"))
    both = rows.select("date", "s", F.explode(one).alias("p")).select("date", "p.i", "p.j", F.get("s", F.col("p.i")).alias("x"), F.get("s", F.col("p.j")).alias("y"))
    both = both.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    found = both.groupBy("date", "i", "j").agg(F.count(F.lit(1)).alias("common_rows"), pearson("x", "y").alias("pearson_corr"))
    name = lambda c: F.get(F.array(*[F.lit(n) for n in names]), F.col(c))
    return found.select(name("i").alias("left_factor"), name("j").alias("right_factor"), "date", "common_rows", "pearson_corr")


def correlation_by_date(scores: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The same from long scores, which are put side by side first; the factors' names are read by the driver."""
    names = [r["factor"] for r in scores.select("factor").distinct().collect()]
    if not names:
        return scores.limit(0).select(F.col("factor").alias("left_factor"), F.col("factor").alias("right_factor"), "date", F.lit(0).cast("long").alias("common_rows"), F.col("score").alias("pearson_corr"))
    wide = scores.groupBy("date", "instrument_key").agg(*[F.max(F.when(F.col("factor") == n, F.col("score"))).alias(n) for n in names])
    return correlation_of_columns(wide, names, pairs)


def top_rows(scores: DataFrame, n: int, bottom: bool = False) -> DataFrame:
    """The n highest (or lowest) scores by factor and date, ties by instrument, with their place."""
    order = ["score", "instrument_key"] if bottom else [F.desc("score"), "instrument_key"]
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("factor", "date").orderBy(*order))).where(F.col("place") <= n)


def top_overlap_by_date(scores: DataFrame, n: int = 20) -> DataFrame:
    """By pair and date: how many instruments both tops hold; dates without any are absent."""
    top = top_rows(scores, n)
    a = top.select(F.col("factor").alias("left_factor"), "date", "instrument_key")
    b = top.select(F.col("factor").alias("right_factor"), "date", "instrument_key")
    return a.join(b, ["date", "instrument_key"]).where(F.col("left_factor") < F.col("right_factor")).groupBy(*PAIR, "date").agg(F.count(F.lit(1)).alias("top_overlap_count"))


def both_ways(rows: DataFrame) -> DataFrame:
    """Pair rows from each factor's side: factor, peer, and the rest."""
    rest = [c for c in rows.columns if c not in PAIR]
    one = lambda a, b: rows.select(F.col(a).alias("factor"), F.col(b).alias("peer"), *rest)
    return one(*PAIR).unionByName(one(*reversed(PAIR)))


def baseline_redundancy(correlations: DataFrame, overlaps: DataFrame, baselines: tuple[str, ...]) -> DataFrame:
    """By factor: role, number of baselines compared, and the pooled mean of |correlation| and of overlap with them (null for baselines themselves)."""
    is_base = lambda c: F.col(c).isin(*baselines)
    corr = both_ways(correlations).where(is_base("peer") & ~is_base("factor")).groupBy("factor").agg(F.count_distinct("peer").alias("baseline_peer_count"), F.avg(F.abs("pearson_corr")).alias("mean_abs_baseline_corr"))
    over = both_ways(overlaps).where(is_base("peer") & ~is_base("factor")).groupBy("factor").agg(F.avg("top_overlap_count").alias("mean_baseline_top_overlap"))
    names = both_ways(correlations).select("factor").distinct()
    out = names.join(corr, "factor", "left").join(over, "factor", "left")
    return out.select(
        "factor", F.when(is_base("factor"), "baseline_anchor").otherwise("challenger").alias("baseline_role"),
        F.when(is_base("factor"), F.lit(max(0, len(baselines) - 1))).otherwise(F.coalesce("baseline_peer_count", F.lit(0))).cast("long").alias("baseline_peer_count"),
        "mean_abs_baseline_corr", "mean_baseline_top_overlap",
    )


def peer_redundancy(correlations: DataFrame, overlaps: DataFrame) -> DataFrame:
    """By factor: mean over peers of each peer's mean |correlation| and mean overlap; 0 without any."""
    corr = both_ways(correlations).groupBy("factor", "peer").agg(F.avg(F.abs("pearson_corr")).alias("c")).groupBy("factor").agg(F.avg("c").alias("c"))
    over = both_ways(overlaps).groupBy("factor", "peer").agg(F.avg("top_overlap_count").alias("o")).groupBy("factor").agg(F.avg("o").alias("o"))
    names = both_ways(correlations).select("factor").distinct()
    return names.join(corr, "factor", "left").join(over, "factor", "left").select("factor", F.coalesce("c", F.lit(0.0)).alias("mean_abs_peer_corr"), F.coalesce("o", F.lit(0.0)).alias("mean_top_overlap_count"))


def merged_by_date(correlations: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Full outer merge of both by pair and date."""
    return correlations.join(overlaps, [*PAIR, "date"], "full_outer")


def latest(rows: DataFrame, keys: list[str], at: str, tie: str | None = None) -> DataFrame:
    """The last written row of each key."""
    order = [F.desc(at), *([F.desc(tie)] if tie else [])]
    return rows.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__row") == 1).drop("__row")


def latest_pairs(rows: DataFrame, at: str, tie: str | None = None, pair: tuple[str, str] = ("left_factor", "right_factor")) -> DataFrame:
    """The last written row of each pair, whichever of the two stands first."""
    keyed = rows.withColumns({"__a": F.least(*pair), "__b": F.greatest(*pair)})
    return latest(keyed, ["__a", "__b"], at, tie).drop("__a", "__b")
