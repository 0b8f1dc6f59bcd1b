"""The factor catalogue as data, and all factors as columns of one wide daily frame.

A factor is a SQL expression over daily columns. All levels come from one frame (trades, orders and raw daily tables joined on date
and instrument), all changes from one self-join of it with the previous available date. ``long`` turns the columns into
(factor, date, instrument_key, score) rows, so evaluation runs once over all factors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio
from tickloom.operators.daily import KEY


@dataclass(frozen=True)
class FactorSpec:
    """One level factor: its expression, the daily tables it needs, its family, and whether it needs caveat fields."""

    name: str
    expression: str
    lanes: tuple[str, ...]
    family: str
    caveat: bool = False

    @property
    def change(self) -> str:
        return f"{self.name}_change"


#: Scores keep so many decimal places: scores that are equal but for the order of a sum then tie on every engine.
PLACES = 10

#: Names, formulas and families of the catalogue.
SPECS = (
    FactorSpec("structural_activity_proxy", "log1p(turnover) + 0.25D * log1p(trade_count)", ("trades",), "activity_pressure"),
    FactorSpec("avg_trade_notional_bias", "log1p(try_divide(turnover, trade_count))", ("trades",), "activity_pressure"),
    FactorSpec("order_lifecycle_churn", "log1p(churn_ratio) + 0.1D * log1p(total_order_notional)", ("orders",), "order_lifecycle_pressure"),
    FactorSpec("close_vwap_gap_intensity", "(try_divide(close_like_price, vwap) - 1D) * log1p(trade_count)", ("trades",), "close_vwap_pressure"),
    FactorSpec("order_trade_event_ratio", "log1p(order_event_count) - log1p(trade_count)", ("trades", "orders"), "order_trade_interaction_pressure"),
    FactorSpec("order_trade_notional_ratio", "log1p(total_order_notional) - log1p(turnover)", ("trades", "orders"), "order_trade_interaction_pressure"),
    FactorSpec("order_unique_trade_participation_gap", "log1p(unique_order_ids) - log1p(trade_count)", ("trades", "orders"), "order_trade_interaction_pressure"),
    FactorSpec("order_notional_vs_trade_notional_gap", "(log1p(total_order_notional) - log1p(unique_order_ids)) - (log1p(turnover) - log1p(trade_count))", ("trades", "orders"), "order_trade_interaction_pressure"),
    FactorSpec("close_vwap_churn_interaction", "(try_divide(close_like_price, vwap) - 1D) * log1p(churn_ratio)", ("trades", "orders"), "order_trade_interaction_pressure"),
    FactorSpec("session_activity_shift", "case when raw_turnover <= 0 then 0D else (afternoon_turnover - morning_turnover) / raw_turnover end", ("raw",), "intraday_distribution"),
    FactorSpec("trade_size_concentration", "trade_size_gini", ("raw",), "intraday_distribution"),
    FactorSpec("trade_arrival_burstiness", "interval_cv", ("raw",), "intraday_distribution"),
    FactorSpec("trade_dir_buy_ratio", "case when raw_count = 0 then 0.5D else buy_count / raw_count end", ("raw",), "directional_proxy", True),
    FactorSpec("trade_dir_imbalance_intensity", "case when raw_turnover <= 0 then 0D else abs(buy_notional - sell_notional) / raw_turnover end", ("raw",), "directional_proxy", True),
)
BY_NAME = {spec.name: spec for spec in SPECS}
#: The factors that others are held against.
BASELINES = ("structural_activity_proxy", "avg_trade_notional_bias", "order_lifecycle_churn", "close_vwap_gap_intensity")


#: The daily columns that a level expression may read, by the table that has them, as ``levels`` calls them.
LANE_COLUMNS = {
    "trades": "trade_count long, turnover double, share_volume long, avg_trade_size double, close_like_price double, vwap double",
    "orders": "order_event_count long, unique_order_ids long, total_order_notional double, churn_ratio double",
    "raw": "raw_count long, raw_turnover double, morning_turnover double, afternoon_turnover double, buy_count long, buy_notional double, sell_notional double, trade_size_gini double, interval_cv double",
}


def lanes_of(spark: SparkSession, expression: str) -> tuple[str, ...]:
    """The fewest daily tables whose columns an expression resolves against, by the analyser; a ValueError where none do."""
    problem = None
    for n in range(1, len(LANE_COLUMNS) + 1):
        for lanes in combinations(LANE_COLUMNS, n):
            try:
                kind = spark.createDataFrame([], ", ".join(LANE_COLUMNS[lane] for lane in lanes)).select(F.expr(expression).cast("double").alias("level"))
            except (AnalysisException, ParseException) as error:
                problem = error
                continue
            if kind.schema["level"].dataType.typeName() == "double":
                return lanes
    raise ValueError(f"{expression} does not resolve over the daily columns: {problem}")


def factor_names(specs: tuple[FactorSpec, ...] = SPECS) -> list[str]:
    return [name for spec in specs for name in (spec.name, spec.change)]


def levels(trades: DataFrame | None = None, orders: DataFrame | None = None, raw: DataFrame | None = None, specs: tuple[FactorSpec, ...] = SPECS) -> DataFrame:
    """date, instrument_key and one column a factor; null where one of its tables has no row."""
    parts = []
    if trades is not None:
        parts.append(trades.drop("instrument_key_source").withColumn("__trades", F.lit(True)))
    if orders is not None:
        parts.append(orders.drop("instrument_key_source").withColumn("__orders", F.lit(True)))
    if raw is not None:
        parts.append(raw.withColumnsRenamed({"turnover": "raw_turnover", "trade_count": "raw_count"}).withColumn("__raw", F.lit(True)))
    wide = parts[0]
    for part in parts[1:]:
        wide = wide.join(part, KEY, "full_outer")
    return wide.select(*KEY, *[F.when(F.expr(" and ".join(f"__{lane}" for lane in spec.lanes)), F.round(F.expr(spec.expression), PLACES)).alias(spec.name) for spec in specs])


def levels_of_tagged(tagged: DataFrame, specs: tuple[FactorSpec, ...] = SPECS) -> DataFrame:
    """The same from daily rows that have all tables side by side (daily.tagged_daily, with the raw statistics if a factor needs them).

    A row knows which of the tables it is in, so nothing is taken apart and joined again.
    """
    within = {"trades": F.col("share_volume") > 0, "orders": F.col("order_event_count") > 0, "raw": F.lit(True)}
    wanted = {lane for spec in specs for lane in spec.lanes}
    rows = tagged.withColumns({
        "vwap": ratio(F.col("turnover"), F.col("share_volume")), "churn_ratio": ratio(F.col("order_event_count"), F.col("unique_order_ids")), "raw_turnover": F.col("turnover"), "raw_count": F.col("trade_count"),
    }).where(reduce(lambda a, b: a | b, [within[lane] for lane in sorted(wanted)]))
    needs = lambda spec: reduce(lambda a, b: a & b, [within[lane] for lane in spec.lanes])
    return rows.select(*KEY, *[F.when(needs(spec), F.round(F.expr(spec.expression), PLACES)).alias(spec.name) for spec in specs])


def one_day_change(frame: DataFrame, steps: DataFrame, columns: list[str]) -> DataFrame:
    """date, instrument_key, previous_date, and for each column its previous value and its change since the previous available date.

    A row whose instrument has no row on that very date is dropped: the step is the calendar's, not the instrument's. With no
    predecessor at all the result is empty.
    """
    days = steps.where(F.col("previous_date").isNotNull()).select("date", "previous_date")
    before = frame.select(F.col("date").alias("previous_date"), "instrument_key", *[F.col(c).alias(f"previous_{c}") for c in columns])
    joined = frame.join(F.broadcast(days), "date").join(before, ["previous_date", "instrument_key"])
    return joined.select("date", "instrument_key", "previous_date", *columns, *[f"previous_{c}" for c in columns], *[(F.col(c) - F.col(f"previous_{c}")).alias(f"{c}_change") for c in columns])


def wide_factors(level: DataFrame, steps: DataFrame, specs: tuple[FactorSpec, ...] = SPECS) -> DataFrame:
    """Levels and changes side by side: one self-join whatever the number of factors."""
    names = [spec.name for spec in specs]
    days = steps.where(F.col("previous_date").isNotNull()).select("date", "previous_date")
    before = level.select(F.col("date").alias("previous_date"), "instrument_key", *[F.col(c).alias(f"__{c}") for c in names])
    joined = level.join(F.broadcast(days), "date", "left").join(before, ["previous_date", "instrument_key"], "left")
    return joined.select(*KEY, *names, *[F.round(F.col(c) - F.col(f"__{c}"), PLACES).alias(f"{c}_change") for c in names])


def long(wide: DataFrame, columns: list[str], *beside: str) -> DataFrame:
    """(factor, date, instrument_key, score) of the columns that are not null, with the columns ``beside``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("score")) for c in columns])
    return wide.select(*KEY, *beside, F.inline(pairs)).where(F.col("score").isNotNull()).select("factor", *KEY, "score", *beside)
