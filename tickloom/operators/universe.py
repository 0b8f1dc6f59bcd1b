"""Restriction to a universe of instruments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The universe's version, carried by results made with it.
UNIVERSE_VERSION = "stock_research_candidate_filter_v1"
#: Universes of up to so many instruments are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def members(universe: DataFrame) -> DataFrame:
    """Keys of the instruments that are research candidates."""
    return universe.where("stock_research_candidate").select("instrument_key")


def restrict(ticks: DataFrame, universe: DataFrame, name: str = "stock_research_candidate") -> DataFrame:
    """Rows of instruments in the universe (a left-semi join: no column is added, no row repeated).

    The number of instruments, not of ticks, decides whether the universe is broadcast.
    """
    if not name:
        raise ValueError("the universe needs a name")
    keys = members(universe)
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return ticks.join(F.broadcast(keys) if few else keys, "instrument_key", "left_semi")
