"""Connected components of an edge table, by alternating large and small stars.

Every step is a shuffle of edges with partial minima; no component, and no list of edges, ever meets in one place. Edges
after convergence point from each node to the smallest node of its component. Hot nodes (star centres) only take part in
partial minima and in joins whose large partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import written

#: Steps after which a table that still changes is an error (each step at least halves what is left, in practice).
MOST_STEPS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v) but the roots themselves. Self loops are ignored; no edges give no rows."""
    held = written(edges.where(F.col("u") != F.col("v")).select("u", "v"), "edges")
    mark = _mark(held)
    for _ in range(MOST_STEPS):
        if not mark[0]:
            break
        held = written(_small_star(_large_star(held)), "edges")
        now = _mark(held)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components still change after {MOST_STEPS} steps")
    return held.select("u", F.col("v").alias("root"))
