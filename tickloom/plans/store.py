"""Results of factor runs under one root, each by the key of what it depends on: a later cycle reads what it finds and computes the rest.

A run's key is a digest of its factor, its expression and transform, its card, the scored dates, the version of the input files, the universe's
filter and the evaluation's parameters. Rows of all runs of one kind (scores, evaluation by date, backtest by date, regimes) lie in one table
partitioned by key, and are written by an overwrite of their own partitions. A run is in the ledger only after its rows are written, and
a batch's entry has a name made from its keys: a job that dies half-way, or runs twice, leaves nothing double.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.sources import logs
from tickloom.sources.ticks import exists

PAIRS = "left_key string, right_key string, left_factor string, right_factor string, date date, common_rows long, pearson_corr double, top_overlap_count long"
RUNS = "key string, run_id string, created_at string, factor string, family string, card string, transform string, expression string, dates string, version string, universe string, parameters string"


@dataclass(frozen=True)
class Run:
    """What a factor's results depend on."""

    factor: str
    family: str
    card: str
    transform: str
    expression: str
    dates: str
    version: str
    universe: str
    parameters: str

    @property
    def key(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:20]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str) -> str:
        return f"{self.root}/store/{name}"

    def runs(self) -> DataFrame:
        """The ledger, the first entry of each key."""
        if not exists(self.spark, self.path("ledger")):
            return self.spark.createDataFrame([], RUNS)
        rows = self.spark.read.schema(RUNS).json(self.path("ledger"))
        return rows.withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy("created_at", "run_id"))).where("__r = 1").drop("__r")

    def made_by(self, keys: Iterable[str]) -> dict[str, str]:
        """run_id by key, of the keys that the ledger holds."""
        asked = self.spark.createDataFrame([(k,) for k in sorted(set(keys))], "key string")
        return {r["key"]: r["run_id"] for r in self.runs().join(asked, "key", "left_semi").select("key", "run_id").collect()}

    def commit(self, runs: Iterable[Run], run_id: str, created_at: str) -> None:
        """Enters runs, in one file named by their keys."""
        entries = [asdict(r) | {"key": r.key, "run_id": run_id, "created_at": created_at} for r in runs]
        if entries:
            name = hashlib.sha256(",".join(sorted(e["key"] for e in entries)).encode()).hexdigest()[:20]
            logs.write_text(self.spark, "".join(json.dumps(e) + "\n" for e in entries), f"{self.path('ledger')}/{name}.json")

    def put(self, name: str, frame: DataFrame) -> None:
        """Writes rows with a ``key``; a key's earlier rows are replaced."""
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(self.path(name))

    def get(self, name: str, keys: Iterable[str]) -> DataFrame:
        """The rows of some keys, without the key; other keys' files are not opened."""
        rows = self.spark.read.option("basePath", self.path(name)).parquet(*[p for k in sorted(set(keys)) if exists(self.spark, p := f"{self.path(name)}/key={k}")])
        return rows.drop("key")

    def pairs(self) -> DataFrame:
        if not exists(self.spark, self.path("pairs")):
            return self.spark.createDataFrame([], PAIRS)
        return self.spark.read.schema(PAIRS).parquet(f"{self.path('pairs')}/*")

    def missing_pairs(self, keys: dict[str, str]) -> list[tuple[str, str]]:
        """Pairs of factors (the smaller name first) whose comparison is not there; keys: the key by factor."""
        names = sorted(keys)
        asked = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        if not asked:
            return []
        wanted = self.spark.createDataFrame([(a, b, keys[a], keys[b]) for a, b in asked], "left_factor string, right_factor string, left_key string, right_key string")
        return sorted(tuple(r) for r in wanted.join(self.pairs(), ["left_key", "right_key"], "left_anti").select("left_factor", "right_factor").collect())

    def put_pairs(self, merged: DataFrame, keys: dict[str, str], asked: list[tuple[str, str]]) -> None:
        """Writes comparisons by pair and date in a folder named by their pairs' keys; a pair without a common date has one row of nulls, so that it counts as made."""
        name = hashlib.sha256(",".join(f"{keys[a]}-{keys[b]}" for a, b in asked).encode()).hexdigest()[:20]
        wanted = self.spark.createDataFrame([(a, b, keys[a], keys[b]) for a, b in asked], "left_factor string, right_factor string, left_key string, right_key string")
        rows = wanted.join(merged, ["left_factor", "right_factor"], "left")
        rows.select("left_key", "right_key", "left_factor", "right_factor", "date", "common_rows", "pearson_corr", "top_overlap_count").coalesce(1).write.mode("overwrite").parquet(f"{self.path('pairs')}/{name}")

    def compared(self, keys: dict[str, str]) -> DataFrame:
        """Comparisons of all pairs of the factors, each pair's once."""
        held = self.spark.createDataFrame(sorted(keys.items()), "factor string, key string")
        left, right = held.select(F.col("key").alias("left_key")), held.select(F.col("key").alias("right_key"))
        rows = self.pairs().join(left, "left_key", "left_semi").join(right, "right_key", "left_semi").where(F.col("date").isNotNull())
        return rows.dropDuplicates(["left_key", "right_key", "date"]).drop("left_key", "right_key")
