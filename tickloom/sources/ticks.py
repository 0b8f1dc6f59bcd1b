"""Tick and daily tables partitioned by year and date: scans, caches, and what is missing of them.

Layout: ``<root>/<table>/year=YYYY/date=YYYY-MM-DD/*.parquet``. Which dates there are follows from the folders' names: no file is opened
for it. A load reads the wanted dates' folders only, and each of them with the wanted columns only.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import instrument_key
from tickloom.operators import daily
from tickloom.operators.universe import restrict

#: The tables and the columns of the daily ones.
TICK_TABLES = ("verified_trades", "verified_orders")
DAILY_TABLES = {
    "verified_trades_daily": ("date", "instrument_key", "trade_count", "turnover", "share_volume", "avg_trade_size", "close_like_price", "vwap", "instrument_key_source"),
    "verified_orders_daily": ("date", "instrument_key", "order_event_count", "unique_order_ids", "total_order_notional", "churn_ratio", "instrument_key_source"),
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a store has a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def scan(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A partitioned table; ``date`` is a date, ``year`` is dropped."""
    if table not in (*TICK_TABLES, *DAILY_TABLES):
        raise ValueError(f"unknown table {table}")
    path = f"{root}/{table}"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.option("basePath", path).parquet(path).withColumn("date", F.col("date").cast("date")).drop("year")


def folders(spark: SparkSession, root: str, table: str, years: Iterable[int] | None = None) -> dict[str, str]:
    """Path of each date's folder, by date: a few hundred names a year, listed by the store."""
    if table not in (*TICK_TABLES, *DAILY_TABLES):
        raise ValueError(f"unknown table {table}")
    wanted = ["*"] if years is None else sorted({str(int(y)) for y in years})
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    store = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for year in wanted:
        for status in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(base, f"year={year}/date=*")) or []:
            found[status.getPath().getName().removeprefix("date=")] = status.getPath().toString()
    return dict(sorted(found.items()))


def partition_dates(spark: SparkSession, root: str, table: str, years: Iterable[int] | None = None) -> list[str]:
    """The dates that a table has folders of, in order; none for a table that isn't there."""
    return list(folders(spark, root, table, years))


def manifest_dates(spark: SparkSession, manifest: str, table: str) -> list[str]:
    """The dates that a manifest lists for a table (``tables`` -> table -> ``dates``), or for all tables (``dates``); none if it isn't there."""
    if not exists(spark, manifest):
        return []
    held = json.loads(spark.read.text(manifest, wholetext=True).first()[0])  # one small file, in any store
    listed = held.get("tables", {}).get(table, held).get("dates", [])
    return sorted({str(d) for d in listed})


def data_version(spark: SparkSession, paths: Iterable[str]) -> str:
    """A digest of the files under some paths: relative names, sizes and times of change. Equal digests stand for equal input."""
    lines = []
    for path in sorted(paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files = store.listFiles(at, True)
        base = len(store.makeQualified(at).toString())
        while files.hasNext():
            f = files.next()
            if not f.getPath().getName().startswith(("_", ".")):
                lines.append(f"{at.getName()}{f.getPath().toString()[base:]}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()[:16]


def date_frame(spark: SparkSession, dates: Iterable[str]) -> DataFrame:
    """(date) of some dates, each once."""
    return spark.createDataFrame([(d,) for d in sorted(set(dates))], "day string").select(F.col("day").cast("date").alias("date"))


def available_dates(spark: SparkSession, root: str, table: str, year: int, manifest: str | None = None) -> DataFrame:
    """Dates of a year, in order: those of the folders and of the manifest (``<root>/manifests/year=<year>/summary.json`` without another)."""
    found = set(partition_dates(spark, root, table, [year]))
    found |= {d for d in manifest_dates(spark, manifest or f"{root}/manifests/year={year}/summary.json", table) if d.startswith(f"{year:04d}-")}
    if not found:
        raise ValueError(f"no dates of {table} in {year}")
    return date_frame(spark, found).orderBy("date")


def load(spark: SparkSession, root: str, table: str, dates: list[str], columns: list[str] | None = None, universe: DataFrame | None = None, key_column: str = "instrument_key") -> DataFrame:
    """Rows of some dates: the wanted columns, each once and in order, restricted to a universe.

    Tick tables get the instrument key from ``source_file`` and always return it last; daily tables hold it, and return it only if wanted.
    A wanted date without a partition is an error.
    """
    if not dates:
        raise ValueError("no dates")
    path, wanted = f"{root}/{table}", sorted(set(dates))
    held = folders(spark, root, table, {d[:4] for d in wanted})
    if not held and not exists(spark, path):
        raise FileNotFoundError(path)
    if lost := [d for d in wanted if d not in held]:
        raise FileNotFoundError(f"{table} has no partition of {', '.join(lost)}")
    frame = spark.read.option("basePath", path).parquet(*[held[d] for d in wanted]).where(F.col("date").isin([F.lit(d).cast("date") for d in wanted])).withColumn("date", F.col("date").cast("date")).drop("year")
    out = list(dict.fromkeys(columns or frame.columns))
    if table in TICK_TABLES:
        frame = frame.withColumn(key_column, instrument_key("source_file"))
        out = [c for c in out if c != key_column] + [key_column]
    if universe is not None:
        frame = restrict(frame, universe)
    return frame.select(*out)


def write_daily(spark: SparkSession, root: str, table: str, ticks: DataFrame, force: bool = False, order_by: Column | None = None) -> DataFrame:
    """Aggregates ticks into a daily table, all dates in one job; dates that it holds are skipped unless ``force``.

    Returns date, status (built or skipped) and the number of rows.
    """
    if table not in DAILY_TABLES:
        raise ValueError(f"unknown daily table {table}")
    path = f"{root}/{table}"
    days = ticks.select("date").distinct()
    held = set() if force else set(partition_dates(spark, root, table))
    every = [str(r["date"]) for r in days.collect()]  # one value a day
    todo = [d for d in every if d not in held]
    if todo:
        frame = ticks.where(F.col("date").isin([F.lit(d).cast("date") for d in todo]))
        built = daily.trades_daily(frame, order_by) if table == "verified_trades_daily" else daily.orders_daily(frame)
        (
            built.select(*DAILY_TABLES[table]).withColumn("year", F.year("date")).repartition("year", "date").sortWithinPartitions("instrument_key")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "date").parquet(path)
        )
    counts = scan(spark, root, table).groupBy("date").count()
    status = F.when(F.col("date").isin([F.lit(d).cast("date") for d in todo]) if todo else F.lit(False), "built").otherwise("skipped")
    return date_frame(spark, every).join(counts, "date", "left").select("date", status.alias("status"), F.coalesce("count", F.lit(0)).alias("rows"))


#: The ticks that each daily table is made of.
MADE_OF = {"verified_trades_daily": ("verified_trades", ("date", "Time", "Price", "Volume", "row_num_in_file")), "verified_orders_daily": ("verified_orders", ("date", "OrderId", "Price", "Volume"))}


def aggregated(spark: SparkSession, root: str, table: str, dates: list[str], universe: DataFrame | None = None) -> DataFrame:
    """A daily table's rows of some dates, from those dates' ticks alone."""
    source, columns = MADE_OF[table]
    ticks = load(spark, root, source, dates, list(columns), universe)
    built = daily.trades_daily(ticks) if table == "verified_trades_daily" else daily.orders_daily(ticks)
    return built.select(*DAILY_TABLES[table])


def daily_rows(spark: SparkSession, root: str, table: str, dates: list[str], universe: DataFrame | None = None, fill: bool = False) -> DataFrame:
    """A daily table's rows of all the dates: those that it holds from it, the others aggregated from their ticks.

    With ``fill`` the missing dates are first added to the table, for all instruments, each by an overwrite of its own partition; ticks of
    dates that the table holds are not read either way. A date whose ticks give no row (no volume) has no partition afterwards
    and is aggregated again.
    """
    held = set(partition_dates(spark, root, table, {d[:4] for d in dates}))
    lacking = [d for d in dates if d not in held]
    if fill and lacking:
        write_daily(spark, root, table, load(spark, root, MADE_OF[table][0], lacking, list(MADE_OF[table][1])))
        held |= set(partition_dates(spark, root, table, {d[:4] for d in lacking}))
        lacking = [d for d in dates if d not in held]
    there = [d for d in dates if d in held]
    parts = [load(spark, root, table, there, list(DAILY_TABLES[table]), universe)] if there else []
    parts += [aggregated(spark, root, table, lacking, universe)] if lacking else []
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def missing(spark: SparkSession, root: str, tables: list[str], dates: DataFrame) -> DataFrame:
    """(table, date) of wanted dates that a daily table has no partition of."""
    out = None
    for table in tables:
        held = date_frame(spark, partition_dates(spark, root, table))
        part = dates.select("date").distinct().join(held, "date", "left_anti").select(F.lit(table).alias("table"), "date")
        out = part if out is None else out.unionByName(part)
    return out


def write_universe(spark: SparkSession, instruments: DataFrame, path: str, force: bool = False) -> dict[str, object]:
    """Writes a universe sidecar (instrument_key, stock_research_candidate) once, or again by ``force``; returns its status.

    A key is a member if any of its rows says so; rows without a key are left out.
    """
    if force or not exists(spark, path):
        keyed = instruments.where(F.col("instrument_key").isNotNull()).groupBy("instrument_key").agg(F.max(F.coalesce("stock_research_candidate", F.lit(False))).alias("stock_research_candidate"))
        keyed.sortWithinPartitions("instrument_key").write.mode("overwrite").parquet(path)
    return universe_status(spark, path)


def universe_status(spark: SparkSession, path: str) -> dict[str, object]:
    """Whether a universe sidecar can be read, and how many members it has."""
    if not exists(spark, path):
        return {"path": path, "ready": False, "instruments": 0, "members": 0}
    counts = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.count_if("stock_research_candidate").alias("members")).first()
    return {"path": path, "ready": True, "instruments": counts["n"], "members": counts["members"]}


def write_scores(scores: DataFrame, path: str, score: str = "score", preview: int = 10) -> str:
    """Writes a factor's output by date and falling score; returns the first rows as JSON."""
    ordered = scores.orderBy("date", F.desc(score), "instrument_key")
    ordered.write.mode("overwrite").parquet(path)
    return json.dumps([json.loads(r) for r in ordered.limit(preview).toJSON().collect()])
