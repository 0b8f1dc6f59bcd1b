"""Intermediate frames over lane E that the catalogue's queries share."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import backtest, compare, daily, dates, diagnostics, evaluate, factors, information, regimes, shape
from tickloom.operators.universe import UNIVERSE_VERSION, restrict
from tickloom.plans import policy, profiles
from tickloom.plans.sql import PERMUTATIONS, TE_PERMUTATIONS
from tickloom.sources import lanes, shared, ticks

TOP = 20
FRACTION = 0.1


class Lane:
    """Lane E of one directory; frames are built when asked for and kept lazily. ``close`` lets go of what was persisted.

    specs: the level factors; names: which of their levels and changes are scored (all); anchors: the dates that are scored (all);
    baselines: the factors that others are held against.
    """

    #: What the lane restricts ticks to, and by which version of the filter.
    target, version = "stock_research_candidate", UNIVERSE_VERSION
    source, cross_security = "target_only", False

    def __init__(self, spark: SparkSession, sf_dir: str, specs: tuple[factors.FactorSpec, ...] = factors.SPECS, names: list[str] | None = None, anchors: list[str] | None = None, baselines: tuple[str, ...] = factors.BASELINES):
        self.spark, self.sf_dir = spark, sf_dir
        self.specs, self.names, self.anchors, self.baselines = specs, names or factors.factor_names(specs), anchors, baselines
        self._held: dict[str, DataFrame] = {}
        self._persisted: list[DataFrame] = []
        self._paths: list[str] = []
        self.profiles: dict[str, dict] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._held:
            self._held[name] = make()
        return self._held[name]

    def _persist(self, frame: DataFrame) -> DataFrame:
        self._persisted.append(frame.persist())
        return frame

    def _keep(self, frame: DataFrame) -> DataFrame:
        """The frame as a written table: evaluation, comparison and triage build on it without planning all that led to it again."""
        out, path = shared.written(frame, "lane")
        self._paths.append(path)
        return out

    def restricted(self, names: list[str]) -> Lane:
        """The same lane for some of its factors, computing those alone; what is persisted already is shared."""
        part = copy.copy(self)
        part.names, part.specs = names, tuple(s for s in self.specs if s.name in names or s.change in names)
        part._held = {k: v for k, v in self._held.items() if k in ("ticks", "tagged", "trades", "orders", "raw", "steps", "labels", "regimes")}
        part._persisted, part._paths = [], []
        return part

    def close(self) -> None:
        """Releases what is persisted and removes what was written; frames asked for afterwards are made anew."""
        for frame in self._persisted:
            frame.unpersist()
        for path in self._paths:
            shared.removed(self.spark, path)
        self._persisted, self._paths, self._held = [], [], {}

    def inputs(self) -> list[str]:
        """The paths that scores are made from."""
        return [f"{self.sf_dir}/{t}.parquet" for t in ("events", "customer")]

    def ticks(self) -> DataFrame:
        """All ticks of the universe: one scan and one semi-join feed every daily table."""
        return self._once("ticks", lambda: restrict(lanes.event_ticks(self.spark, self.sf_dir), lanes.event_universe(self.spark, self.sf_dir)))

    def last_by(self) -> Column:
        """What orders a day's ticks."""
        return F.struct("ts", "row_num_in_file")

    def trades(self) -> DataFrame:
        return self.ticks().drop("OrderId", "is_order")

    def tagged(self) -> DataFrame:
        """All daily tables in one. Persisted: a daily row stands for all its ticks, so what is kept is small, and ticks are not scanned again."""
        return self._once("tagged", lambda: self._persist(daily.tagged_daily(self.ticks(), self.last_by())))

    def trades_daily(self) -> DataFrame:
        return self._once("trades", lambda: daily.trades_of(self.tagged()))

    def orders_daily(self) -> DataFrame:
        return self._once("orders", lambda: daily.orders_of(self.tagged()))

    def raw_daily(self) -> DataFrame:
        return self._once("raw", lambda: shape.shaped(daily.raw_of(self.tagged()), self.trades()))

    def steps(self) -> DataFrame:
        """The calendar of all ticks, from their daily rows."""
        return self._once("steps", lambda: dates.stepped(dates.calendar(self.tagged())))

    def levels(self) -> DataFrame:
        return self._once("levels", lambda: self._persist(self._levels({lane for spec in self.specs for lane in spec.lanes})))

    def _levels(self, needs: set[str]) -> DataFrame:
        return factors.levels_of_tagged(shape.shaped(self.tagged(), self.trades()) if "raw" in needs else self.tagged(), self.specs)

    def wide(self) -> DataFrame:
        """All factors side by side; persisted, as scores and correlations both start from it."""
        return self._once("wide", lambda: self._persist(factors.wide_factors(self.levels(), self.steps(), self.specs)))

    def anchored(self, frame: DataFrame) -> DataFrame:
        return frame if self.anchors is None else frame.where(F.col("date").isin([F.lit(d).cast("date") for d in self.anchors]))

    def long(self) -> DataFrame:
        """The factors as (factor, date, instrument_key, score)."""
        return factors.long(self.anchored(self.wide()), self.names)

    def labelled_wide(self) -> DataFrame:
        """The wide rows with their labels, in as many tasks as the scores in them ask for: what reads the scores holds a bounded part of them in a task."""

        def make() -> DataFrame:
            wide = self.anchored(self.wide())
            tasks = evaluate.tasks_for(wide, wide.count() * len(self.names))
            return self._persist(evaluate.with_labels(wide, self.labels()).repartition(tasks, "date", "instrument_key"))

        return self._once("labelled_wide", make)

    def judged(self) -> DataFrame:
        """The same with their labels (null where there is none). Wide rows are kept, and become scores in the tasks that read them."""
        return self._once("judged", lambda: factors.long(self.labelled_wide(), self.names, "label"))

    def scores(self) -> DataFrame:
        return self._once("scores", lambda: self.judged().drop("label"))

    def placed(self) -> DataFrame:
        """The labelled scores, dealt by factor and date; the number of tasks follows from their number."""
        rows = self.judged().where(F.col("label").isNotNull())
        return evaluate.dealt(rows, self.judged().count())

    def ranked(self) -> DataFrame:
        """Ranks and places of the labelled scores, written: evaluation, bins and backtest read the same."""
        return self._once("ranked", lambda: self._keep(evaluate.ranked(self.placed())))

    def raw_lane(self) -> DataFrame:
        """Daily trades of all instruments with a tick, those without volume too: what factors of the raw lane are computed from."""
        return self._once("raw_lane", lambda: daily.trades_of(self.tagged(), positive_volume=False))

    def labels(self) -> DataFrame:
        return self._once("labels", lambda: self.anchored(evaluate.forward_labels(self.trades_daily(), self.steps())))

    def per_date(self) -> DataFrame:
        return self._once("per_date", lambda: evaluate.per_date(self.scores(), self.labels(), FRACTION, self.ranked()))

    def binned(self) -> DataFrame:
        return self._once("binned", lambda: information.binned(self.ranked()).select("factor", "date", "instrument_key", "n", "bins", "score_bin", "label_bin"))

    def information(self) -> DataFrame:
        return self._once("mi", lambda: information.mutual_information(self.binned()))

    def significance(self) -> DataFrame:
        return self._once("tests", lambda: information.mi_significance(self.binned(), PERMUTATIONS, keep=self._keep))

    def evaluated(self) -> DataFrame:
        tests = self.significance().select("factor", "date", F.col("p_value").alias("mi_p_value"), F.col("excess_over_null").alias("mi_excess_over_null"), F.col("significant").alias("mi_significant"))
        return self._once("evaluated", lambda: self._keep(self.per_date().join(self.information().select("factor", "date", "mi", "nmi"), ["factor", "date"], "left").join(tests, ["factor", "date"], "left")))

    def signs(self) -> DataFrame:
        return self._once("signs", lambda: evaluate.sign_summary(self.evaluated()))

    def stats(self) -> DataFrame:
        return self._once("stats", lambda: evaluate.summary(self.evaluated()).join(self.signs().select("factor", "evaluated_count", "sign_consistency", "sign_switch_count"), "factor", "left"))

    def regimes(self) -> DataFrame:
        return self._once("regimes", lambda: regimes.regime_labels(regimes.market_stats(self.trades_daily())))

    def slices(self) -> DataFrame:
        return self._once("slices", lambda: regimes.slice_summary(self.evaluated(), self.regimes()))

    def correlations(self) -> DataFrame:
        return self._once("corr", lambda: self._keep(compare.correlation_of_columns(self.anchored(self.wide()), self.names)))

    def overlaps(self) -> DataFrame:
        return self._once("over", lambda: self._keep(compare.top_overlap_by_date(self.scores(), TOP)))

    def baseline(self) -> DataFrame:
        return compare.baseline_redundancy(self.correlations(), self.overlaps(), self.baselines)

    def peers(self) -> DataFrame:
        return compare.peer_redundancy(self.correlations(), self.overlaps())

    def backtest(self) -> DataFrame:
        return self._once("backtest", lambda: self._keep(backtest.by_date(self.scores(), self.labels(), FRACTION, self.ranked())))

    def backtest_summary(self) -> DataFrame:
        return backtest.summary(self.scores(), self.backtest())

    def triaged(self) -> DataFrame:
        """The board's row of each factor, with its reject reasons and readiness."""
        entropy = self.slices().where(F.col("slice_name") == "entropy_quantile").groupBy("factor").agg(F.collect_list("mean_abs_rank_ic").alias("entropy_values"))
        tested = self.backtest_summary().select("factor", "hit_rate", "stability_proxy", "spread_return", "turnover_proxy")
        counts = diagnostics.score_summary(self.scores(), ["factor"]).select("factor", "distinct_instruments", F.col("rows").alias("output_rows"), F.col("score_mean").alias("overall_score_mean"))
        board = policy.catalogue(self.spark, self.specs, self.names, self.target, self.version, self.source, self.cross_security).join(self.stats(), "factor")
        if self.profiles:
            board = board.drop(*profiles.FLAGS_ON_BOARD).join(profiles.board_rows(self.spark, self.profiles), "factor")
        for part in (self.baseline(), self.peers(), regimes.entropy_digest(self.slices()), entropy, counts, tested):
            board = board.join(part, "factor", "left")
        return self._once("triaged", lambda: policy.reject_reasons(board))

    def board(self) -> DataFrame:
        hint = policy.incremental_hint(F.col("baseline_role"), F.col("mean_abs_rank_ic"), F.col("mean_abs_baseline_corr"))
        return policy.recommendation(self.triaged()).withColumn("incremental_hint", hint)

    def series(self) -> DataFrame:
        """Written: one row a factor and date, from which pairs, sets of dates and permutations are all made."""
        return self._once("series", lambda: self._keep(information.metric_series(self.per_date(), "rank_ic")))

    def te_tests(self) -> DataFrame:
        """Written: one row a pair, read from both of its sides."""
        return self._once("te_tests", lambda: self._keep(information.te_tests(self.series(), TE_PERMUTATIONS, keep=self._keep)))

    def pairs(self) -> DataFrame:
        return information.aligned_pairs(self.series())


class TickLane(Lane):
    """The same frames over tick tables (sources.ticks), for all available dates of some years, or for anchor dates with their neighbours.

    Dates come from the tables' folders. Daily frames come from the daily tables for the dates that those hold, and from the ticks of the other
    dates; with ``fill`` the missing dates are added to the daily tables first. Statistics that need ticks read ticks. Without a universe every
    instrument is scored, and the lane says so.
    """

    def __init__(self, spark: SparkSession, root: str, years: list[int], universe: DataFrame | None = None, fill: bool = False, **options):
        super().__init__(spark, root, **options)
        self.root, self.years, self.universe, self.fill = root, years, universe, fill
        if universe is None:
            self.target, self.version = "all_instruments", ""

    def calendar(self) -> list[str]:
        """All available dates of the years."""
        return ticks.partition_dates(self.spark, self.root, "verified_trades", self.years)

    def days(self) -> list[str]:
        """The dates to read: the available ones, or the anchors with the dates before and after each in its year."""
        if not hasattr(self, "_days"):
            every = self.calendar()
            if self.anchors is not None:
                if lost := sorted(set(self.anchors) - set(every)):
                    raise FileNotFoundError(f"no ticks of {', '.join(lost)}")
                near = {i + step for i, d in enumerate(every) if d in set(self.anchors) for step in (-1, 0, 1) if 0 <= i + step < len(every) and every[i + step][:4] == d[:4]}
                every = [every[i] for i in sorted(near)]
            self._days = every
        return self._days

    def inputs(self) -> list[str]:
        held = {t: ticks.folders(self.spark, self.root, t, self.years) for t in ticks.TICK_TABLES}
        return [path for found in held.values() for day, path in found.items() if day in set(self.days())]

    def _dates(self) -> DataFrame:
        return ticks.date_frame(self.spark, self.calendar())

    def cached(self, table: str) -> bool:
        """Whether a daily table holds every date."""
        return set(self.days()) <= set(ticks.partition_dates(self.spark, self.root, table, self.years))

    def last_by(self) -> Column:
        return F.struct("Time", "row_num_in_file")

    def ticks(self) -> DataFrame:
        return self.trades()

    def trades(self) -> DataFrame:
        return self._once("ticks", lambda: ticks.load(self.spark, self.root, "verified_trades", self.days(), ["date", "Time", "Price", "Volume", "TradeDir", "row_num_in_file"], self.universe))

    def _daily(self, table: str) -> DataFrame:
        return self._persist(ticks.daily_rows(self.spark, self.root, table, self.days(), self.universe, self.fill))

    def trades_daily(self) -> DataFrame:
        return self._once("trades", lambda: self._daily("verified_trades_daily"))

    def orders_daily(self) -> DataFrame:
        return self._once("orders", lambda: self._daily("verified_orders_daily"))

    def raw_daily(self) -> DataFrame:
        return self._once("raw", lambda: shape.raw_statistics(self.trades()))

    def _levels(self, needs: set[str]) -> DataFrame:
        part = lambda lane, make: make() if lane in needs else None
        return factors.levels(part("trades", self.trades_daily), part("orders", self.orders_daily), part("raw", self.raw_daily), self.specs)

    def raw_lane(self) -> DataFrame:
        return self._once("raw_lane", lambda: daily.trades_daily(self.trades(), self.last_by(), positive_volume=False))

    def steps(self) -> DataFrame:
        return self._once("steps", lambda: dates.stepped(self._dates()))

    def regimes(self) -> DataFrame:
        """By year alone where the daily trades are not cached: regimes are not worth a pass over the ticks."""
        return self._once("regimes", lambda: super(TickLane, self).regimes() if self.fill or self.cached("verified_trades_daily") else regimes.year_only(ticks.date_frame(self.spark, self.days())))
