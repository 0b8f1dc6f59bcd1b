"""Mutual information, transfer entropy, and permutation tests, as counts of equal-frequency bins.

Permutations need no random numbers: permutation p orders rows by md5 of p, date and instrument. Since equal-frequency bins
depend on places only, a permuted score's bin is the bin of its place in that order; no values are moved. So a permuted score does not
depend on the score at all, but on which instruments have one and on their labels: factors with the same instruments on a date share
their permutations, and each set of instruments is ordered once, whatever the number of factors. Likewise a permuted source series depends on
the source and on the dates that it shares with a target, not on the target.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import adaptive_bins, effective_bins, frequency_bin
from tickloom.operators.evaluate import tasks_for
from tickloom.operators.universe import BROADCAST_ROWS

BY_DATE = ["factor", "date"]
GAP_PLACES = 10
#: A date's permutations are dealt in so many blocks, and so many draws of an instrument go to a task, or one block of a date: a task orders some hundred MB.
BLOCKS, DRAWS_A_TASK = 50, 500_000


def binned(joined: DataFrame, bins: int | None = None, by: list[str] = BY_DATE) -> DataFrame:
    """Adds n, bins, score_bin, label_bin within ``by`` (ties by instrument); rows that were ranked within it have their places already."""
    within = Window.partitionBy(*by)
    if {"n", "from_bottom", "by_label"} <= set(joined.columns) and by == BY_DATE:
        out = joined.withColumn("bins", adaptive_bins(F.col("n")) if bins is None else effective_bins(F.col("n"), bins))
        return out.withColumns({c: frequency_bin(F.col(place) - 1, F.col("bins"), F.col("n")) for c, place in (("score_bin", "from_bottom"), ("label_bin", "by_label"))})
    n = F.count(F.lit(1)).over(within)
    out = joined.withColumn("n", n).withColumn("bins", adaptive_bins(F.col("n")) if bins is None else effective_bins(F.col("n"), bins))
    place = lambda c: F.row_number().over(within.orderBy(c, "instrument_key")) - 1
    return out.withColumn("score_bin", frequency_bin(place("score"), F.col("bins"), F.col("n"))).withColumn("label_bin", frequency_bin(place("label"), F.col("bins"), F.col("n")))


def _information(cells: DataFrame, by: list[str]) -> DataFrame:
    """mi and the entropies of two bin columns: one shuffle to cell counts, the margins are windows over the few cells."""
    counts = cells.groupBy(*by, "score_bin", "label_bin").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumns({
        "n": F.sum("c").over(Window.partitionBy(*by)),
        "cs": F.sum("c").over(Window.partitionBy(*by, "score_bin")),
        "cl": F.sum("c").over(Window.partitionBy(*by, "label_bin")),
    })
    share = F.col("c") / F.col("n")
    # A margin's entropy is summed over its cells: each cell carries its share of -log(margin share).
    return counts.groupBy(*by).agg(
        F.sum(share * F.log(F.col("c") * F.col("n") / (F.col("cs") * F.col("cl")))).alias("mi"),
        F.sum(-share * F.log(F.col("cs") / F.col("n"))).alias("score_entropy"),
        F.sum(-share * F.log(F.col("cl") / F.col("n"))).alias("label_entropy"),
        F.max("n").alias("n"),
    )


def mutual_information(binned_rows: DataFrame, by: list[str] = BY_DATE) -> DataFrame:
    """By group: n, bins, mi, nmi (over the larger entropy), score_entropy, label_entropy. Null mi for a single row; 0 if a side has one bin."""
    bins = binned_rows.groupBy(*by).agg(F.max("bins").alias("bins"))
    found = _information(binned_rows, by).join(bins, by)
    flat = (F.col("score_entropy") <= 1e-15) | (F.col("label_entropy") <= 1e-15)
    one = F.col("n") <= 1
    nmi = F.try_divide("mi", F.greatest("score_entropy", "label_entropy"))
    zero = lambda c: F.when(one, F.lit(None)).when(flat, F.lit(0.0)).otherwise(c)
    return found.select(*by, "n", "bins", zero(F.col("mi")).alias("mi"), zero(nmi).alias("nmi"), F.abs("score_entropy").alias("score_entropy"), F.abs("label_entropy").alias("label_entropy"))


def _tasks(frame: DataFrame) -> int:
    """As many tasks as the session shuffles into: named, so that rows which are few before they are multiplied are not put together."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def permuted_information(binned_rows: DataFrame, sets: DataFrame, permutations: int, rows: int) -> DataFrame:
    """representative, date, permutation and the mutual information of score bins dealt anew with the label bins, for each set of instruments.

    ``sets`` names each set by its representative and numbers a date's sets from 1; ``rows`` is the number of the sets' rows. A permutation orders a date's
    instruments once, whatever the number of its sets: an instrument's place in a set is the number of the set's instruments up to it. Permutations leave both
    margins as they are, so only the cells' sum is new: mi = sum(c log c) / n - log n + both entropies. Instruments are dealt by date and block of permutations before they
    are multiplied, so order and counts need no further exchange.
    """
    if permutations < 1:
        raise ValueError("permutations must be at least 1")
    of_set = ["date", "__set"]
    members = binned_rows.join(F.broadcast(sets.select(F.col("representative").alias("factor"), "date", "__set").distinct()), BY_DATE)
    fixed = _information(members, of_set).select(*of_set, F.col("n"), (F.col("score_entropy") + F.col("label_entropy") - F.log("n")).alias("__margins"))
    sizes = members.groupBy(*of_set).agg(F.first("n").alias("n"), F.first("bins").alias("bins"))
    held = sets.agg(F.max("__set").alias("most"), F.sum(F.when(F.col("factor") == F.col("representative"), F.col("rows"))).alias("rows")).first()
    numbers = range(1, (held["most"] or 0) + 1)
    side = lambda i, value: F.max(F.when(F.col("__set") == i, F.col(value)))
    # Put side by side in as many tasks as the sets' rows ask for: partitions that follow bytes hold so many small rows that their hash tables spill.
    wide = members.select(*of_set, "instrument_key", "label_bin").repartition(tasks_for(members, held["rows"] or 0), "date", "instrument_key").groupBy("date", "instrument_key").agg(F.count(F.lit(1)).alias("__sets"), *[side(i, "label_bin").cast("int").alias(f"l{i}") for i in numbers])
    by_date = sizes.groupBy("date").agg(F.count(F.lit(1)).alias("__of"), *[side(i, c).alias(f"{c}{i}") for i in numbers for c in ("n", "bins")])

    blocks = min(permutations, BLOCKS)
    tasks = max(_tasks(binned_rows), -(-rows * permutations // DRAWS_A_TASK))
    tail = F.concat_ws(":", F.lit(""), F.col("date").cast("string"), "instrument_key")
    spread = wide.select("date", tail.alias("__tail"), *[f"l{i}" for i in numbers], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block")).repartition(tasks, "date", "__block")
    draws = F.sequence(F.col("__block") + 1, F.lit(permutations), F.lit(blocks))
    drawn = spread.withColumn("permutation", F.explode(draws)).withColumn("__order", F.md5(F.concat(F.col("permutation").cast("string"), "__tail").cast("binary"))).drop("__tail")
    run = ["date", "__block", "permutation"]
    up_to = Window.partitionBy(*run).orderBy("__order").rowsBetween(Window.unboundedPreceding, 0)
    placed = drawn.select(*run, *[f"l{i}" for i in numbers], *[F.count(f"l{i}").over(up_to).alias(f"p{i}") for i in numbers]).join(F.broadcast(by_date), "date")
    cell = lambda i: F.when(F.col(f"l{i}").isNotNull(), frequency_bin(F.col(f"p{i}") - 1, F.col(f"bins{i}"), F.col(f"n{i}")).cast("int") * 1_000 + F.col(f"l{i}"))
    dealt = placed.select(*run, F.inline(F.array(*[F.struct(F.lit(i).alias("__set"), cell(i).alias("cell")) for i in numbers]))).where(F.col("cell").isNotNull())
    cells = dealt.groupBy(*run, "__set", "cell").agg(F.count(F.lit(1)).alias("c"))
    sums = cells.groupBy(*run, "__set").agg(F.sum(F.col("c") * F.log("c")).alias("__cells"))
    names = sets.select("representative", *of_set).distinct()
    return sums.join(F.broadcast(fixed), of_set).join(F.broadcast(names), of_set).select("representative", "date", "permutation", (F.col("__cells") / F.col("n") + F.col("__margins")).alias("mi"))


def significance(observed: DataFrame, nulls: DataFrame, value: str, by: list[str], threshold: float = 0.05) -> DataFrame:
    """p value (1 + nulls at least as large) / (1 + nulls), the nulls' mean and population deviation, and the excess over the mean."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must be in (0, 1)")
    both = nulls.select(*by, F.col(value).alias("null_value")).join(observed.select(*by, F.col(value).alias("observed")), by)
    # Values that are equal but for rounding count as equal.
    drawn = both.groupBy(*by).agg(F.count(F.lit(1)).alias("draws"), F.count_if(F.col("null_value") >= F.col("observed") - 1e-12).alias("extreme"), F.avg("null_value").alias("null_mean"), F.stddev_pop("null_value").alias("null_std"), F.first("observed").alias("observed"))
    p = (F.col("extreme") + 1) / (F.col("draws") + F.lit(1.0))
    return drawn.select(*by, "observed", "draws", p.alias("p_value"), "null_mean", "null_std", (F.col("observed") - F.col("null_mean")).alias("excess_over_null"), (p <= threshold).alias("significant"))


def instrument_sets(binned_rows: DataFrame, by: list[str] = BY_DATE) -> DataFrame:
    """Each group with the first factor that has the same instruments (and so the same labels) on the date: ``by``, representative, the set's number
    within its date, and rows.

    Sets are told apart by their size and two 64-bit hashes of their members.
    """
    key = ["date", "__n", "__a", "__b"]
    sets = binned_rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.bit_xor(F.xxhash64("instrument_key")).alias("__a"), F.bit_xor(F.xxhash64(F.lit(1), "instrument_key")).alias("__b"))
    named = sets.withColumn("representative", F.min("factor").over(Window.partitionBy(*key)))
    return named.select(*by, "representative", F.dense_rank().over(Window.partitionBy("date").orderBy("representative")).alias("__set"), F.col("__n").alias("rows"))


def mi_significance(binned_rows: DataFrame, permutations: int = 100, threshold: float = 0.05, keep: Callable[[DataFrame], DataFrame] = DataFrame.cache) -> DataFrame:
    """Permutation test of each factor's mutual information by date; groups of one row have none.

    Bins and cells of the permutations are made once for each set of instruments and date; the factors of the set read the same nulls.
    keep: holds the sets, one row a factor and date.
    """
    rows = binned_rows.where(F.col("n") > 1)
    observed = mutual_information(rows)
    sets = keep(instrument_sets(rows))
    largest = sets.groupBy("date").agg(F.max("rows").alias("rows")).agg(F.sum("rows").alias("rows")).first()["rows"] or 0
    nulls = permuted_information(rows, sets, permutations, largest)
    shared = sets.select(*BY_DATE, "representative").join(nulls, ["representative", "date"])
    return significance(observed, shared, "mi", BY_DATE, threshold)


def turnover_entropy(daily: DataFrame, value: str = "turnover") -> DataFrame:
    """By date: entropy of the shares of positive turnover over its largest possible value; 0 for one instrument, null for none."""
    valid = daily.where(F.col(value) > 0).select("date", value)
    total = F.sum(value).over(Window.partitionBy("date"))
    share = valid.withColumn("p", F.col(value) / total)
    sums = share.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum(-F.col("p") * F.log("p")).alias("h"))
    found = sums.select("date", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.try_divide("h", F.log("n"))).alias("market_turnover_entropy"))
    return daily.select("date").distinct().join(found, "date", "left")


def metric_series(dates: DataFrame, metric: str, alias: str | None = None) -> DataFrame:
    """(factor, date, value) of a metric, or of its other name where it is null; dates without a value are left out."""
    value = F.col(metric) if alias is None else F.coalesce(metric, alias)
    return dates.select("factor", "date", value.alias("value")).where(F.col("value").isNotNull())


def aligned_pairs(series: DataFrame) -> DataFrame:
    """All ordered pairs of factors on their common dates: source, target, date, x, y, and the place and number of the date."""
    a = series.select(F.col("factor").alias("source"), "date", F.col("value").alias("x"))
    b = series.select(F.col("factor").alias("target"), "date", F.col("value").alias("y"))
    both = a.join(b, "date").where(F.col("source") != F.col("target"))
    pair = Window.partitionBy("source", "target")
    return both.withColumn("i", F.row_number().over(pair.orderBy("date"))).withColumn("dates", F.count(F.lit(1)).over(pair))


def _triplets(pairs: DataFrame, lag: int, by: list[str], bins: int | None, least: int, most: int) -> DataFrame:
    """Binned (source ``lag`` back, target one back, target) of each date that has them."""
    order = Window.partitionBy(*by).orderBy("i")
    rows = pairs.select(*by, "i", F.lag("x", lag).over(order).alias("u"), F.lag("y", 1).over(order).alias("v"), F.col("y").alias("w")).where(F.col("i") > lag)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = rows.withColumn("n", n).withColumn("bins", adaptive_bins(F.col("n"), least, most) if bins is None else effective_bins(F.col("n"), max(2, bins)))
    placed = {f"{c}b": frequency_bin(F.row_number().over(Window.partitionBy(*by).orderBy(c, "i")) - 1, F.col("bins"), F.col("n")) for c in "uvw"}
    return rows.withColumns(placed)


def _transfer(rows: DataFrame, by: list[str]) -> DataFrame:
    counts = rows.groupBy(*by, "ub", "vb", "wb").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("bins").alias("bins"))
    over = lambda *columns: F.sum("c").over(Window.partitionBy(*by, *columns))
    counts = counts.withColumns({"vu": over("vb", "ub"), "wv": over("wb", "vb"), "v": over("vb")})
    term = F.col("c") / F.col("n") * F.log(F.col("c") * F.col("v") / (F.col("vu") * F.col("wv")))
    return counts.groupBy(*by).agg(F.sum(term).alias("te"), F.max("n").alias("observations"), F.max("bins").alias("bins"))


def transfer_entropy(pairs: DataFrame, lag: int = 1, bins: int | None = None, least: int = 2, most: int = 8, min_overlap: int = 5) -> DataFrame:
    """By ordered pair: te from source to target, observations, bins; pairs with too few common dates are left out, and one observation gives 0."""
    if lag < 1:
        raise ValueError("lag must be at least 1")
    by = ["source", "target"]
    enough = pairs.where(F.col("dates") >= max(min_overlap, lag + 2))
    found = _transfer(_triplets(enough, lag, by, bins, least, most), by)
    return found.withColumn("te", F.when(F.col("observations") <= 1, F.lit(0.0)).otherwise(F.col("te")))


def _shared_series(series: DataFrame) -> DataFrame:
    """Each factor's values on the dates that it shares with each set of dates: factor, own, other, i, dates, value, date.

    ``own`` and ``other`` name sets of dates by a factor that has them. Two factors share dates by their sets alone, so a factor's series is
    cut once for each set, of which there are few, and not once for each other factor. The sets are a row a factor of the catalogue, read by the driver.
    """
    marks = series.groupBy("factor").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("date")).alias("a")).collect()
    first: dict[tuple[int, int], str] = {}
    for r in sorted(marks, key=lambda r: r["factor"]):
        first.setdefault((r["n"], r["a"]), r["factor"])
    spark = series.sparkSession
    sets = F.broadcast(spark.createDataFrame([(r["factor"], first[r["n"], r["a"]]) for r in marks], "factor string, own string"))
    named = series.join(sets, "factor")
    others = named.where(F.col("factor") == F.col("own")).select(F.col("own").alias("other"), "date")
    both = named.join(others, "date")
    within = Window.partitionBy("factor", "other")
    return both.select("factor", "own", "other", "date", "value", F.row_number().over(within.orderBy("date")).alias("i"), F.count(F.lit(1)).over(within).alias("dates"))


def te_tests(series: DataFrame, permutations: int = 200, lag: int = 1, bins: int | None = None, least: int = 2, most: int = 8, min_overlap: int = 5, threshold: float = 0.05, keep: Callable[[DataFrame], DataFrame] = DataFrame.cache) -> DataFrame:
    """Permutation test of the transfer entropy of every ordered pair of (factor, date, value): the source's values are dealt anew over its dates.

    The observed value is that of the order as it is, permutation 0. A source's bins are made once for each permutation and set of shared dates,
    a target's once for each set; a pair joins them by place. Its cells are counted in the partitions that the source's orders lie in
    already: (u, v, w), from them (v, u), from them the pair; what depends on (v, w) alone is the target's. Sides that
    are small enough by their count are broadcast. keep: holds the cut series, some rows a factor and date, which all sides read.
    """
    if lag < 1 or permutations < 1:
        raise ValueError("lag and permutations must be at least 1")
    cut = _shared_series(series).where(F.col("dates") >= max(min_overlap, lag + 2))
    n = F.col("dates") - lag
    k = adaptive_bins(n, least, most) if bins is None else effective_bins(n, max(2, bins))
    # Numbers stand for names while cells are counted: s for a source cut to a set of dates, t for a target.
    cut = keep(cut.withColumns({"n": n, "bins": k, "s": F.xxhash64("factor", "other"), "t": F.xxhash64("factor")}))
    placed = lambda by, *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    log = lambda c: c * F.log(c)

    later = cut.withColumn("before", F.lag("value", 1).over(Window.partitionBy("s").orderBy("i"))).where(F.col("i") > lag)
    target = later.withColumns({"vb": frequency_bin(placed(["s"], "before", "i"), F.col("bins"), F.col("n")), "wb": frequency_bin(placed(["s"], "value", "i"), F.col("bins"), F.col("n"))})
    # The sums over (v) and (v, w) are the same for every source and permutation.
    cells = target.groupBy("s", "vb", "wb").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.groupBy("s", "vb").agg(F.sum("c").alias("cv"), F.sum(log(F.col("c"))).alias("wv"))
    fixed = cells.groupBy("s").agg((F.sum(log(F.col("cv"))) - F.sum("wv")).alias("fixed"))
    target = target.join(fixed, "s").select("t", F.col("own").alias("other"), F.col("other").alias("own"), "i", (F.col("vb") * 1_000 + F.col("wb")).cast("int").alias("vw"), "fixed")

    drawn = cut.select("s", "t", "factor", "own", "other", "date", "value", "i", "n", "bins").repartition(_tasks(series), "s").withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    order = F.when(F.col("permutation") == 0, F.lpad(F.col("i").cast("string"), 10, "0")).otherwise(F.md5(F.concat_ws(":", F.col("permutation").cast("string"), "factor", F.col("date").cast("string")).cast("binary")))
    run = ["s", "permutation"]
    moved = drawn.withColumn("place", placed(run, order) + 1).where(F.col("place") <= F.col("n"))
    ub = frequency_bin(placed(run, "value", "place"), F.col("bins"), F.col("n")).cast("int")
    source = moved.select(*run, F.col("t").alias("itself"), "own", "other", (F.col("place") + lag).alias("i"), ub.alias("ub"))

    few = target.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = source.join(F.broadcast(target) if few else target, ["own", "other", "i"]).where(F.col("itself") != F.col("t"))
    by = [*run, "t"]
    vu, w = (F.floor(F.col("vw") / 1_000) * 1_000 + F.col("ub")).cast("int"), (F.col("vw") % 1_000).cast("int")
    counts = met.groupBy(*by, vu.alias("vu"), w.alias("w")).agg(F.count(F.lit(1)).alias("c"), F.first("fixed").alias("fixed"))
    counts = counts.groupBy(*by, "vu").agg(F.sum("c").alias("c"), F.sum(log(F.col("c"))).alias("uvw"), F.first("fixed").alias("fixed"))
    found = counts.groupBy(*by).agg(((F.sum("uvw") - F.sum(log(F.col("c"))) + F.first("fixed")) / F.sum("c")).alias("te"))
    # A pair's permutations lie together: the draws are held against the observed one in the same pass.
    draw = F.when(F.col("permutation") > 0, F.col("te"))
    with_observed = found.withColumn("observed", F.max(F.when(F.col("permutation") == 0, F.col("te"))).over(Window.partitionBy("s", "t")))
    out = with_observed.groupBy("s", "t").agg(
        F.max("observed").alias("observed"), F.count(draw).alias("draws"), F.count_if((F.col("permutation") > 0) & (F.col("te") >= F.col("observed") - 1e-12)).alias("extreme"), F.avg(draw).alias("null_mean"), F.stddev_pop(draw).alias("null_std"),
    )
    sources = cut.groupBy("s").agg(F.first("factor").alias("source"), F.first("n").alias("observations"), F.first("bins").alias("bins"))
    targets = cut.groupBy("t").agg(F.first("factor").alias("target"))
    p = (F.col("extreme") + 1) / (F.col("draws") + F.lit(1.0))
    return out.join(sources, "s").join(targets, "t").select(
        "source", "target", "observations", (F.col("observations") + lag).alias("sample_days"), "bins", "observed", "draws", p.alias("p_value"), "null_mean", "null_std", (F.col("observed") - F.col("null_mean")).alias("excess_over_null"), (p <= threshold).alias("significant"),
    )


def te_significance(pairs: DataFrame, permutations: int = 200, lag: int = 1, bins: int | None = None, least: int = 2, most: int = 8, min_overlap: int = 5, threshold: float = 0.05) -> DataFrame:
    """``te_tests`` of the pairs given: (source, target, date, x, y)."""
    series = pairs.select(F.col("source").alias("factor"), "date", F.col("x").alias("value")).unionByName(pairs.select(F.col("target").alias("factor"), "date", F.col("y").alias("value"))).distinct()
    return te_tests(series, permutations, lag, bins, least, most, min_overlap, threshold).join(pairs.select("source", "target").distinct(), ["source", "target"], "left_semi")


def lead_edges(te: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """Each pair with its forward and reverse transfer entropy and their gap; ranked: significant first, then the larger gap."""
    back = te.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("te").alias("reverse_te"))
    out = te.select("source", "target", F.col("te").alias("forward_te"), "observations", "bins").join(back, ["source", "target"]).withColumn("lead_gap", F.col("forward_te") - F.col("reverse_te"))
    out = out.join(tests.select("source", "target", "p_value", "significant"), ["source", "target"], "left") if tests is not None else out.withColumn("significant", F.lit(False))
    return out


def ranked_edges(tests: DataFrame) -> DataFrame:
    """Each tested pair with both directions' values and tests, and its rank: significant pairs first, then by the gap; ties by name.

    A scan has one row a pair of the catalogue, so ranking them all is a sort of some hundreds of rows.
    """
    back = tests.select(F.col("source").alias("target"), F.col("target").alias("source"), F.col("observed").alias("reverse_te"), F.col("p_value").alias("reverse_p_value"), F.col("significant").alias("reverse_significant"))
    out = tests.withColumnRenamed("observed", "forward_te").join(back, ["source", "target"])
    # Gaps that are equal but for the order of a sum rank as equal.
    out = out.withColumn("lead_gap", F.round(F.col("forward_te") - F.col("reverse_te"), GAP_PLACES) + 0.0)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("significant"), F.desc("lead_gap"), "source", "target")
    return out.withColumn("rank", F.row_number().over(order))


def lead_matrix(edges: DataFrame, factors: list[str]) -> DataFrame:
    """One row a source, one column a target: the forward transfer entropy; null on the diagonal and for pairs with too few dates."""
    return edges.groupBy("source").pivot("target", factors).agg(F.max("forward_te"))


def unordered_pairs(factors: DataFrame) -> DataFrame:
    """left_factor < right_factor over a frame of factor names (a catalogue: some dozens of rows)."""
    names = factors.select("factor").distinct()
    return names.select(F.col("factor").alias("left_factor")).join(names.select(F.col("factor").alias("right_factor")), F.col("left_factor") < F.col("right_factor"))


def ordered_by_edge(edges: DataFrame) -> DataFrame:
    return edges.orderBy(F.desc("significant"), F.desc("lead_gap"), "source", "target")


def rounded(value: Column, places: int = 8) -> Column:
    return F.round(value, places)
