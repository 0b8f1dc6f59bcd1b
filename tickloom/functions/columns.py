"""Column expressions that several operators share. All are built-in functions: plans stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: How far a year's data may be trusted; other years are ``unknown_year``.
YEAR_GRADES = {2025: "coarse_only", 2026: "fine_ok"}
UNKNOWN_YEAR = "unknown_year"


def instrument_key(source_file: Column | str) -> Column:
    """The stem of a ``.csv`` path; null where the path has none."""
    return F.nullif(F.regexp_extract(source_file, r"([^/]+)\.csv$", 1), F.lit(""))


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def session(seconds: Column, name: str) -> Column:
    """Whether a time lies in the morning (09:30 to 12:00) or the afternoon (13:00 to 16:00), ends excluded."""
    begin, end = {"morning": (34_200, 43_200), "afternoon": (46_800, 57_600)}[name]
    return (seconds >= begin) & (seconds < end)


def year_grade(date: Column) -> Column:
    out = F.lit(UNKNOWN_YEAR)
    for year, grade in YEAR_GRADES.items():
        out = F.when(F.year(date) == year, grade).otherwise(out)
    return out


def pearson(x: str, y: str) -> Column:
    """Aggregate: correlation, null where a side does not vary."""
    both = lambda c: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(both(x)) * F.stddev_pop(both(y)))


def effective_bins(n: Column, requested: Column | int) -> Column:
    """Bins of n values: at least two values a bin where that leaves two bins; 1 for a single value."""
    wanted = F.lit(requested) if isinstance(requested, int) else requested
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(2), F.least(wanted, n, F.greatest(F.lit(2), F.floor(n / 2))))).cast("long")


def adaptive_bins(n: Column, least: int = 4, most: int = 16) -> Column:
    """Sturges' number of bins within limits, then ``effective_bins``; ceil(log2 n) is the bit length of n - 1."""
    if least < 2 or most < least:
        raise ValueError("need 2 <= least <= most")
    bits = F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1)))
    return effective_bins(n, F.greatest(F.lit(least), F.least(bits + 1, F.lit(most))))


def frequency_bin(place: Column, bins: Column, n: Column) -> Column:
    """Bin of the place (from 0) among n in equal-frequency bins."""
    return F.least(F.floor(place * bins / n), bins - 1).cast("long")


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def zscore(value: str, within: list[str]) -> Column:
    """Window: distance from the mean in population standard deviations; 0 where nothing varies."""
    w = Window.partitionBy(*within)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(value) - F.avg(value).over(w), sd))


def slug(text: Column) -> Column:
    """Lower-cased words of letters and digits joined by underscores."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def listed(text: Column) -> Column:
    """The non-blank parts of a comma-separated text, trimmed, each once, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def equal_weight(*signals: Column) -> Column:
    """Plain mean of signals; null where one is."""
    if not signals:
        raise ValueError("need at least one signal")
    total = signals[0]
    for s in signals[1:]:
        total = total + s
    return total / len(signals)
