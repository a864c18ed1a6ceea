"""Exact percentiles of groups of any size, and the robust statistics built on them.

A percentile is the value of a rank, found by counting. Every value has an order-preserving number:
first its sign and magnitude in steps of about five per cent, then its place among ``PLACES`` even steps between
the lowest and the highest value with that number. Counts per number, which a task sums up before anything is
shuffled, tell which number holds a rank; only values with that number are looked at in the next
pass, and the last pass counts the few that are left one by one. Nothing but these counts and the numbers that hold
a rank (two per percentile and group at most) leaves the rows, which are read three times and never copied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.joins import lookup_join
from skylattice.session import materialize

SIGMA_PER_MAD = 1.4826
STEPS_PER_DOUBLING = 15
LOWEST_POWER = 1_080  # below the smallest double, 2^-1074
FURTHEST = 40_000  # above every number of a finite value
PLACES = 1 << 16


def _magnitude(v: Column) -> Column:
    """Whole number that never falls as ``v`` grows; NaN counts as the greatest value."""
    size = F.floor((F.log2(F.abs(v)) + LOWEST_POWER) * STEPS_PER_DOUBLING).cast("int") + 1
    end = F.abs(v) == float("inf")
    return F.when(F.isnan(v), FURTHEST + 1).when(v == 0, 0).otherwise(F.signum(v).cast("int") * F.when(end, FURTHEST).otherwise(size))


def _place(v: Column, low: Column, high: Column) -> Column:
    """Place of ``v`` between the bounds, 0 where they are the same."""
    return F.when(low == high, 0).otherwise(F.floor((v - low) / (high - low) * (PLACES - 1)).cast("int"))


def _holding(counts: DataFrame, within: list[str], number: str, probs: list[float]) -> DataFrame:
    """Rows of ``counts`` that hold the rank of a percentile of their group. ``_start`` becomes the rank at which a row
    begins, from the one at which ``within`` does; each of these has at most as many rows as there are numbers."""
    run = Window.partitionBy(*within).orderBy(number)
    placed = counts.withColumn("_start", F.col("_start") + F.sum("_n").over(run) - F.col("_n"))
    return placed.where(reduce(lambda a, b: a | b, [_holds(r) for p in probs for r in _ranks(p)]))


def _ranks(prob: float) -> tuple[Column, Column]:
    """The 0-based ranks on both sides of a percentile of ``n`` values."""
    at = F.lit(prob) * (F.col("n") - 1)
    return F.floor(at), F.ceil(at)


def _holds(rank: Column) -> Column:
    return (rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_n"))


def exact_percentiles(df: DataFrame, keys: tuple[str, ...], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with a column per entry of ``probs`` (name -> probability) and ``n``, linearly interpolated.

    Groups without a value are absent; a NULL key is a group of its own.
    """
    # rows without a value are counted as none instead of filtered: a filter would be moved below the expressions
    # that give the value, and repeat them there
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    group, ps = list(keys), list(probs.values())
    if not keys:
        rows, group = rows.withColumn("_all", F.lit(0)), ["_all"]
    rows = rows.withColumn("_b", _magnitude(F.col("_v")))
    place = _place(F.col("_v"), F.col("_low"), F.col("_high"))

    counts = rows.groupBy(*group, "_b").agg(F.count("_v").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).where("_n > 0")
    counts = counts.withColumns({"n": F.sum("_n").over(Window.partitionBy(*group)), "_start": F.lit(0).cast("long")})
    first = materialize(_holding(counts, group, "_b", ps).select(*group, "_b", "n", "_low", "_high", "_start"), "brackets")
    held_rows = first.count()  # the next table has as many rows at most

    # sums are over numbers only, so that tasks need not sort for them
    bracket = [*group, "_b", "n", "_low", "_high"]
    near = lookup_join(rows, first, [*group, "_b"], ["_v"], held_rows).groupBy(*bracket, "_start", place.alias("_p")).agg(F.count("*").alias("_n"))
    places = _holding(near, [*group, "_b"], "_p", ps).groupBy(*bracket).agg(F.collect_list(F.struct("_p", "_start")).alias("_held"))
    closer = lookup_join(rows, places, [*group, "_b"], ["_v"], held_rows).withColumn("_p", place)
    hit = F.filter("_held", lambda h: h["_p"] == F.col("_p"))
    closer = closer.withColumn("_start", F.try_element_at(hit, F.lit(1))["_start"]).where("_start IS NOT NULL")
    last = closer.groupBy(*group, "_b", "_p", "n", "_start", "_v").agg(F.count("*").alias("_n"))
    found = _holding(last, [*group, "_b", "_p"], "_v", ps)

    at = lambda rank: F.max(F.when(_holds(rank), F.col("_v")))
    ends = found.groupBy(*group, "n").agg(*[at(r).alias(f"_r{i}_{side}") for i, p in enumerate(ps) for side, r in enumerate(_ranks(p))])
    values = []
    for i, (name, p) in enumerate(probs.items()):
        low, high, pos = F.col(f"_r{i}_0"), F.col(f"_r{i}_1"), F.lit(p) * (F.col("n") - 1)
        values.append(F.when(low == high, low).otherwise(low + (high - low) * (pos - F.floor(pos))).alias(name))
    return ends.select(*keys, *values, "n")


def exact_median(df: DataFrame, keys: tuple[str, ...], value: str, name: str = "median") -> DataFrame:
    return exact_percentiles(df, keys, value, {name: 0.5})


def robust_spread(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Per group ``n``, ``median``, ``mad`` and ``sigma`` = 1.4826 times the median absolute deviation."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_x"))
    med = materialize(exact_median(rows, keys, "_x").drop("n"), "medians")
    joined = lookup_join(rows, med, list(keys), ["_x"], med.count())
    dev = joined.select(*keys, "median", F.abs(F.col("_x") - F.col("median")).alias("_d"))
    mad = exact_median(dev, (*keys, "median"), "_d", "mad")
    return mad.select(*keys, "n", "median", "mad", (F.col("mad") * SIGMA_PER_MAD).alias("sigma"))


def chip_spread(df: DataFrame, keys: tuple[str, ...], value: str, keep: Column | None = None) -> DataFrame:
    """``median`` and ``sigma`` per chip, with the built-in exact median.

    Only for groups bounded by the chip-size guard (at most 1024 x 1024 pixels).
    """
    v = F.col(value) if keep is None else F.when(keep, F.col(value))
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull())
    med = rows.groupBy(*keys).agg(F.median("_v").alias("median"))
    dev = rows.join(med, list(keys)).groupBy(*keys).agg(
        F.first("median").alias("median"), F.median(F.abs(F.col("_v") - F.col("median"))).alias("mad")
    )
    return dev.select(*keys, "median", (F.col("mad") * SIGMA_PER_MAD).alias("sigma"))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Aggregate: correlation over the rows that have both; NULL where a side does not vary.

    The built-in ``corr`` divides by zero there, which fails in ANSI mode.
    """
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)
