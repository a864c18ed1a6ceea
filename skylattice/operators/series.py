"""Scene reductions, daily series, smoothing, statistics and merges.

A series is ``(series_id, date, value, count)``. The first aggregation brings pixels
down to one row per scene or day with map-side combine, so the windows that follow see
at most one row per series and day however large one series is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scene_reduction(pixels: DataFrame, keys: tuple[str, ...] = ("scene_id", "ts"), value: str = "value") -> DataFrame:
    """Mean and valid-pixel count per scene."""
    return pixels.groupBy(*keys).agg(F.avg(value).alias("value"), F.count(value).alias("count"))


def daily_series(reduced: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count-weighted mean per UTC day; scenes without a value are dropped.

    With no weight at all on a day the plain mean is used.
    """
    present = reduced.where(F.col("value").isNotNull())
    weighted = F.try_divide(F.sum(F.col("value") * F.col("count")), F.sum("count"))
    return present.groupBy(*keys, F.to_date("ts").alias("date")).agg(
        F.when(F.sum("count") > 0, weighted).otherwise(F.avg("value")).alias("value"),
        F.sum("count").cast("bigint").alias("count"),
    )


def daily_from_pixels(pixels: DataFrame, keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Daily series straight from pixels: a count-weighted mean of scene means is the pixel mean."""
    return (
        pixels.where(F.col(value).isNotNull())
        .groupBy(*keys, F.to_date("ts").alias("date"))
        .agg(F.avg(value).alias("value"), F.count(value).alias("count"))
    )


def coarse_preview(pixels: DataFrame, factor: int = 4, value: str = "value") -> DataFrame:
    """Pixels averaged over ``factor`` x ``factor`` blocks for a quick first pass."""
    return pixels.groupBy(
        "scene_id", "ts", "tile_id", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")
    ).agg(F.avg(value).alias("value"))


def rolling_trailing(series: DataFrame, keys: tuple[str, ...], *, value: str = "value", rows: int = 14,
                     min_periods: int = 4, method: str = "mean", output: str | None = None) -> DataFrame:
    """Mean or median over the last ``rows`` rows by date, NULL below ``min_periods`` values."""
    if rows < 1:
        raise ValueError("the window needs at least one row")
    if not 1 <= min_periods <= rows:
        raise ValueError("min_periods must lie between 1 and the window")
    if method not in ("mean", "median"):
        raise ValueError(f"unknown smoothing method {method!r}")
    if value not in series.columns or "date" not in series.columns:
        raise ValueError(f"a series needs 'date' and {value!r}")
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(rows - 1), 0)
    if method == "mean":
        smooth = F.avg(value).over(w)
    else:
        # A frame holds at most ``rows`` values.
        held = F.array_sort(F.collect_list(value).over(w))
        n = F.size(held)
        smooth = (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2
    name = output or f"{value}_{method}_{rows}d"
    return series.withColumn(name, F.when(F.count(value).over(w) >= min_periods, smooth))


def rolling_centred(series: DataFrame, keys: tuple[str, ...], *, value: str = "value", window_days: int = 7,
                    output: str = "smooth") -> DataFrame:
    """Mean over the days within half a window either side, by calendar day."""
    half = window_days // 2
    w = Window.partitionBy(*keys).orderBy(F.unix_date("date")).rangeBetween(-half, half)
    return series.withColumn(output, F.avg(value).over(w))


def trend_per_year(value: Column, day: Column) -> Column:
    """Ordinary least-squares slope per year; zero where the days do not spread."""
    return F.coalesce(F.regr_slope(value, day), F.lit(0.0)) * 365.25


def series_statistics(series: DataFrame, keys: tuple[str, ...], range_days: Column | None = None) -> DataFrame:
    """n, mean, population spread, extreme points (first on a tie), trend and coverage."""
    day = F.unix_date("date").cast("double")
    days = range_days if range_days is not None else (F.datediff(F.max("date"), F.min("date")) + 1)
    return series.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min_value"),
        F.min_by("date", F.struct("value", "date")).cast("string").alias("min_date"),
        F.max("value").alias("max_value"),
        F.max_by("date", F.struct(F.col("value"), -F.unix_date("date"))).cast("string").alias("max_date"),
        trend_per_year(F.col("value"), day).alias("trend_per_year"),
        (F.count("value") / days).alias("coverage"),
    )


def merge_coarse_fine(coarse: DataFrame, fine: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per key the fine row where there is one, else the coarse row."""
    c = coarse.select(*keys, F.struct("value", "count").alias("c"))
    f = fine.select(*keys, F.struct("value", "count").alias("f"))
    best = F.coalesce("f", "c")
    return c.join(f, list(keys), "full_outer").select(
        *keys, best["value"].alias("value"), best["count"].alias("count"), F.col("f").isNotNull().alias("is_fine")
    )
