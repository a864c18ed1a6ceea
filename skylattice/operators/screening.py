"""Zonal means over cell lattices and persistent hotspots."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.quantiles import robust_spread
from skylattice.operators.composites import median_composite


def zonal_mean(pixels: DataFrame, keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """Mean per cell; cells whose pixels are all masked are absent."""
    out = pixels.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("value"))
    return out


def on_lattice(cells: DataFrame, zonal: DataFrame, key: str = "idx") -> DataFrame:
    """Every cell of the lattice, NULL where nothing was observed."""
    return cells.join(zonal, key, "left")


def week_of(day: Column, start: date) -> Column:
    """Seven-day bucket counted from the start of the range."""
    return F.floor(F.datediff(day, F.lit(start)) / 7).cast("bigint")


def hotspots(weekly: DataFrame, key: str = "idx", *, sigma_thresh: float = 2.0, top_n: int = 50) -> DataFrame:
    """Cells ranked by mean over robust sigma of all cell-weeks, with the weeks above the threshold.

    The sigma is one number for all cell-weeks; without spread nothing is a hotspot.
    """
    sigma = robust_spread(weekly, (), "value").select("sigma").scalar()
    tagged = weekly.withColumn("_sigma", sigma).where((F.col("_sigma") > 0) & F.col("value").isNotNull())
    per = tagged.groupBy(key).agg(
        F.avg("value").alias("mean_enh"), F.max("value").alias("max_enh"),
        F.count_if(F.col("value") > F.col("_sigma") * sigma_thresh).alias("weeks_flagged"),
        F.count("value").alias("weeks_observed"), F.first("_sigma").alias("_sigma"),
    )
    scored = per.withColumn("score", F.col("mean_enh") / F.col("_sigma")).drop("_sigma")
    return scored.orderBy(F.desc("score"), key).limit(top_n)


def screen_region(pixels: DataFrame, pixel_keys: tuple[str, ...], cell: Column, start: date, end: date, *,
                  background_days: int = 30, sigma_thresh: float = 2.0, top_n: int = 50) -> DataFrame:
    """Background median before ``start``, weekly mean minus background per pixel, cell means, hotspots.

    One plan for all weeks: the week is a group key.
    """
    day = F.to_date("ts")
    before = pixels.where((day >= F.date_sub(F.lit(start), background_days)) & (day < F.lit(start)))
    background = median_composite(before, ("value",), pixel_keys).withColumnRenamed("value", "bg")
    during = pixels.where((day >= F.lit(start)) & (day < F.lit(end)))
    weekly = during.groupBy(*pixel_keys, week_of(day, start).alias("week")).agg(F.avg("value").alias("v"))
    enh = weekly.join(background, list(pixel_keys)).select(cell.alias("idx"), "week", (F.col("v") - F.col("bg")).alias("value"))
    return hotspots(zonal_mean(enh, ("idx", "week")), sigma_thresh=sigma_thresh, top_n=top_n)
