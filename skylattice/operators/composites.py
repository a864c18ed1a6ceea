"""Per-pixel composites, two-window comparisons and display ranges."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.catalog.expressions import band_math
from skylattice.catalog.products import Product
from skylattice.functions.quantiles import exact_percentiles
from skylattice.sources.scans import When, date_range

PIXEL = ("tile_id", "y", "x")


def mean_composite(pixels: DataFrame, values: tuple[str, ...] = ("value",), keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Mean per pixel; NULL (masked) observations are ignored."""
    return pixels.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in values])


def exact_mean_composite(pixels: DataFrame, values: tuple[str, ...], keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Mean per pixel for rules with limits: values are added as decimals of 12 places, so the order of the rows decides nothing."""
    means = [(F.sum(F.col(c).try_cast("decimal(20,12)")).cast("double") / F.count(c)).alias(c) for c in values]
    return pixels.groupBy(*keys).agg(*means)


def centred_window(day: date, half_days: int) -> tuple[date, date]:
    """The half-open window of ``half_days`` each side of ``day``."""
    if half_days < 0:
        raise ValueError("half_days must not be negative")
    return day - timedelta(days=half_days), day + timedelta(days=half_days + 1)


def date_composite(pixels: DataFrame, day: date, half_days: int = 3) -> DataFrame:
    start, end = centred_window(day, half_days)
    return mean_composite(pixels.where(date_range(F.col("ts"), start, end)))


def median_composite(pixels: DataFrame, values: tuple[str, ...] = ("value",), keys: tuple[str, ...] = PIXEL) -> DataFrame:
    """Exact median per pixel, masked observations left out.

    Each value is first reduced to (pixel, value, frequency) rows. Band values are 16-bit
    numbers, so a pixel of any depth reaches its final aggregate with at most 65,536 rows.
    """
    out = None
    for c in values:
        counted = pixels.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("n"))
        med = counted.groupBy(*keys).agg(F.percentile(c, 0.5, F.col("n")).alias(c))
        out = med if out is None else out.join(med, list(keys), "full_outer")
    return out


def latest_mosaic(images: DataFrame, keys: tuple[str, ...], value: str, order: tuple[str, ...]) -> DataFrame:
    """One value per key: the latest image that has one."""
    have = images.where(F.col(value).isNotNull())
    return have.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def compare_windows(pixels: DataFrame, product: Product, ref: tuple[When, When], now: tuple[When, When]) -> DataFrame:
    """Product over ``pre_``/``post_`` means: one scan and one aggregation, no join.

    Both windows are read in a single pass as conditional means per pixel.
    """
    if not product.needs_ref:
        raise ValueError(f"{product.key} is not a two-window product")
    pre, post = date_range(F.col("ts"), *ref), date_range(F.col("ts"), *now)
    means = []
    for b in product.bands:
        means += [F.avg(F.when(pre, F.col(b))).alias(f"pre_{b}"), F.avg(F.when(post, F.col(b))).alias(f"post_{b}")]
    stacked = pixels.where(pre | post).groupBy(*PIXEL).agg(*means)
    names = [f"{p}_{b}" for b in product.bands for p in ("pre", "post")]
    value = band_math(product.expression, {n: F.col(n) for n in names})
    return stacked.select(*PIXEL, value.alias("value"))


def ratio_anomaly(pixels: DataFrame, target: Column, reference: Column) -> DataFrame:
    """Mean B12/B11 where ``target`` holds minus the mean where ``reference`` holds, per pixel."""
    ratio = F.try_divide(F.col("B12"), F.col("B11"))
    agg = pixels.where(target | reference).groupBy(*PIXEL).agg(
        F.avg(F.when(target, ratio)).alias("t"), F.avg(F.when(reference, ratio)).alias("r")
    )
    return agg.where(F.col("t").isNotNull() | F.col("r").isNotNull()).select(*PIXEL, (F.col("t") - F.col("r")).alias("value"))


def windowed_anomaly(pixels: DataFrame, day: date, half_days: int, ref: tuple[When, When]) -> DataFrame:
    start, end = centred_window(day, half_days)
    return ratio_anomaly(pixels, date_range(F.col("ts"), start, end), date_range(F.col("ts"), *ref))


def single_scene_anomaly(pixels: DataFrame, scene_id: str, ref: tuple[When, When]) -> DataFrame:
    """One scene's ratio minus the reference mean; no such scene is an error, raised when run."""
    ratio = F.try_divide(F.col("B12"), F.col("B11"))
    scene = pixels.where(F.col("scene_id") == scene_id).groupBy(*PIXEL).agg(F.avg(ratio).alias("t"))
    reference = pixels.where(date_range(F.col("ts"), *ref)).groupBy(*PIXEL).agg(F.avg(ratio).alias("r"))
    # an ungrouped count always has its one row
    found = pixels.where(F.col("scene_id") == scene_id).agg(F.count("*").alias("_found"))
    checked = found.select(F.when(F.col("_found") > 0, F.lit(1)).otherwise(F.raise_error(F.lit(f"no scene {scene_id}")).cast("int")).alias("_ok"))
    both = scene.join(reference, list(PIXEL)).select(*PIXEL, (F.col("t") - F.col("r")).alias("value"))
    # a branch of its own without rows: no plan of the join can leave the check out
    none = checked.where("_ok <> 1").select(*[F.lit(None).cast(t).alias(c) for c, t in both.dtypes])
    return both.unionByName(none)


def vegetation_water_mask(pixels: DataFrame, reflectance: DataFrame, value: str = "value", *, ndvi_max: float = 0.3,
                          ndwi_max: float = 0.0, vegetation: bool = True, water: bool = True) -> DataFrame:
    """Mask ``value`` where the window's mean composite is vegetated or wet."""
    mean = exact_mean_composite(reflectance, ("B3", "B4", "B8"))
    ndvi = F.try_divide(F.col("B8") - F.col("B4"), F.col("B8") + F.col("B4"))
    ndwi = F.try_divide(F.col("B3") - F.col("B8"), F.col("B3") + F.col("B8"))
    keep = F.lit(True)
    if vegetation:
        keep = keep & (ndvi <= ndvi_max)
    if water:
        keep = keep & (ndwi <= ndwi_max)
    mask = mean.select(*PIXEL, keep.alias("keep"))
    return pixels.join(mask, list(PIXEL), "left").withColumn(value, F.when(F.col("keep"), F.col(value))).drop("keep")


def display_range(pixels: DataFrame, product: Product, keys: tuple[str, ...] = (), headroom: float = 0.15) -> DataFrame:
    """0.5 and 99.5 percentiles with headroom, held inside the valid range, else the catalog range."""
    if product.is_rgb:
        raise ValueError("a colour stack keeps its catalog range")
    p = exact_percentiles(pixels, keys, "value", {"p_lo": 0.005, "p_hi": 0.995})
    span = F.col("p_hi") - F.col("p_lo")
    lo = F.greatest(F.col("p_lo") - span * headroom, F.lit(product.valid_min))
    hi = F.least(F.col("p_hi") + span * headroom, F.lit(product.valid_max))
    ok = F.col("p_lo").isNotNull() & F.coalesce(lo < hi, F.lit(False))
    return p.select(
        *keys, F.when(ok, lo).otherwise(product.vis_min).alias("vis_min"), F.when(ok, hi).otherwise(product.vis_max).alias("vis_max")
    )


def anomaly_range(pixels: DataFrame, keys: tuple[str, ...] = (), fallback: tuple[float, float] = (-0.08, 0.02)) -> DataFrame:
    """Symmetric range about the median out to p2 or p98, whichever is further, with ten per cent room."""
    p = exact_percentiles(pixels, keys, "value", {"p02": 0.02, "p50": 0.5, "p98": 0.98})
    half = F.greatest(F.col("p50") - F.col("p02"), F.col("p98") - F.col("p50"), F.lit(0.005)) * 1.10
    ok = F.col("p50").isNotNull()
    return p.select(
        *keys, F.when(ok, F.col("p50") - half).otherwise(fallback[0]).alias("vis_min"),
        F.when(ok, F.col("p50") + half).otherwise(fallback[1]).alias("vis_max"),
    )
