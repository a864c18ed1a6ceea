"""Collection scans: scene filters, masks and one product value per observation.

A pixel table has one row per observed pixel with its scene's metadata beside it:
``scene_id, ts, tile_id, y, x, lon, lat, cloud_pct, ...`` and one column per band.
Stored partitioned by dataset and date, the date predicate prunes files and the
region predicate skips row groups; only the bands a product reads are scanned.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.catalog.expressions import band_math
from skylattice.catalog.products import Dataset, Product
from skylattice.catalog.registry import get_product, refuse, resolve_source
from skylattice.functions.geo import Region, roi_filter
from skylattice.operators.morphology import focal_median_metres

# Fixed values.
BROWSE_CLOUD_MAX = 65.0
LIST_CLOUD_MAX = 80.0
REFERENCE_CLOUD_MAX = 30.0
DETECT_CLOUD_MAX = 90.0
CLOUD_PROB_MAX = 50
FILL_DN = -9999
DN_SCALE = 10000.0

GRID_DEG = 0.01  # step of the pixel grid
PIXEL_KEYS = ("scene_id", "ts", "tile_id", "y", "x", "lon", "lat")

When = str | date | datetime


def check_dates(start: When, end: When) -> None:
    """Refuse a range that does not move forward."""
    if str(end) <= str(start):
        raise ValueError(f"end {end} must be after start {start}")


def date_range(ts: Column, start: When, end: When) -> Column:
    """Half-open range with bare literals, so it is pushed to the scan."""
    check_dates(start, end)

    def bound(v: When) -> Column:
        return F.lit(str(v)).cast("timestamp_ntz")

    return (ts >= bound(start)) & (ts < bound(end))


def scan(pixels: DataFrame, roi: Region | None, start: When, end: When) -> DataFrame:
    """Observations in the date range whose pixel lies in the region."""
    out = pixels.where(date_range(F.col("ts"), start, end))
    inside = roi_filter(F.col("lon"), F.col("lat"), roi)
    return out if inside is None else out.where(inside)


def product_column(product: Product) -> Column:
    """The product's value from its bands; colour stacks become a struct."""
    if product.is_rgb:
        return F.struct(*[F.col(b) for b in product.bands])
    if product.expression is None:
        return F.col(product.band)
    return band_math(product.expression, {b: F.col(b) for b in product.bands})


def mask_valid(value: Column, product: Product) -> Column:
    """NULL outside the valid range; the row stays."""
    return F.when(value.between(product.valid_min, product.valid_max), value)


def to_reflectance(df: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """Digital numbers to reflectance; the fill number becomes NULL, zero is a value."""
    return df.withColumns({b: F.when(F.col(b) != FILL_DN, F.col(b) / DN_SCALE) for b in bands})


def join_cloud_probability(pixels: DataFrame, clouds: DataFrame) -> DataFrame:
    """Attach cloud probability; scenes without a probability image survive unmasked.

    ``clouds`` has ``scene_id, tile_id, y, x, image_no, prob``; the first image per
    pixel is kept. ``prob_present`` is per scene: a NULL probability inside a present
    image still masks.
    """
    keys = ["scene_id", "tile_id", "y", "x"]
    first = clouds.groupBy(*keys).agg(F.min(F.struct("image_no", F.coalesce(F.col("prob"), F.lit(-1)).alias("p"))).alias("f"))
    first = first.select(*keys, F.when(F.col("f.p") >= 0, F.col("f.p")).alias("prob"))
    present = clouds.select("scene_id").distinct().withColumn("prob_present", F.lit(True))
    return (
        pixels.join(first, keys, "left")
        .join(present, "scene_id", "left")
        .withColumn("prob_present", F.coalesce("prob_present", F.lit(False)))
    )


def cloud_free(threshold: int = CLOUD_PROB_MAX) -> Column:
    """True where the pixel passes the cloud test (needs ``prob`` and ``prob_present``)."""
    return ~F.col("prob_present") | F.coalesce(F.col("prob") < threshold, F.lit(False))


def mask_bands(df: DataFrame, keep: Column, bands: tuple[str, ...]) -> DataFrame:
    return df.withColumns({b: F.when(keep, F.col(b)) for b in bands})


def of_collection(pixels: DataFrame, name: str | None) -> DataFrame:
    """Pixels of one image collection, where the table says from which each comes."""
    if name is None or "collection" not in pixels.columns:
        return pixels
    return pixels.where(F.col("collection") == name)


def optical_base(pixels: DataFrame, roi: Region | None, start: When, end: When, bands: tuple[str, ...], *,
                 cloud_max: float = BROWSE_CLOUD_MAX, threshold: int = CLOUD_PROB_MAX,
                 clouds: DataFrame | None = None, collection: str | None = None) -> DataFrame:
    """Collection, date, region and scene-cloud filters, then per-pixel cloud mask and reflectance.

    Only the cloud images of the scenes that are left are read into the join.
    """
    df = scan(of_collection(pixels, collection), roi, start, end).where(F.col("cloud_pct") <= cloud_max)
    if clouds is not None:
        clouds = clouds.join(df.select("scene_id").distinct(), "scene_id", "left_semi")
        df = join_cloud_probability(df.drop("prob", "prob_present"), clouds)
    df = mask_bands(df, cloud_free(threshold), bands)
    df = to_reflectance(df, bands)
    return df.select(*PIXEL_KEYS, *bands)


def optical_product(pixels: DataFrame, product: Product, roi: Region | None, start: When, end: When, **kw) -> DataFrame:
    """A product from surface reflectance, or from the collection that it names itself."""
    bands = product.bands or (product.band,)
    kw.setdefault("collection", product.collection)
    base = optical_base(pixels, roi, start, end, tuple(bands), **kw)
    return base.select(*PIXEL_KEYS, product_column(product).alias("value"))


def radar_filters(orbit_pass: str | None = None, relative_orbit: int | None = None) -> Column:
    keep = (F.col("mode") == "IW") & F.array_contains("pols", "VV") & F.array_contains("pols", "VH")
    if orbit_pass is not None:
        keep = keep & (F.col("orbit_pass") == orbit_pass)
    if relative_orbit is not None:
        keep = keep & (F.col("relative_orbit") == relative_orbit)
    return keep


def radar_product(pixels: DataFrame, product: Product, roi: Region | None, start: When, end: When, *,
                  orbit_pass: str | None = None, relative_orbit: int | None = None, speckle_radius_m: float | None = None,
                  step_deg: float = GRID_DEG) -> DataFrame:
    """``speckle_radius_m``: both polarisations are smoothed within each scene before the product is taken."""
    if product.dataset_id != "s1":
        raise ValueError(f"unsupported radar variable {product.key!r}")
    df = scan(pixels, roi, start, end).where(radar_filters(orbit_pass, relative_orbit))
    if speckle_radius_m is not None:
        df = focal_median_metres(df.select(*PIXEL_KEYS, "VV", "VH"), ["scene_id"], speckle_radius_m, ["VV", "VH"], step_deg)
    return df.select(*PIXEL_KEYS, product_column(product).alias("value"))


def generic_product(pixels: DataFrame, product: Product, roi: Region | None, start: When, end: When, *,
                    mask_invalid: bool = True) -> DataFrame:
    """Band select or expression with the valid-range mask; also serves trace gases."""
    value = product_column(product)
    if mask_invalid:
        value = mask_valid(value, product)
    return scan(pixels, roi, start, end).select(*PIXEL_KEYS, value.alias("value"))


def collection(pixels: DataFrame, key: str, source: str, roi: Region | None, start: When, end: When,
               extra: dict[str, Dataset] | None = None) -> DataFrame:
    """Route a product to its sensor's scan; two-window and builder products are refused."""
    product = get_product(key, source, extra)
    refuse(product)
    kind = resolve_source(key, source)
    if kind == "s1":
        return radar_product(pixels, product, roi, start, end)
    if kind == "s2":
        return optical_product(pixels, product, roi, start, end)
    return generic_product(pixels, product, roi, start, end)


def acquisition_times(pixels: DataFrame, roi: Region | None, start: When, end: When) -> DataFrame:
    """One row per scene in the window, in time order; equal times are kept."""
    return scan(pixels, roi, start, end).select("scene_id", "ts").distinct().select("ts", "scene_id").orderBy("ts", "scene_id")


def single_image(df: DataFrame, when: datetime) -> DataFrame:
    """The scene at exactly ``when``: a half-day prefilter, then equality, one row per pixel.

    Of several readings of a pixel in one scene the smallest valid one counts; a masked reading hides no valid one.
    """
    half = timedelta(hours=12)
    near = df.where(date_range(F.col("ts"), when - half, when + half))
    exact = near.where(F.col("ts") == F.lit(str(when)).cast("timestamp_ntz"))
    first = exact.groupBy("tile_id", "y", "x").agg(F.min_by("value", F.struct("scene_id", F.col("value").isNull(), "value")).alias("value"))
    return first


def list_scenes(scenes: DataFrame, start: When, end: When, max_cloud: float = LIST_CLOUD_MAX) -> DataFrame:
    """Scene metadata under a cloud ceiling with air mass; missing geometry fails loudly."""
    needed = ("ts", "spacecraft", "sun_zenith", "view_zenith")
    df = scenes.where(date_range(F.col("ts"), start, end) & (F.col("cloud_pct") <= max_cloud))
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in needed])
    checked = F.when(missing != "", F.raise_error(F.concat(F.col("scene_id"), F.lit(" lacks "), missing)).cast("double"))
    return df.withColumn("amf", F.coalesce(checked, air_mass(F.col("sun_zenith"), F.col("view_zenith")))).withColumn(
        "ref_ok", F.coalesce(F.col("cloud_pct") <= REFERENCE_CLOUD_MAX, F.lit(False))
    )


def air_mass(sun_zenith: Column, view_zenith: Column) -> Column:
    """Two-way air mass 1/cos(sun) + 1/cos(view), angles in degrees."""
    return 1 / F.cos(F.radians(sun_zenith)) + 1 / F.cos(F.radians(view_zenith))


# Fixed value: the last day the frozen plume mirror covers.
MIRROR_LAST_DAY = date(2024, 10, 26)


def split_by_freeze(mirror: DataFrame, live: DataFrame, start: date, end: date,
                    last_day: date = MIRROR_LAST_DAY) -> DataFrame:
    """Plumes in the inclusive window: the mirror up to the freeze day, the live table after it."""

    def part(df: DataFrame, lo: date, hi: date) -> DataFrame:
        return df.where(date_range(F.col("ts"), lo, hi + timedelta(days=1)))

    if end <= last_day:
        return part(mirror, start, end)
    if start > last_day:
        return part(live, start, end)
    return part(mirror, start, last_day).unionByName(part(live, last_day + timedelta(days=1), end))
