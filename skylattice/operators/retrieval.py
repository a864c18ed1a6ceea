"""Methane retrieval on chips in long form: (keys, y, x, bands).

A chip has at most 1024 x 1024 pixels (the chip-size guard), so a window over one chip is a
bounded partition. All per-chip statistics are windows on the same keys: the pixels are
shuffled once and every later step on those keys reuses that partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.geo import MAX_CHIP_PX
from skylattice.functions.quantiles import SIGMA_PER_MAD

# In-band solar irradiance per spacecraft (W m-2 um-1) and the reflectance floor.
IRRADIANCE = {
    "Sentinel-2A": {"B8A": 955.19, "B11": 245.59, "B12": 85.25},
    "Sentinel-2B": {"B8A": 953.93, "B11": 247.08, "B12": 87.75},
}
HOT_FLOOR = 0.01
SPARSE_SHARE = 0.7
CLOUDY_BLUE = 0.25


def guard_chip(df: DataFrame) -> DataFrame:
    """Fail when a pixel lies outside the largest chip; keeps per-chip windows bounded."""
    ok = F.col("y").between(0, MAX_CHIP_PX - 1) & F.col("x").between(0, MAX_CHIP_PX - 1)
    return df.withColumn("y", F.when(ok, F.col("y")).otherwise(F.raise_error(F.lit("pixel outside the chip limit")).cast("bigint")))


def fit_ratio(r11: Column, r12: Column, keep: Column, over=None) -> Column:
    """Zero-intercept least squares of R11 on R12 over the kept pixels; NULL without signal."""
    num = F.sum(F.when(keep, r11 * r12))
    den = F.sum(F.when(keep, r12 * r12))
    if over is not None:
        num, den = num.over(over), den.over(over)
    return F.try_divide(num, den)


def delta_r(r11: Column, r12: Column, c: Column) -> Column:
    """(c R12 - R11) / R11, NULL where R11 is missing or zero."""
    return F.try_divide(c * r12 - r11, r11)


def single_pass(pixels: DataFrame, keys: Sequence[str], r11: str = "b11", r12: str = "b12", *, robust: bool = False,
                exclude: Column | None = None) -> DataFrame:
    """Calibrated signal per pixel with one refit that leaves the plume out.

    Adds ``delta_r, c, c_initial, n_excluded``. The default cut is one population standard
    deviation about zero; ``robust`` takes the MAD sigma about the median. ``exclude`` drops
    pixels from both fits and from the spread. With fewer than three kept pixels the first
    fit stands.
    """
    w = Window.partitionBy(*keys)
    a, b = F.col(r11), F.col(r12)
    valid = a.isNotNull() & b.isNotNull()
    if exclude is not None:
        valid = valid & ~F.coalesce(exclude, F.lit(False))
    df = pixels.withColumn("_valid", valid).withColumn("c_initial", fit_ratio(a, b, F.col("_valid"), w))
    df = df.withColumn("_dr0", delta_r(a, b, F.col("c_initial")))
    dr = F.when(F.col("_valid"), F.col("_dr0"))
    if robust:
        df = df.withColumn("_mid", F.median(dr).over(w))
        df = df.withColumn("_sigma", F.median(F.abs(dr - F.col("_mid"))).over(w) * SIGMA_PER_MAD)
    else:
        df = df.withColumn("_mid", F.lit(0.0)).withColumn("_sigma", F.stddev_pop(dr).over(w))
    off = F.abs(F.col("_dr0") - F.col("_mid"))
    usable = F.col("_valid") & F.col("_dr0").isNotNull()
    keep = usable & (off <= F.col("_sigma"))
    df = df.withColumns({
        "_keep": F.coalesce(keep, F.lit(False)), "_out": F.coalesce(usable & (off > F.col("_sigma")), F.lit(False)),
    })
    df = df.withColumns({
        "_n": F.count_if(F.col("_keep")).over(w), "_nout": F.count_if(F.col("_out")).over(w),
        "_c": fit_ratio(a, b, F.col("_keep"), w),
    })
    refit = F.col("_sigma").isNotNull() & (F.col("_n") >= 3)
    df = df.withColumns({
        "c": F.when(refit, F.col("_c")).otherwise(F.col("c_initial")),
        "n_excluded": F.when(refit, F.col("_nout")).otherwise(F.lit(0).cast("bigint")),
    })
    df = df.withColumn("delta_r", delta_r(a, b, F.col("c")))
    return df.drop("_valid", "_dr0", "_mid", "_sigma", "_keep", "_out", "_n", "_nout", "_c")


def pass_difference(target: DataFrame, reference: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Target minus reference per pixel for each value; both sides share the grid."""
    ref = reference.select(*keys, "y", "x", *[F.col(c).alias(f"_{c}") for c in values])
    joined = target.select(*keys, "y", "x", *values).join(ref, [*keys, "y", "x"])
    return joined.select(*keys, "y", "x", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in values])


def hot_pixel(spacecraft: Column, b8a: Column, b11: Column, b12: Column) -> Column:
    """True on lit-flare pixels; missing bands are never hot, an unknown spacecraft fails."""
    def e(band: str) -> Column:
        chain = None
        for name, table in IRRADIANCE.items():
            hit = spacecraft == name
            chain = F.when(hit, table[band]) if chain is None else chain.when(hit, table[band])
        return chain.otherwise(F.raise_error(F.concat(F.lit("unknown spacecraft "), spacecraft)).cast("double"))

    swir = b12 * e("B12") > b11 * e("B11")
    nir = b11 * e("B11") > b8a * e("B8A")
    return F.coalesce((swir | nir) & (b12 >= HOT_FLOOR) & (b8a >= 0) & (b11 >= 0), F.lit(False))


def chip_flags(n_pixels: Column, b12: Column, b2: Column) -> Column:
    """Aggregate: sparse and cloudy flags of a chip."""
    sparse = F.count(b12) / n_pixels < SPARSE_SHARE
    cloudy = F.avg(b2) > CLOUDY_BLUE
    return F.array_compact(F.array(F.when(sparse, "sparse_chip"), F.when(cloudy, "cloudy_chip")))


def mean_sign_ok(signal: Column, mask: Column) -> Column:
    """Aggregate: the masked signal dims on average; nothing to judge counts as fine."""
    mean = F.avg(F.when(mask, signal))
    return F.coalesce(mean < 0, F.lit(True))


def edge_share(delta_omega: Column, mask: Column, lo: float, hi: float) -> tuple[Column, Column]:
    """Aggregates: shares of masked finite pixels at the low and at the high end of the table."""
    inside = F.when(mask, delta_omega)
    low = F.avg((inside <= lo).cast("int"))
    high = F.avg((inside >= hi).cast("int"))
    return F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(0.0))
