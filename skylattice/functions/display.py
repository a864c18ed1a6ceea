"""Display expressions: palettes, ranges, flags and units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
AIR_COLUMN_MOL_M2 = 3.567e5
KG_PER_T = 1000.0

# Quality flags of a detection and what each tells the reader.
FLAG_HINTS = (
    ("cross_tile_reference", "reference comes from another tile; noise is higher"),
    ("possible_reference_contamination", "the reference itself shows an enhancement"),
    ("unstable_mask", "the mask size swings fourfold or more over the thresholds"),
    ("lut_hi_clipped_mask", "much of the mask sits at the top of the inversion range"),
    ("different_orbit_reference", "reference comes from another orbit"),
    ("nan_in_mask", "some masked pixels have no retrieval and add nothing"),
    ("wind_fallback_used", "global wind was used, the land product had no cell"),
    ("composite_reference_unavailable", "too few scenes for a composite reference"),
    ("composite_amf_spread", "reference members span a wide geometry"),
    ("flare_lit_target", "a lit flare in the target scene was excluded"),
    ("flare_lit_reference", "a lit flare in the reference scene was excluded"),
    ("not_b12_dimming", "the masked signal is not a dimming in B12"),
    ("surface_correlated", "the mask follows a visible surface feature"),
    ("sparse_chip", "fewer than 70 per cent of the pixels are valid"),
    ("cloudy_chip", "high blue reflectance points to cloud or haze"),
    ("no_plume", "nothing rose above the threshold"),
)


def flag_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FLAG_HINTS), "flag string, hint string")


def sample_palette(value: Column, lo: float, hi: float, palette: Sequence[str]) -> Column:
    """Colour of a value: clamped to the range, linear between hex stops, as (r, g, b)."""
    stops = F.array(*[F.lit(p) for p in palette])
    last = len(palette) - 1
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / F.lit(hi - lo))) * last
    i = F.least(F.floor(t), F.lit(max(0, last - 1))).cast("int")
    frac = t - i

    def channel(at: int) -> Column:
        def level(index: Column) -> Column:
            return F.conv(F.substring(F.get(stops, index), at, 2), 16, 10).cast("int")

        a, b = level(i), level(F.least(i + 1, F.lit(last)))
        return F.bround(a + (b - a) * frac).cast("int")

    rgb = F.struct(channel(2).alias("r"), channel(4).alias("g"), channel(6).alias("b"))
    return F.when(value.isNotNull(), rgb)


def legend_range(override_min: Column, override_max: Column, vis_min: Column, vis_max: Column) -> tuple[Column, Column]:
    """Overrides beat the catalog range, each end on its own."""
    return F.coalesce(override_min, vis_min), F.coalesce(override_max, vis_max)


def column_to_ppb(delta_omega: Column) -> Column:
    """Column enhancement in mol/m2 to a mixing-ratio enhancement in ppb."""
    return delta_omega / F.lit(AIR_COLUMN_MOL_M2) * F.lit(1e9)


def kgh_to_th(q: Column) -> Column:
    return q / KG_PER_T


def null_if_not_finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
