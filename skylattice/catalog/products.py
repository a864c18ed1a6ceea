"""The built-in product catalog as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field

from skylattice.catalog import palettes

# The ten-step grey ramp used when a product names no palette.
DEFAULT_PALETTE = (
    "#000000", "#1c1c1c", "#383838", "#555555", "#717171",
    "#8d8d8d", "#aaaaaa", "#c6c6c6", "#e2e2e2", "#ffffff",
)


@dataclass(frozen=True)
class Product:
    """One product; ``expression`` reads ``bands``, otherwise ``source_band`` is selected."""

    dataset_id: str
    key: str
    vis_min: float
    vis_max: float
    valid_min: float
    valid_max: float
    unit: str
    expression: str | None = None
    bands: tuple[str, ...] = ()
    source_band: str | None = None
    display_scale: float = 1.0
    collection: str | None = None
    is_rgb: bool = False
    methane_only: bool = False
    builder: str | None = None
    needs_ref: bool = False
    name: str = ""
    palette: tuple[str, ...] = field(default=DEFAULT_PALETTE)

    @property
    def band(self) -> str:
        return self.source_band or self.key


@dataclass(frozen=True)
class Dataset:
    id: str
    collection: str
    scale_m: int
    products: dict[str, Product]

    def get(self, key: str) -> Product:
        if key not in self.products:
            raise KeyError(f"no product {key!r} in {self.id!r}; known: {', '.join(sorted(self.products))}")
        return self.products[key]


S2_TOA = "COPERNICUS/S2_HARMONIZED"
S2_SR = "COPERNICUS/S2_SR_HARMONIZED"
S1_GRD = "COPERNICUS/S1_GRD"

# Formulas, bands and ranges of the optical index products
# (key, expression, bands, display range, valid range, unit, palette)
_INDICES = (
    ("NDVI", "(B8 - B4) / (B8 + B4)", ("B8", "B4",), (-0.2, 0.9), (-1.0, 1.0), "index", palettes.VEGETATION),
    ("NDWI", "(B3 - B8) / (B3 + B8)", ("B3", "B8",), (-0.8, 0.8), (-1.0, 1.0), "index", palettes.WATER),
    ("EVI", "2.5 * (B8 - B4) / (B8 + 6.0 * B4 - 7.5 * B2 + 1.0)", ("B8", "B4", "B2",), (-0.2, 0.8), (-1.0, 1.0), "index", palettes.VEGETATION),
    ("NDRE", "(B8A - B5) / (B8A + B5)", ("B8A", "B5",), (-0.2, 0.8), (-1.0, 1.0), "index", palettes.VEGETATION),
    ("CIre", "(B7 / B5) - 1", ("B7", "B5",), (0.0, 5.0), (0.0, 20.0), "index", palettes.VEGETATION),
    ("SAVI", "((B8 - B4) / (B8 + B4 + 0.5)) * 1.5", ("B8", "B4",), (-0.2, 0.8), (-1.5, 1.5), "index", palettes.VEGETATION),
    ("LAI", "3.618 * ((B7 / B5) - 1) - 0.118", ("B7", "B5",), (0.0, 6.0), (0.0, 8.0), "m2/m2", palettes.VEGETATION),
    ("MNDWI", "(B3 - B11) / (B3 + B11)", ("B3", "B11",), (-0.8, 0.8), (-1.0, 1.0), "index", palettes.WATER),
    ("NBR", "(B8A - B12) / (B8A + B12)", ("B8A", "B12",), (-0.5, 1.0), (-1.0, 1.0), "index", palettes.FIRE),
    ("BAI", "1.0 / ((0.1 - B4) * (0.1 - B4) + (0.06 - B8) * (0.06 - B8))", ("B4", "B8",), (0.0, 50.0), (0.0, 100.0), "index", palettes.FIRE),
    ("NDSI", "(B3 - B11) / (B3 + B11)", ("B3", "B11",), (-0.5, 1.0), (-1.0, 1.0), "index", palettes.SNOW),
    ("BSI", "((B11 + B4) - (B8 + B2)) / ((B11 + B4) + (B8 + B2))", ("B11", "B4", "B8", "B2",), (-0.5, 0.5), (-1.0, 1.0), "index", palettes.SOIL),
    ("NDTI", "(B11 - B12) / (B11 + B12)", ("B11", "B12",), (-0.3, 0.3), (-1.0, 1.0), "index", palettes.SOIL),
    ("NDMI", "(B8A - B11) / (B8A + B11)", ("B8A", "B11",), (-0.5, 0.7), (-1.0, 1.0), "index", palettes.WATER),
    ("NDBI", "(B11 - B8) / (B11 + B8)", ("B11", "B8",), (-0.5, 0.5), (-1.0, 1.0), "index", palettes.URBAN),
    ("CLAY", "B11 / B12", ("B11", "B12",), (0.5, 2.5), (0.0, 5.0), "ratio", palettes.SOIL),
    ("IRON", "B4 / B2", ("B4", "B2",), (0.5, 3.0), (0.0, 5.0), "ratio", palettes.MINERAL),
    ("TURB", "1246.0 * ((B4 - B3) / (B4 + B3)) + 340.0", ("B4", "B3",), (0.0, 500.0), (0.0, 500.0), "mg/L", palettes.TURBIDITY),
    ("CHLA", "4.26 * (B5 / B4) ** 3.94", ("B5", "B4",), (0.0, 50.0), (0.0, 100.0), "ug/L", palettes.WATER_QUALITY),
    ("MBSP", "(B12 - B11) / B11", ("B12", "B11",), (-0.5, 0.1), (-1.0, 1.0), "ratio", palettes.METHANE),
    ("B12_B11", "B12 / B11", ("B12", "B11",), (0.3, 0.9), (0.0, 2.0), "ratio", palettes.METHANE),
    ("URBAN_HEAT", "(B11 - B8) / (B11 + B8) - (B8 - B4) / (B8 + B4)", ("B11", "B8", "B4",), (-1.0, 1.0), (-2.0, 2.0), "index", palettes.DIVERGING),
)

# Single optical bands and the upper end of their display range.
_RAW_BANDS = (
    ("B1", 0.25), ("B2", 0.3), ("B3", 0.3), ("B4", 0.3), ("B5", 0.4), ("B6", 0.5), ("B7", 0.5),
    ("B8", 0.5), ("B8A", 0.5), ("B9", 0.3), ("B10", 0.05), ("B11", 0.5), ("B12", 0.5),
)

# Trace gases (key, source band, display range, valid range, unit, display scale, collection, palette)
_GASES = (
    ("NO2", "tropospheric_NO2_column_number_density", (0.0, 0.0003), (-0.0001, 0.001), "umol/m2", 1000000.0, "COPERNICUS/S5P/OFFL/L3_NO2", palettes.NO2),
    ("SO2", "SO2_column_number_density", (0.0, 0.0005), (-0.001, 0.01), "umol/m2", 1000000.0, "COPERNICUS/S5P/OFFL/L3_SO2", palettes.SO2),
    ("CO", "CO_column_number_density", (0.0, 0.05), (0.0, 0.1), "mmol/m2", 1000.0, "COPERNICUS/S5P/OFFL/L3_CO", palettes.CO),
    ("O3", "O3_column_number_density", (0.07, 0.2), (0.0, 0.3), "mol/m2", 1.0, "COPERNICUS/S5P/OFFL/L3_O3", palettes.O3),
    ("CH4", "CH4_column_volume_mixing_ratio_dry_air_bias_corrected", (1750.0, 2000.0), (1600.0, 2200.0), "ppb", 1.0, "COPERNICUS/S5P/OFFL/L3_CH4", palettes.CH4),
    ("HCHO", "tropospheric_HCHO_column_number_density", (0.0, 0.0005), (-0.0005, 0.005), "umol/m2", 1000000.0, "COPERNICUS/S5P/OFFL/L3_HCHO", palettes.HCHO),
)

_TOA_ONLY = ("MBSP", "B12_B11")


def _optical() -> list[Product]:
    out = [Product("s2", "RGB", 0.0, 0.3, 0.0, 1.0, "reflectance", bands=("B4", "B3", "B2"), is_rgb=True, collection=S2_SR)]
    for key, expression, bands, vis, valid, unit, palette in _INDICES:
        toa = key in _TOA_ONLY
        out.append(
            Product(
                "s2", key, *vis, *valid, unit, expression=expression, bands=bands,
                collection=S2_TOA if toa else S2_SR, methane_only=toa, palette=palette,
            )
        )
    out.append(
        Product("s2", "CH4_ANOMALY", -0.08, 0.02, -1.0, 1.0, "delta ratio", bands=("B12", "B11"),
                collection=S2_TOA, methane_only=True, builder="methane_anomaly", palette=palettes.METHANE)
    )
    out += [Product("s2", b, 0.0, top, 0.0, 1.0, "reflectance", collection=S2_SR, palette=palettes.BAND) for b, top in _RAW_BANDS]
    out.append(
        Product("s2", "DNBR", -0.5, 1.0, -2.0, 2.0, "dNBR", bands=("B8A", "B12"), needs_ref=True, collection=S2_SR, palette=palettes.BURN_CHANGE,
                expression="(pre_B8A - pre_B12) / (pre_B8A + pre_B12) - (post_B8A - post_B12) / (post_B8A + post_B12)")
    )
    return out


def _radar() -> list[Product]:
    return [
        Product("s1", "VV", -25.0, 0.0, -50.0, 10.0, "dB", collection=S1_GRD),
        Product("s1", "VH", -30.0, -5.0, -50.0, 5.0, "dB", collection=S1_GRD),
        Product("s1", "VV_VH_RATIO", 0.0, 15.0, -30.0, 30.0, "dB", expression="VV - VH", bands=("VV", "VH"), collection=S1_GRD, palette=palettes.RADAR_RATIO),
        Product("s1", "FLOOD_VV_CHANGE", -10.0, 10.0, -30.0, 30.0, "dB", expression="post_VV - pre_VV", bands=("VV",),
                needs_ref=True, collection=S1_GRD, palette=palettes.RADAR_RATIO),
        Product("s1", "RVI", 0.0, 1.0, 0.0, 1.0, "", bands=("VV", "VH"), collection=S1_GRD, palette=palettes.VEGETATION,
                expression="4 * 10 ** (VH / 10) / (10 ** (VV / 10) + 10 ** (VH / 10))"),
    ]


def _gases() -> list[Product]:
    return [
        Product("s5p", key, *vis, *valid, unit, source_band=band, display_scale=scale, collection=coll, palette=palette)
        for key, band, vis, valid, unit, scale, coll, palette in _GASES
    ]


def _dataset(id_: str, collection: str, scale_m: int, products: list[Product]) -> Dataset:
    return Dataset(id_, collection, scale_m, {p.key: p for p in products})


BUILTIN: dict[str, Dataset] = {
    d.id: d
    for d in (
        _dataset("s2", S2_SR, 10, _optical()),
        _dataset("s1", S1_GRD, 10, _radar()),
        _dataset("s5p", "COPERNICUS/S5P/OFFL", 1113, _gases()),
        _dataset("emit", "NASA/EMIT/L2B/CH4ENH", 60, [
            Product("emit", "CH4ENH", 0.0, 1500.0, -2000.0, 10000.0, "ppm m", source_band="vertical_column_enhancement", palette=palettes.PLUME)
        ]),
    )
}


def all_products() -> list[Product]:
    return [p for d in BUILTIN.values() for p in d.products.values()]
