"""Lookup, source resolution, refusals, and the catalog as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.catalog.products import BUILTIN, Dataset, Product, all_products

RADAR_KEYS = tuple(BUILTIN["s1"].products)

CATALOG_SCHEMA = (
    "dataset_id string, key string, vis_min double, vis_max double, valid_min double, valid_max double, "
    "unit string, expression string, bands array<string>, source_band string, display_scale double, "
    "collection string, is_rgb boolean, methane_only boolean, builder string, needs_ref boolean"
)


def resolve_source(key: str, source: str) -> str:
    """The dataset behind the virtual source ``"methane"``, or ``source`` itself."""
    if source != "methane":
        return source
    if key == "CH4":
        return "s5p"
    return "s1" if key in RADAR_KEYS else "s2"


def resolve_source_column(key: Column, source: Column) -> Column:
    """Column form of :func:`resolve_source` for tables of requests."""
    routed = F.when(key == "CH4", "s5p").when(key.isin(*RADAR_KEYS), "s1").otherwise("s2")
    return F.when(source == "methane", routed).otherwise(source)


def get_dataset(dataset_id: str, extra: dict[str, Dataset] | None = None) -> Dataset:
    known = {**(extra or {}), **BUILTIN}
    if dataset_id not in known:
        raise KeyError(f"no dataset {dataset_id!r}; known: {', '.join(sorted(known))}")
    return known[dataset_id]


def get_product(key: str, source: str, extra: dict[str, Dataset] | None = None) -> Product:
    return get_dataset(resolve_source(key, source), extra).get(key)


def refuse(product: Product, *, scalar: bool = False, one_window: bool = True) -> None:
    """Raise when ``product`` cannot be computed by the path that is being built."""
    if product.builder is not None:
        raise ValueError(f"{product.key} needs its own builder {product.builder!r}")
    if scalar and product.is_rgb:
        raise ValueError(f"{product.key} is a colour stack and has no scalar reduction")
    if one_window and product.needs_ref:
        raise ValueError(f"{product.key} compares two windows and needs a reference window")


def catalog_table(spark: SparkSession) -> DataFrame:
    """The built-in catalog: one row per product (a fixed-size dimension)."""
    rows = [
        (p.dataset_id, p.key, p.vis_min, p.vis_max, p.valid_min, p.valid_max, p.unit, p.expression, list(p.bands),
         p.band, p.display_scale, p.collection, p.is_rgb, p.methane_only, p.builder, p.needs_ref)
        for p in all_products()
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def merge_catalogs(builtin: DataFrame, user: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Built-ins first; user datasets may not reuse a built-in id. Returns (merged, collisions)."""
    ids = builtin.select("dataset_id").distinct()
    accepted = user.join(F.broadcast(ids), "dataset_id", "left_anti")
    collisions = user.join(F.broadcast(ids), "dataset_id", "left_semi")
    return builtin.unionByName(accepted), collisions
